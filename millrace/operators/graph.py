"""Graph operators over edge tables ``(keys…, src, dst)``; each key value is a graph of its own.

All graphs advance together and every round is one written table. Rounds double the distance they look at: the
``jumps`` of round k are the pairs joined by a walk of 2^k edges, so a graph as deep as n takes about log2 n
rounds. Nothing is collected but the row counts of a round.

The jumps of a chain or a tree are at most as many as its nodes in each round; in general they are pairs of
the closure. ``components`` keeps one row per node and edge instead, whatever the graph, and ``spread`` makes
no more jumps than a few per edge, so that nodes with many ways in and out (hubs) cost no pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.operators.staging import Rounds, stage

#: Up to so many edges, walks are lengthened before the size of the largest graph is asked for.
SHORT = 8

#: ``spread`` lengthens walks through nodes with so many ways in, or ways out, at most, to so many jumps per edge.
BROAD = 4


def written(df: DataFrame, tag: str, **counted: Column) -> tuple[DataFrame, dict[str, int]]:
    """The written table, and how many of its rows each condition holds for, counted by the same write."""
    seen = Observation()
    table = stage(df.observe(seen, *[F.count(F.when(c, 1)).alias(n) for n, c in counted.items()]), tag)
    return table, seen.get


def _ahead(jumps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return jumps.select(*keys, F.col("__src").alias("node"), F.col("node").alias("__next"))


def _doubled(jumps: DataFrame, keys: Sequence[str], first: DataFrame | None = None) -> DataFrame:
    """All jumps, or those of ``first``, made longer by another."""
    longer = (jumps if first is None else first).join(_ahead(jumps, keys), [*keys, "node"]).select(*keys, "__src", F.col("__next").alias("node"))
    return longer.distinct()


def _arcs(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.select(*keys, F.col("src").alias("__src"), F.col("dst").alias("node")).where("__src <> node").distinct()


def _cyclic_from(nodes: DataFrame, keys: Sequence[str]) -> int:
    """A walk of so many edges visits a node of its graph twice."""
    largest = (nodes.groupBy(*keys) if keys else nodes.groupBy()).count().agg(F.max("count")).first()[0]
    return largest or 0


def levels(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, node, level)``: the length of the longest path to each node; NULL where a cycle precedes it.

    A path of less than 2^(k+1) edges either has less than 2^k, or its last 2^k are a jump and the others
    come before that. Nodes that walks as long as their graph is large lead to are on or behind a cycle.
    """
    keys = list(keys)
    jump, level = F.col("__src").isNotNull(), F.lit(None).cast("bigint").alias("level")
    state, n = written(_arcs(edges, keys).withColumn("level", level), "levels", jumps=jump)
    length, least = 1, None
    while n["jumps"]:
        if length >= SHORT:
            least = _cyclic_from(nodes, keys) if least is None else least
            if length >= least:
                break
        jumps, placed = state.where(jump), state.where(~jump).drop("__src")
        before = placed.select(*keys, F.col("node").alias("__src"), F.col("level").alias("__before"))
        reached = jumps.join(before, [*keys, "__src"], "left").select(
            *keys, "node", (F.coalesce("__before", F.lit(0)) + length).alias("level")
        )
        best = placed.unionByName(reached).groupBy(*keys, "node").agg(F.max("level").alias("level"))
        longer = _doubled(jumps, keys).withColumn("level", level)
        state, n = written(longer.unionByName(best, allowMissingColumns=True), "levels", jumps=jump)
        length *= 2
    blocked = state.where(jump).select(*keys, "node").distinct().withColumn("blocked", F.lit(True))
    known = state.where(~jump).select(*keys, "node", "level")
    found = nodes.select(*keys, "node").join(known, [*keys, "node"], "left").join(blocked, [*keys, "node"], "left")
    return found.select(
        *keys, "node", F.when(F.col("blocked").isNull(), F.coalesce("level", F.lit(0))).cast("bigint").alias("level")
    )


def reachable(starts: DataFrame, edges: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """All ``(keys…, carry…, node)`` rows reached from ``starts``, which are included; cycles end by themselves.

    What round k has found lies less than 2^k edges away. When a round finds nothing new, nothing lies further.
    """
    keys, columns = list(keys), [*keys, *carry, "node"]
    jump = F.col("__src").isNotNull()
    first = starts.select(*columns).distinct().unionByName(_arcs(edges, keys), allowMissingColumns=True)
    state, n = written(first, "reach", jumps=jump, found=~jump)
    while n["jumps"]:
        jumps, found = state.where(jump).select(*keys, "__src", "node"), state.where(~jump).select(*columns)
        step = found.join(_ahead(jumps, keys), [*keys, "node"]).select(*keys, *carry, F.col("__next").alias("node"))
        # A shortest path meets no node twice, so jumps that come back to their start are not needed.
        longer = _doubled(jumps, keys).where("__src <> node")
        before = n["found"]
        both = found.unionByName(step).distinct().unionByName(longer, allowMissingColumns=True)
        state, n = written(both, "reach", jumps=jump, found=~jump)
        if n["found"] == before:
            break
    return state.where(~jump).select(*columns)


def spread(starts: DataFrame, edges: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """The rows of ``reachable``, for few starts in a graph where many nodes lead to hubs and hubs to many nodes.

    A round goes on from the rows that the last one found, along edges, so tables hold edges and found rows and
    no other pairs. Where that takes many rounds, jumps are added to the edges, twice as long in each round,
    but none through a hub, and no more than a few per edge: chains take rounds by the logarithm of their length,
    and what jumps leave out the edges reach.
    """
    keys, columns = list(keys), [*keys, *carry, "node"]
    jumps, n = written(_arcs(edges, keys), "arcs", rows=F.lit(True))
    steps, length, longest, most = jumps, 1, n["rows"], BROAD * n["rows"]
    rounds = Rounds(starts.sparkSession, "spread")
    fresh = rounds.add(starts.select(*columns).distinct())
    while fresh:
        if rounds.count > SHORT and length <= longest and 0 < n["rows"] <= most:
            length *= 2
            jumps, n = written(_past_hubs(jumps, keys), "jumps", rows=F.lit(True))
            steps = steps.unionByName(jumps) if n["rows"] <= most else steps
        step = rounds.last().join(_ahead(steps, keys), [*keys, "node"]).select(*keys, *carry, F.col("__next").alias("node"))
        # An intersection of all columns rather than a join, as NULLs are equal here.
        fresh = rounds.add(step.distinct().subtract(rounds.all()))
    return rounds.all()


def _past_hubs(jumps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jumps of twice the length, without those whose middle has many ways in and many ways out."""
    ins = jumps.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("__in"))
    outs = jumps.groupBy(*keys, F.col("__src").alias("node")).agg(F.count(F.lit(1)).alias("__out"))
    middles = ins.join(outs, [*keys, "node"]).where(F.least("__in", "__out") <= BROAD).select(*keys, "node")
    return _doubled(jumps, keys, jumps.join(middles, [*keys, "node"], "left_semi")).where("__src <> node")


def closure(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, src, dst)`` for every node and each of its descendants."""
    starts = edges.select(*keys, "src", F.col("dst").alias("node"))
    return reachable(starts, edges, keys, ["src"]).withColumnRenamed("node", "dst")


def walks(starts: DataFrame, edges: DataFrame, keys: Sequence[str], carry: Sequence[str] = (), path: Sequence[str] = ()) -> DataFrame:
    """``(keys…, carry…, node, steps)``: every walk from the rows of ``starts``, one row per walk.

    Where each node has one way in, or one way out, there are as many rows as there are nodes on the way. The
    text columns ``path`` of ``starts`` and ``edges`` are appended along the walk. A walk that never ends, as a cycle
    can be reached, is an error.
    """
    keys, carry, path = list(keys), list(carry), list(path)
    jump = F.col("__src").isNotNull()
    arcs = edges.select(*keys, F.col("src").alias("__src"), F.col("dst").alias("node"), *path)
    first = starts.select(*keys, *carry, "node", *path, F.lit(0).cast("bigint").alias("steps"))
    state, n = written(first.unionByName(arcs, allowMissingColumns=True), "walks", jumps=jump, found=~jump)
    length, most = 1, None
    while n["jumps"]:
        jumps, found = state.where(jump).select(*keys, "__src", "node", *path), state.where(~jump).drop("__src")
        ahead = jumps.select(
            *keys, F.col("__src").alias("node"), F.col("node").alias("__next"), *[F.col(p).alias(f"__{p}") for p in path]
        )
        longer_path = [F.concat(p, f"__{p}").alias(p) for p in path]
        step = found.join(ahead, [*keys, "node"]).select(
            *keys, *carry, F.col("__next").alias("node"), *longer_path, (F.col("steps") + length).alias("steps")
        )
        longer = jumps.join(ahead, [*keys, "node"]).select(*keys, "__src", F.col("__next").alias("node"), *longer_path)
        before = n["found"]
        both = found.unionByName(step).unionByName(longer, allowMissingColumns=True)
        state, n = written(both, "walks", jumps=jump, found=~jump)
        if n["found"] == before:
            break
        if length >= SHORT:
            most = edges.count() if most is None else most
            if length > most:
                raise RuntimeError(f"a walk of {length} edges among {most}: the data hold a cycle")
        length *= 2
    return state.where(~jump).select(*keys, *carry, "node", *path, "steps")


def longest_path(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, path)``: the longest path of each graph, NULL where it has a cycle.

    Among equally long paths the first by node names is taken. Heights (the longest path onward) come first;
    the path then starts at the first of the highest nodes and goes on to the first neighbour one lower,
    so that each node has one successor and the path is a walk over these.
    """
    keys = list(keys)
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    heights = stage(levels(nodes.select(*keys, "node").distinct(), back, keys), "heights")
    summary = heights.groupBy(*keys).agg(
        F.max(F.col("level").isNull()).alias("cyclic"), F.min(F.struct((-F.col("level")).alias("rank"), "node")).alias("first")
    )
    summary = stage(summary, "tops")
    straight = heights.join(summary.where("NOT cyclic").select(*keys), keys, "left_semi")
    high = straight.select(*keys, F.col("node").alias("src"), F.col("level").alias("high"))
    low = straight.select(*keys, F.col("node").alias("dst"), (F.col("level") + 1).alias("high"))
    onward = edges.select(*keys, "src", "dst").join(high, [*keys, "src"]).join(low, [*keys, "dst", "high"])
    onward = onward.groupBy(*keys, "src").agg(F.min("dst").alias("dst"))
    starts = summary.where("NOT cyclic").select(*keys, F.col("first.node").alias("node"))
    places = F.array_sort(F.collect_list(F.struct("steps", "node")))
    paths = walks(starts, onward, keys).groupBy(*keys).agg(F.transform(places, lambda p: p["node"]).alias("path"))
    return summary.select(*keys).join(paths, keys, "left")


def components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, node, component)`` of the nodes that lie on a cycle: equal components reach each other.

    ``component`` is the smallest node of its kind. A phase drops nodes without a way in or out, then ranks
    the others afresh by a hash; the highest rank that leads to a node is its colour. Nodes of a colour that
    lead back to where it comes from are strongly connected with that node, and edges between colours join
    no cycle. A colour spreads along edges and, as who is before my colour is before me, from the node it is
    named for, so it needs few rounds on long ways too. Tables hold a row per node or edge, never per pair.
    """
    keys = list(keys)
    arcs = stage(edges.select(*keys, "src", "dst").where("src <> dst").distinct(), "arcs")
    done: list[DataFrame] = []
    while True:
        ins = arcs.select(*keys, F.col("dst").alias("src")).distinct()
        outs = arcs.select(*keys, F.col("src").alias("dst")).distinct()
        kept = arcs.join(ins, [*keys, "src"], "left_semi").join(outs, [*keys, "dst"], "left_semi").select(*keys, "src", "dst")
        arcs, n = written(kept, "arcs", rows=F.lit(True))
        if not n["rows"]:
            break
        forward = _coloured(arcs, keys, len(done))
        one, two = (forward.select(*keys, F.col("node").alias(end), F.col("colour").alias(f"c_{end}")) for end in ("src", "dst"))
        inside = arcs.join(one, [*keys, "src"]).join(two, [*keys, "dst"]).where("c_src = c_dst").select(*keys, "src", "dst")
        inside = stage(inside, "inside")
        backward = _coloured(inside.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")), keys, len(done))
        strong = forward.join(backward, [*keys, "node", "colour"]).select(*keys, "node", F.col("colour.node").alias("__name"))
        strong = stage(strong, "strong")
        done.append(strong)
        for end in ("src", "dst"):
            inside = inside.join(strong.select(*keys, F.col("node").alias(end)), [*keys, end], "left_anti")
        arcs = inside.select(*keys, "src", "dst")
    found = arcs.select(*keys, F.col("src").alias("node"), F.col("src").alias("__name"))
    for part in done:
        found = found.unionByName(part)
    names = found.groupBy(*keys, "__name").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("__n"))
    return found.join(names.where("__n > 1"), [*keys, "__name"]).select(*keys, "node", "component")


def _coloured(arcs: DataFrame, keys: Sequence[str], phase: int) -> DataFrame:
    """``(keys…, node, colour)``: the highest (rank, node) among each node and all that lead to it."""
    nodes = arcs.select(*keys, F.col("src").alias("node")).union(arcs.select(*keys, "dst")).distinct()
    rank = F.xxhash64(*keys, "node", F.lit(phase))
    state = stage(nodes.withColumn("colour", F.struct(rank.alias("rank"), F.col("node").alias("node"))), "colours")
    while True:
        along = arcs.join(state.withColumnRenamed("node", "src"), [*keys, "src"]).select(*keys, F.col("dst").alias("node"), "colour")
        named = state.select(*keys, "node", F.col("colour.node").alias("__via")).where("node <> __via")
        further = named.join(state.select(*keys, F.col("node").alias("__via"), "colour"), [*keys, "__via"]).select(*keys, "node", "colour")
        offered = along.unionByName(further).withColumn("own", F.lit(False)).unionByName(state.withColumn("own", F.lit(True)))
        best = offered.groupBy(*keys, "node").agg(F.max("colour").alias("colour"), F.max(F.when(F.col("own"), F.col("colour"))).alias("old"))
        table, n = written(best, "colours", changed=F.col("colour") > F.col("old"))
        state = table.drop("old")
        if not n["changed"]:
            return state
