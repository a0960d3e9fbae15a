"""Near-duplicate embeddings by sorted projection passes.

A pass hashes every vector to 64 signs of random projections and orders the vectors of a label by these signs,
lexicographically; each is compared with its neighbours in that order, at least ``WINDOW`` on either side, and
what is verified becomes a link. Two vectors whose cosine is the threshold share a sign with a known chance,
and share the signs that it takes to be neighbours with a power of it; there are as many passes, each with
projections of its own, as leave a pair unseen with a chance of at most ``MISSED``.

Windows only have to connect a group, not to show all of its pairs: they yield stars. The links of a vector are
then counted within its connected group, which holds them all. Small groups are compared whole. Of a large
one, vectors so close to its centre that any two of them must link are counted without being compared, and
the others meet all members in tiles of bounded size; counts leave a tile, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage
from millrace.llm.components import components
from millrace.llm.vectors import by_length, finite, lists
from millrace.operators import scan

LEAST = 0.93
WINDOW = 256
#: Most rows of a block, which is what one comparison of neighbours holds besides its first window.
BLOCK = 2048
MISSED = 1e-4
#: Larger groups are counted in tiles of about so many members.
TILE = 1024
BITS = 64
GROUP = ["label", "dims"]


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors in double precision, at length one."""
    wide = vectors.astype(float)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def passes_for(rows: int, least: float) -> int:
    """Passes over ``rows`` vectors of one label that leave a pair at the threshold unseen with a chance of ``MISSED``."""
    if rows <= WINDOW:
        return 1
    same = (1 - math.acos(least) / math.pi) ** math.log2(rows / WINDOW)
    return math.ceil(math.log(MISSED) / math.log1p(-same))


def _keys(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
    """The key of every vector in each pass; signed numbers in the order of their signs."""
    for batch in batches:
        for rows, x in by_length(batch.column(3)):
            u, of = unit(x), [batch.column(k).take(pa.array(rows)) for k in range(3)]
            for k in range(passes):
                normals = np.random.default_rng((12, k, x.shape[1])).standard_normal((x.shape[1], BITS))
                bits = np.packbits(u @ normals > 0, axis=1)
                keys = (bits.view(">u8").ravel() ^ np.uint64(1 << 63)).astype("<u8").view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), k), pa.int32()), *of, pa.array(keys, pa.int64())], ["pass", "label", "dims", "node", "key"]
                )


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal values in the first ``by`` columns, which come sorted; runs are of bounded size."""
    left = None
    for batch in batches:
        if left is not None:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(by)])
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()] if len(keys) else []
        for a, b in zip(starts, starts[1:], strict=False):
            yield batch.slice(a, b - a)
        left = batch.slice(starts[-1]) if starts else None
    if left is not None and left.num_rows:
        yield left


def _matrix(column: pa.ListArray) -> np.ndarray:
    return unit(next(by_length(column))[1])


def stars(near: np.ndarray) -> np.ndarray:
    """Pairs (first, other) that connect what the symmetric matrix ``near`` connects."""
    fresh, out = near.sum(axis=1) > near.diagonal(), []
    while fresh.any():
        first = front = np.flatnonzero(fresh)[:1]
        fresh[first] = False
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & fresh)
            fresh[front] = False
            out.append(np.c_[np.repeat(first, len(front)), front])
    return np.concatenate(out) if out else np.empty((0, 2), int)


def _neighbours(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links between neighbours; columns pass, label, dims, block, place, node, vec, of blocks in order."""
    for run in _runs(batches, 4):
        u, nodes = _matrix(run.column(6)), run.column(5).to_numpy()
        for at in range(0, max(1, len(u) - WINDOW), WINDOW):
            part = u[at : at + 2 * WINDOW]
            pairs = stars(part @ part.T >= least) + at
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, k]]) for k in (0, 1)], ["a", "b"])


def links(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Links (a, b) that connect the groups of ``nodes`` (label, dims, node, vec); staged."""
    largest = nodes.groupBy(*GROUP).count().agg(F.max("count")).first()[0] or 0
    passes = passes_for(largest, least)
    keyed = nodes.select(*GROUP, "node", "vec").mapInArrow(
        lambda batches: _keys(batches, passes), "pass int, label long, dims long, node long, key long"
    )
    placed = scan.row_number(keyed, ["pass", *GROUP], [F.col("key"), F.col("node")], "place").withColumn("place", F.col("place") - 1)
    # The first window of a block is also at the end of the one before.
    block = F.floor(F.col("place") / BLOCK).cast("long")
    guest = (F.col("place") >= BLOCK) & (F.col("place") % BLOCK < WINDOW)
    dealt = placed.withColumn("block", F.explode(F.when(guest, F.array(block - 1, block)).otherwise(F.array(block))))
    by = ["pass", *GROUP, "block"]
    dealt = stage(dealt.select(*by, "place", "node"), "places")
    full = dealt.join(nodes.select("node", "vec"), "node").select(*by, "place", "node", "vec")
    full = full.repartition(*by).sortWithinPartitions(*by, "place")
    return stage(full.mapInArrow(lambda batches: _neighbours(batches, least), "a long, b long").distinct(), "links")


def _whole(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """How many rows each node of a group links with; columns root, node, n, vec, sorted by root."""
    for run in _runs(batches, 1):
        u, n = _matrix(run.column(3)), run.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([run.column(1), pa.array((u @ u.T >= least) @ n - 1, pa.int64())], ["node", "n_links"])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by root; columns root, n, vec."""
    for batch in batches:
        roots = batch.column(0).to_numpy()
        for rows, x in by_length(batch.column(2)):
            weighted, (names, at) = unit(x) * batch.column(1).to_numpy()[rows, None], np.unique(roots[rows], return_inverse=True)
            sums = np.zeros((len(names), x.shape[1]))
            np.add.at(sums, at, weighted)
            yield pa.RecordBatch.from_arrays([pa.array(names), lists(sums, pa.float64())], ["root", "total"])


def _cores(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Whether a node is so near the centre that it links with all such; columns root, node, n, vec, centre."""
    reach = math.acos(least) / 2 - 1e-6
    for batch in batches:
        core = np.zeros(batch.num_rows, bool)
        centres = batch.column(4)
        for rows, x in by_length(batch.column(3)):
            c = next(by_length(centres.take(pa.array(rows))))[1]
            size = np.linalg.norm(c, axis=1)
            near = (unit(x) * c).sum(axis=1) >= math.cos(reach) * size
            core[rows] = near & (size > 0)
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)] + [pa.array(core)], ["root", "node", "n", "vec", "core"])


def _tiles(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows that members link with in a tile; columns root, i, j, side, node, n, core, vec, sorted by these."""
    for run in _runs(batches, 3):
        u, side = _matrix(run.column(7)), run.column(3).to_numpy()
        n, core = run.column(5).to_numpy(), run.column(6).to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(left) and len(right):
            near = u[left] @ u[right].T >= least
            # Those in the core count the others here, the others count all members.
            counts = np.r_[(near @ n[right])[core[left]], n[left] @ near]
            nodes = run.column(4).take(pa.array(np.r_[left[core[left]], right]))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(counts, pa.int64())], ["node", "n_links"])


def _large(members: DataFrame, least: float, tile: int) -> DataFrame:
    """``node`` and ``n_links`` of the members (root, node, n, vec) of large groups."""
    sums = members.select("root", "n", "vec").mapInArrow(_centres, "root long, total array<double>")
    cells = sums.select("root", F.posexplode("total").alias("at", "v")).groupBy("root", "at").agg(F.sum("v").alias("v"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"])
    centres = stage(cells.groupBy("root").agg(centre.alias("centre")), "centres")
    joined = members.join(centres, "root").select("root", "node", "n", "vec", "centre")
    schema = f"root long, node long, n long, vec {members.schema['vec'].dataType.simpleString()}, core boolean"
    cored = stage(joined.mapInArrow(lambda batches: _cores(batches, least), schema), "cored")
    sizes = cored.groupBy("root").agg(
        F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_rows"),
        F.ceil(F.count(F.lit(1)) / tile).alias("lefts"),
        F.ceil(F.count(F.when(~F.col("core"), 1)) / tile).alias("rights"),
    )
    sized = cored.join(stage(sizes, "sizes"), "root")
    own = sized.select("node", F.when(F.col("core"), F.col("core_rows")).otherwise(0).alias("n_links"))
    columns = ["root", "i", "j", "side", "node", "n", "core", "vec"]

    def spread(rows: DataFrame, side: int, mine: str, my: str, other: str, others: str) -> DataFrame:
        at = F.pmod(F.xxhash64("node", F.lit(side)), F.col(mine)).cast("long").alias(my)
        all_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col(others).cast("long") - 1)).alias(other)
        return rows.where("rights > 0").select("*", at, all_, F.lit(side).alias("side")).select(*columns)

    met = spread(sized, 0, "lefts", "i", "j", "rights").union(spread(sized.where("NOT core"), 1, "rights", "j", "i", "lefts"))
    met = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side")
    counted = met.mapInArrow(lambda batches: _tiles(batches, least), "node long, n_links long")
    both = own.unionByName(counted).groupBy("node").agg((F.sum("n_links") - 1).alias("n_links"))
    return both


def counts(nodes: DataFrame, groups: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """``node``, ``root`` and ``n_links`` (rows directly linked) of the nodes that ``groups`` names; staged."""
    members = stage(nodes.join(groups, "node").select("root", "node", "n", "vec"), "linked")
    sizes = stage(members.groupBy("root").count(), "sizes")
    big = stage(sizes.where(F.col("count") > tile).select("root"), "large")
    small = members.join(big, "root", "left_anti").repartition("root").sortWithinPartitions("root")
    found = small.mapInArrow(lambda batches: _whole(batches, least), "node long, n_links long")
    if not big.isEmpty():
        found = found.unionByName(_large(stage(members.join(big, "root", "left_semi"), "members"), least, tile))
    return stage(groups.join(found, "node").select("node", "root", "n_links"), "counts")


def near_duplicates(rows: DataFrame, vector: str = "embedding", least: float = LEAST, tile: int = TILE) -> DataFrame:
    """One row per row of ``rows`` (vec_id, label, ``vector``): ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Rows link where their labels are equal and their cosine is at least ``least``. A NULL label, or a vector
    that is NULL, zero, empty or not finite, links with nothing, and vectors of different lengths do not link.
    Equal vectors of a label are compared once and count each for itself, repeated rows as well.
    ``component_id`` is the smallest vec_id of a group; NULL ids belong to groups but name none. ``kept``
    says that a row bears that id. Other columns are left out.
    """
    vec = F.col(f"`{vector}`")
    usable = F.col("label").isNotNull() & finite(vec) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    marked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vec.alias("vec"), usable.alias("usable"))
    digest = [F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit(12), "vec", "label").alias("h2")]
    taking = marked.where("usable").select("vec_id", "label", F.size("vec").cast("long").alias("dims"), "vec", *digest)
    nodes = taking.groupBy("h1", "h2").agg(
        F.any_value("label").alias("label"), F.any_value("dims").alias("dims"), F.any_value("vec").alias("vec"),
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"),
    )
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = components(links(nodes, least))
    counted = counts(nodes, groups, least, tile)
    flat = nodes.select("h1", "h2", "n", "first_id", "node").join(counted, "node", "left").select(
        "h1", "h2", "first_id", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.col("n") - 1).alias("n_links")
    )
    flat = stage(flat, "flat")
    names = stage(flat.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    named = stage(flat.join(names, "root").select("h1", "h2", "n_links", "component_id"), "named")
    ids = taking.select("vec_id", "h1", "h2")
    found = ids.join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
