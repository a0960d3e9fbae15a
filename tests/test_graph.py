import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.operators.recursion import connect_by, hierarchy, recursive_union

E = "g int, src string, dst string"
N = "g int, node string"


def reach(edges):
    out = set(edges)
    while True:
        more = {(g, a, d) for g, a, b in out for h, c, d in edges if g == h and b == c} - out
        if not more:
            return out
        out |= more


def expected_levels(nodes, edges):
    closed = reach(edges)
    blocked = {(g, b) for g, a, b in closed if (g, a, a) in closed}

    def level(n):
        if n in blocked:
            return None
        return max((level((g, a)) + 1 for g, a, b in edges if (g, b) == n), default=0)

    return {n: level(n) for n in nodes}


def longest(nodes, edges, g):
    best = [()]

    def walk(path):
        key = (-len(path), path)
        if not best[0] or key < (-len(best[0]), best[0]):
            best[0] = path
        for h, a, b in edges:
            if h == g and a == path[-1]:
                walk((*path, b))

    for h, n in nodes:
        if h == g:
            walk((n,))
    return list(best[0])


def random_graph(seed, acyclic):
    rng = random.Random(seed)
    nodes, edges = [], set()
    for g in range(3):
        names = [f"n{i}" for i in range(7)]
        nodes += [(g, n) for n in names]
        for _ in range(9):
            i, j = sorted(rng.sample(range(7), 2))
            if not acyclic and rng.random() < 0.2:
                i, j = j, i
            edges.add((g, names[i], names[j]))
    return nodes, sorted(edges)


@pytest.mark.parametrize("seed, acyclic", [(1, True), (2, True), (3, False), (4, False)])
def test_levels_closure_and_longest_path_against_brute_force(spark, seed, acyclic):
    nodes, edges = random_graph(seed, acyclic)
    n, e = spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)
    got = {(r.g, r.node): r.level for r in graph.levels(n, e, ["g"]).collect()}
    assert got == expected_levels(nodes, edges)
    closed = {(r.g, r.src, r.dst) for r in graph.closure(e, ["g"]).collect()}
    assert closed == reach(set(edges))
    cyclic = {g for g, a, b in reach(set(edges)) if a == b}
    paths = {r.g: r.path for r in graph.longest_path(n, e, ["g"]).collect()}
    assert paths == {g: None if g in cyclic else longest(nodes, edges, g) for g in range(3)}
    if acyclic:
        assert all(got[(g, a)] < got[(g, b)] for g, a, b in edges)


@pytest.mark.parametrize("seed", [3, 4, 5, 6])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = {(g, f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for g in range(3) for _ in range(13)}
    closed = reach(edges)
    mutual = {(g, a, b) for g, a, b in closed if (g, b, a) in closed}
    want = {(g, a): min(y for h, x, y in mutual if (h, x) == (g, a)) for g, a, b in mutual if a != b}
    got = graph.components(spark.createDataFrame(sorted(edges), E), ["g"]).collect()
    assert {(r.g, r.node): r.component for r in got} == want and len(got) == len(want)


def chain(spark, n, g=0):
    return spark.range(n).select(F.lit(g).alias("g"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


@pytest.fixture
def rounds(monkeypatch):
    """How many tables the loops write."""
    written, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, tag: written.append(tag) or stage(df, tag))
    return written


def test_a_thousand_links_take_logarithmic_rounds(spark, rounds):
    edges, n = chain(spark, 1000).coalesce(1), spark.range(1001).select(F.lit(0).alias("g"), F.col("id").alias("node"))
    got = graph.levels(n, edges, ["g"])
    assert got.where("level <> node").count() == 0 and got.count() == 1001 and len(rounds) <= 12
    rounds.clear()
    starts = spark.createDataFrame([(0, "a", 0), (0, "b", 990)], "g int, label string, node long")
    found = graph.reachable(starts, edges, ["g"], ["label"])
    assert {(r.label, r.n) for r in found.groupBy("label").agg(F.count("node").alias("n")).collect()} == {("a", 1001), ("b", 11)}
    assert len(rounds) <= 12
    rounds.clear()
    path = graph.longest_path(n, edges, ["g"]).first().path
    assert path == list(range(1001)) and len(rounds) <= 26


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spread_reaches_what_reachable_does(spark, seed):
    """Cycles, loops, hubs, a chain longer than the first plain rounds, starts that nothing leads on from, and NULLs."""
    rng = random.Random(seed)
    edges = {(g, f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for g in range(3) for _ in range(35)}
    edges |= {(1, f"n{i}", "hub") for i in range(30)} | {(1, "hub", f"o{i}") for i in range(30)} | {(1, "o3", "n4")}
    edges |= {(2, f"c{i}", f"c{i + 1}") for i in range(40)} | {(2, "n1", "c0"), (None, "n1", "n2"), (0, None, "n1")}
    table = spark.createDataFrame(sorted(edges, key=str), E)
    rows = [(0, "a", "n1"), (0, "b", "n2"), (1, "a", "n3"), (2, None, "n1"), (2, "a", "n7"), (2, "a", "none"), (None, "a", "n1"), (0, "a", None), (0, "a", "n1")]
    starts = spark.createDataFrame(rows, "g int, label string, node string")
    found = graph.spread(starts, table, ["g"], ["label"])
    assert found.columns == ["g", "label", "node"]
    got, want = ([tuple(r) for r in df.collect()] for df in (found, graph.reachable(starts, table, ["g"], ["label"])))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(2, None, f"c{i}") for i in range(41)} <= set(got)


def test_spread_takes_few_rounds_on_long_ways(spark, monkeypatch):
    """A chain of 1000, one of pairs of nodes that both lead to the next pair, and one with a hub in the middle."""
    counts, add = [], graph.Rounds.add
    monkeypatch.setattr(graph.Rounds, "add", lambda self, df: counts.append(add(self, df)) or counts[-1])
    single = [(0, f"n{i}", f"n{i + 1}") for i in range(1000)]
    double = [(1, f"{a}{i}", f"{b}{i + 1}") for i in range(300) for a in "ab" for b in "ab"]
    hub = [(2, f"{a}{i}", "n0") for i in range(40) for a in "ab"] + [(2, "n20", f"o{i}") for i in range(40)] + [(2, f"n{i}", f"n{i + 1}") for i in range(60)]
    starts = spark.createDataFrame([(0, "n0"), (1, "a0"), (2, "a1")], "g int, node string")
    found = graph.spread(starts, spark.createDataFrame(single + double + hub, E).coalesce(1), ["g"])
    assert {r.g: r.n for r in found.groupBy("g").agg(F.count("node").alias("n")).collect()} == {0: 1001, 1: 601, 2: 102}
    assert len(counts) <= 20


def test_components_of_a_long_cycle_with_a_tail(spark):
    around = chain(spark, 60).coalesce(1).unionByName(spark.createDataFrame([(0, 60, 20)], "g int, src long, dst long"))
    got = {r.node: r.component for r in graph.components(around, ["g"]).collect()}
    assert got == dict.fromkeys(range(20, 61), 20)


def test_closure_of_a_deep_chain_and_of_a_cycle(spark, rounds):
    edges = chain(spark, 100).unionByName(spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0)], "g int, src long, dst long"))
    got = {(r.g, r.src, r.dst) for r in graph.closure(edges, ["g"]).collect()}
    assert got == {(0, a, b) for a in range(101) for b in range(a + 1, 101)} | {(1, a, b) for a in range(3) for b in range(3)}
    assert len(rounds) <= 9


def test_a_hierarchy_of_100000_levels(spark, rounds):
    n = 100_000
    rows = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("boss"))
    got = connect_by(rows, "id", "boss")
    assert got.where("level <> id + 1").count() == 0 and got.count() == n and len(rounds) <= 20
    rounds.clear()
    marked = hierarchy(rows, "id", "boss")
    assert marked.where("level <> id + 1 OR root <> 0 OR on_cycle").count() == 0 and marked.count() == n and len(rounds) <= 20


def test_a_cycle_ends_in_a_table(spark):
    rows = [(1, None), (2, 1), (3, 5), (4, 3), (5, 4), (6, 5), (7, 6), (8, 8), (9, 99), (10, 9), (None, 2), (None, None)]
    staff = spark.createDataFrame(rows, "id int, boss int")
    got = {(r.id, r.boss): (r.root, r.level, r.on_cycle) for r in hierarchy(staff, "id", "boss").collect()}
    lost, behind = (None, None, True), (None, None, False)
    assert got == {
        (1, None): (1, 1, False), (2, 1): (1, 2, False), (3, 5): lost, (4, 3): lost, (5, 4): lost, (6, 5): behind, (7, 6): behind,
        (8, 8): lost, (9, 99): (9, 1, False), (10, 9): (9, 2, False), (None, 2): (1, 3, False), (None, None): (None, 1, False),
    }
    with pytest.raises(RuntimeError, match="cycle"):
        connect_by(staff, "id", "boss", start_with=F.col("id") == 3)


def test_connect_by_counts_every_way_and_carries_paths(spark):
    parts = spark.createDataFrame([("car", None), ("axle", "car"), ("wheel", "axle"), ("wheel", "car"), ("bolt", "wheel")], "part string, of string")
    got = sorted((r.level, r.way) for r in connect_by(parts, "part", "of", path=("way", F.col("part"), "/")).collect())
    assert got == sorted([
        (1, "car"), (2, "car/axle"), (3, "car/axle/wheel"), (2, "car/wheel"),
        (4, "car/axle/wheel/bolt"), (3, "car/wheel/bolt"),
    ])


def test_distinct_recursion_ends_on_a_cycle(spark):
    one = spark.createDataFrame([(0, None)], "n int, x int")
    got = recursive_union(one, lambda last: last.select(((F.col("n") + 1) % 5).alias("n"), "x"), distinct=True)
    assert sorted(r.n for r in got.collect()) == [0, 1, 2, 3, 4]


def test_no_edges(spark):
    n = spark.createDataFrame([(0, "a"), (0, "b")], N)
    e = spark.createDataFrame([], E)
    assert {(r.node, r.level) for r in graph.levels(n, e, ["g"]).collect()} == {("a", 0), ("b", 0)}
    assert graph.closure(e, ["g"]).count() == 0
    assert [r.path for r in graph.longest_path(n, e, ["g"]).collect()] == [["a"]]


def test_reachable_keeps_its_starts_and_ends_on_cycles(spark):
    e = spark.createDataFrame([(0, "a", "b"), (0, "b", "a"), (0, "b", "c"), (1, "a", "z")], E)
    s = spark.createDataFrame([(0, "q", "a")], "g int, label string, node string")
    got = {(r.g, r.label, r.node) for r in graph.reachable(s, e, ["g"], ["label"]).collect()}
    assert got == {(0, "q", "a"), (0, "q", "b"), (0, "q", "c")}


def test_a_cycle_behind_a_long_tail(spark):
    chain = [(0, f"n{i}", f"n{i + 1}") for i in range(5)] + [(0, "n5", "n4"), (1, "a", "b")]
    n = spark.createDataFrame(sorted({(g, x) for g, a, b in chain for x in (a, b)}), N)
    got = {r.g: r.path for r in graph.longest_path(n, spark.createDataFrame(chain, E), ["g"]).collect()}
    assert got == {0: None, 1: ["a", "b"]}


def test_self_edges_do_not_count(spark):
    e = spark.createDataFrame([(0, "a", "a"), (0, "a", "b")], E)
    n = spark.createDataFrame([(0, "a"), (0, "b")], N)
    assert {(r.node, r.level) for r in graph.levels(n, e, ["g"]).collect()} == {("a", 0), ("b", 1)}


def test_hierarchy(spark):
    staff = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3), (9, 8)], "id int, boss int")
    got = {r.id: r.level for r in connect_by(staff, "id", "boss").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3}
    below = connect_by(staff, "id", "boss", start_with=F.col("id") == 3)
    assert {r.id: r.level for r in below.collect()} == {3: 1, 4: 2}


def test_recursion_keeps_duplicates_and_stops_at_its_limit(spark):
    one = spark.createDataFrame([(1,), (1,)], "n int")
    got = recursive_union(one, lambda last: last.where("n < 3").select((F.col("n") + 1).alias("n")))
    assert sorted(r.n for r in got.collect()) == [1, 1, 2, 2, 3, 3]
    with pytest.raises(RuntimeError):
        recursive_union(one, lambda last: last, max_rounds=3)


def test_chain_deeper_than_the_built_in_recursion_limit(spark):
    depth = 104
    e = spark.range(depth).select(F.lit(0).alias("g"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    n = spark.range(depth + 1).select(F.lit(0).alias("g"), F.col("id").alias("node"))
    got = graph.levels(n, e.coalesce(1), ["g"])
    assert got.where("level <> node").count() == 0
    assert got.agg(F.max("level")).first()[0] == depth
