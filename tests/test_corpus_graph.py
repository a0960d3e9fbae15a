import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators.staging import new_path
from millrace.plans import catalog, corpus_graph, statement_graph
from millrace.sources.parsed import ParsedScripts
from millrace.sources.partitioned import VersionConflict

STATEMENTS = "script_id long, stmt_no int, target_table string, source_tables array<string>"


def made_up(seed, scripts=60):
    """Statements of which a third write a shared mart and most read it."""
    rng = random.Random(seed)
    out = []
    for script in range(scripts):
        for number in range(rng.randrange(1, 5)):
            target = rng.choice(["mart.hot", "mart.hot", f"t{rng.randrange(9)}", f"own{script}", None])
            reads = {rng.choice(["mart.hot", "raw.a", f"t{rng.randrange(9)}", f"own{script}"]) for _ in range(3)} - {target if rng.random() < 0.5 else ""}
            out.append((script, number, target, sorted(reads)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_over_all_scripts(spark, seed):
    rows = made_up(seed)
    random.Random(seed).shuffle(rows)
    got = [tuple(r) for r in corpus_graph.edges(spark.createDataFrame(rows, STATEMENTS).repartition(3)).collect()]
    want = []
    for script, number, _, reads in rows:
        for table in reads:
            before = [(s, n) for s, n, target, _ in rows if target == table and (s, n) < (script, number)]
            if before:
                want.append((*max(before), script, number, table))
    assert sorted(got) == sorted(want)
    assert len(got) <= sum(len(r[3]) for r in rows)


def test_a_hot_mart_is_not_gathered(spark):
    """No window or join is dealt by the table alone: rows of one table lie in many partitions."""
    rows = spark.range(40_000).select(
        F.col("id").alias("script_id"), F.lit(0).alias("stmt_no"), F.lit("mart.hot").alias("target_table"),
        F.array(F.lit("mart.hot")).alias("source_tables"),
    )
    found = corpus_graph.edges(rows)
    assert found.count() == 39_999 and found.where("src_script <> dst_script - 1").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(table#\d+, \d+", plan)


def test_downstream_tables(spark):
    rows = [(1, 0, "a", ["raw.x"]), (2, 0, "b", ["a", "raw.y"]), (3, 0, "c", ["b"]), (3, 1, "b", ["c"]), (4, 0, None, ["c"]), (5, 0, "a", ["a"])]
    table = spark.createDataFrame(rows, STATEMENTS)
    got = corpus_graph.downstream(table, spark.createDataFrame([("raw.x",), ("raw.y",), ("b",), ("none",)], "table string")).collect()
    assert {tuple(r) for r in got} == {("raw.x", "a"), ("raw.x", "b"), ("raw.x", "c"), ("raw.y", "b"), ("raw.y", "c"), ("b", "c")}


def test_downstream_makes_no_pairs_of_a_marts_writers_and_readers(spark):
    """400 tables lead to a mart and 400 come from it: no table on the way holds their 160,000 pairs."""
    rows = [(i, 0, f"own{i}", ["raw.x"]) for i in range(400)] + [(i, 1, "mart.hot", [f"own{i}"]) for i in range(400)]
    rows += [(i, 2, f"report{i}", ["mart.hot"]) for i in range(400)]
    base = Path(new_path(spark, "before").removeprefix("file:")).parent
    before = set(base.iterdir())
    got = corpus_graph.downstream(spark.createDataFrame(rows, STATEMENTS).coalesce(1), spark.createDataFrame([("raw.x",)], "table string")).collect()
    assert len(got) == 801 and {r.table for r in got} == {"raw.x"} and len({r.depends for r in got}) == 801
    most = max(spark.read.option("recursiveFileLookup", True).parquet(str(p)).count() for p in set(base.iterdir()) - before)
    assert most <= 3000


FIRST = ["CREATE TABLE a AS SELECT x FROM r; CREATE TABLE b AS SELECT x FROM a", "SELECT 1 FROM t", "-- nothing", "SELECT 1 FROM t", None]
SECOND = [FIRST[0], "SELECT 2 FROM t", "CREATE TABLE a AS SELECT 1 FROM s; CREATE TABLE c AS SELECT 1 FROM a", FIRST[1], ""]


def test_only_new_texts_are_parsed(spark, scripts, monkeypatch):
    store = ParsedScripts(spark, new_path(spark, "parsed"))
    seen, parse = [], catalog.statements
    monkeypatch.setattr(catalog, "statements", lambda df: seen.append(sorted(r.sql_text for r in df.collect())) or parse(df))
    first, second = scripts(*FIRST), scripts(*SECOND)
    assert store.refresh(first) == 3 and store.refresh(second) == 3 and store.refresh(second) == 0
    assert seen == [sorted({t for t in FIRST if t is not None}), sorted(set(SECOND) - set(FIRST)), []]
    for corpus in (first, second):
        full = parse(corpus)
        got = store.statements(corpus).select(*full.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, full.collect()))
        edges = statement_graph.edges(full)
        assert sorted(map(tuple, store.edges(corpus).select(*edges.columns).collect())) == sorted(map(tuple, edges.collect()))
    changes = {(r.change, r.script_id, r.src, r.dst, r.via_table) for r in store.edge_changes(first, second).collect()}
    assert changes == {("added", 2, 0, 1, "a")}
    assert {(r.change, r.script_id) for r in store.edge_changes(second, first).collect()} == {("removed", 2)}


def test_two_runs_cannot_take_one_number(spark, scripts, monkeypatch):
    path = new_path(spark, "parsed")
    ParsedScripts(spark, path).refresh(scripts("SELECT 1 FROM t"))
    late = ParsedScripts(spark, path)
    monkeypatch.setattr(late, "runs", lambda: [])
    with pytest.raises(VersionConflict):
        late.refresh(scripts("SELECT 2 FROM t"))
    assert ParsedScripts(spark, path).statements(scripts("SELECT 1 FROM t")).count() == 1
