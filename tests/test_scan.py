import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import scan
from millrace.operators.staging import stage


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Adaptive execution would merge the range partitions of such small tables into one."""
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    yield
    spark.conf.set(conf, before)


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows share one key, another key is NULL, and some values are NULL."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        key = "hot" if i % 2 else rng.choice(["a", "b", None, "c"])
        rows.append((i, key, rng.choice([None, 1, 2, 3, 5, 8]), rng.randint(0, 50)))
    return rows, spark.createDataFrame(rows, "id int, k string, v int, o int").repartition(5).cache()


def by_key(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    return groups


def test_row_number_spreads_a_hot_key(skewed):
    rows, df = skewed
    got = {r.id: r.n for r in scan.row_number(df, ["k"], [F.col("o"), F.col("id")], "n").collect()}
    for group in by_key(rows).values():
        for n, r in enumerate(sorted(group, key=lambda r: (r[3], r[0])), 1):
            assert got[r[0]] == n


def test_running_sum_skips_nulls(skewed):
    rows, df = skewed
    got = {r.id: r.s for r in scan.running_sum(df, ["k"], [F.col("o"), F.col("id")], {"s": F.col("v")}).collect()}
    for group in by_key(rows).values():
        total = None
        for r in sorted(group, key=lambda r: (r[3], r[0])):
            if r[2] is not None:
                total = (total or 0) + r[2]
            assert got[r[0]] == total


def test_global_row_number(skewed):
    rows, df = skewed
    got = [r.n for r in scan.row_number(df, [], [F.col("id")], "n").orderBy("id").collect()]
    assert got == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("descending", [True, False])
def test_rank_shares_places_and_leaves_gaps(skewed, descending):
    rows, df = skewed
    got = {r.id: r.p for r in scan.rank(df, ["k"], "o", "p", descending).collect()}
    for group in by_key(rows).values():
        for r in group:
            ahead = sum(1 for x in group if (x[3] > r[3] if descending else x[3] < r[3]))
            assert got[r[0]] == ahead + 1


def test_median_of_hot_even_odd_and_empty_groups(spark, skewed):
    rows, df = skewed
    extra = spark.createDataFrame([(900, "none", None, 0)], df.schema)
    got = {r.k: r.m for r in scan.median(df.unionByName(extra), ["k"], "v", "m").collect()}
    for key, group in by_key(rows).items():
        assert got[key] == statistics.median([r[2] for r in group if r[2] is not None])
    assert got["none"] is None


def test_a_hot_key_lies_in_several_slices(skewed, monkeypatch):
    _, df = skewed
    staged = []

    def keep(table, tag):
        staged.append(stage(table, tag))
        return staged[-1]

    monkeypatch.setattr(scan, "stage", keep)
    scan.row_number(df, ["k"], [F.col("o"), F.col("id")], "n").collect()
    slices = staged[0].groupBy("k").agg(F.count_distinct("__slice").alias("n"))
    assert slices.where("k = 'hot'").first().n > 1
    sizes = [r["count"] for r in staged[0].groupBy("__slice").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 200
