import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace import registry
from millrace.operators.apply import apply_top_n
from millrace.operators.staging import new_path
from millrace.plans import sales
from millrace.streaming.incremental import load_new_files
from tools.check_oracles import compare, connect

SMALL = "/root/testdata/sf0.001"
SAMPLE = (
    "customer_ltv", "upsert_customer_ltv", "agg_family", "outer_apply_top_order", "recursive_reports", "stmt_catalog",
    "dependency_labels", "model_columns", "impact_all_columns", "column_trace", "pattern_warnings", "lineage_export",
)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_statement():
    assert set(registry.queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_equal_to_duckdb(spark, name):
    ok, note = compare(spark, connect(SMALL), name, SMALL)
    assert ok, note


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.queries()["customer_txn"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_orderpriority" not in plan


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_results_do_not_depend_on_the_time_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name in ("customer_txn", "stg_orders", "monthly_revenue", "incremental_events"):
            ok, note = compare(spark, connect(SMALL), name, SMALL)
            assert ok, f"{name}: {note}"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_top_n_is_cut_before_the_shuffle(spark):
    plan = registry.queries()["cross_apply_top_orders"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 2, Partial" in plan


def test_outer_apply_keeps_unmatched_rows(spark):
    outer = spark.createDataFrame([(1,), (2,)], "k int")
    inner = spark.createDataFrame([(1, 5), (1, 7), (1, 9)], "ik int, v int")
    got = apply_top_n(outer, inner, "k", "ik", [F.col("v").desc()], 2, keep_unmatched=True)
    assert sorted((r.k, r.v or 0, r.place or 0) for r in got.collect()) == [(1, 7, 2), (1, 9, 1), (2, 0, 0)]


def test_ltv_tiers_and_excluded_states(spark):
    day = dt.date(2001, 1, 1)
    orders = spark.createDataFrame(
        [(1, 1, day, "F", 4_000_000), (2, 2, day, "F", 3_999_999), (3, 3, day, "F", 1), (4, 3, day, "P", 9_000_000)],
        "order_id int, customer_id int, order_date date, status string, total_amount int",
    )
    people = spark.createDataFrame([(i, "e", "c") for i in range(1, 5)], "customer_id int, email string, acquisition_channel string")
    got = {r.customer_id: (r.ltv_segment, r.total_orders, r.days_since_last_order) for r in
           sales.customer_ltv(people, orders, dt.date(2001, 1, 11)).collect()}
    assert got == {1: ("platinum", 1, 10), 2: ("gold", 1, 10), 3: ("bronze", 1, 10)}


def test_stream_loads_only_new_files(spark):
    base = new_path(spark, "stream-test")
    schema = "id bigint, ts timestamp_ntz"

    def arrive(first, last):
        spark.range(first, last).selectExpr("id", "timestamp_ntz'2024-01-01' AS ts").write.mode("append").parquet(f"{base}/in")

    def load():
        load_new_files(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/cp")
        return sorted(r.id for r in spark.read.schema(schema).parquet(f"{base}/out").collect())

    arrive(0, 5)
    assert load() == list(range(5))
    assert load() == list(range(5))
    arrive(5, 8)
    assert load() == list(range(8))

