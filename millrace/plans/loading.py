"""Load patterns applied to the business tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import loads
from millrace.operators.staging import new_path, stage
from millrace.operators.upsert import merge, upsert
from millrace.plans import sales
from millrace.plans.warehouse import AS_OF, MONEY, moment, raw_accounts, raw_customers, raw_orders
from millrace.sources.partitioned import PartitionedTable
from millrace.sources.tables import append, create_table_as, insert_values, replace_partitions, table, truncate_load

OLD_UNTIL = dt.date(2000, 6, 30)
NEW_FROM = dt.date(2000, 1, 1)
AGAIN = dt.date(1999, 3, 1)
EVENTS_UNTIL = dt.datetime(2024, 1, 15)


def staged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return sales.stg_orders(raw_orders(spark, folder)), sales.stg_customers(raw_accounts(spark, folder))


def upsert_sales_daily(spark: SparkSession, folder: str) -> DataFrame:
    """A late re-load: days from ``NEW_FROM`` replace what the mart held up to ``OLD_UNTIL``.

    The old rows stem from a run that had booked no revenue yet.
    """
    daily = sales.sales_daily(*staged(spark, folder))
    old = daily.where(F.col("report_date") <= F.lit(OLD_UNTIL)).withColumns(
        {"total_revenue": F.lit(0.0), "avg_order_value": F.lit(0.0)}
    )
    new = daily.where(F.col("report_date") >= F.lit(NEW_FROM))
    return upsert(old, new, ["report_date"], sales.DAILY_UPDATE)


def upsert_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """The daily mart as a stored table by month: a late re-load, then a MERGE of one day that came again.

    ``since`` is the version that wrote a row's month: the changes leave the months they do not touch as they lie.
    """
    daily = stage(sales.sales_daily(*staged(spark, folder)), "daily")
    month = F.year("report_date") * 100 + F.month("report_date")
    mart = PartitionedTable(spark, new_path(spark, "daily-by-month"), daily.schema, ["report_date"], month)
    mart.create(
        daily.where(F.col("report_date") <= F.lit(OLD_UNTIL)).withColumns({"total_revenue": F.lit(0.0), "avg_order_value": F.lit(0.0)})
    )
    mart.upsert(daily.where(F.col("report_date") >= F.lit(NEW_FROM)), sales.DAILY_UPDATE)
    again = daily.where(F.col("report_date") == F.lit(AGAIN))
    mart.merge(again, {"total_orders": F.col("t.total_orders") + F.col("s.total_orders")}, None)
    written = mart.manifest().select("part", "since")
    return mart.read().withColumn("part", mart.part).join(F.broadcast(written), "part").drop("part")


def upsert_customer_ltv(spark: SparkSession, folder: str) -> DataFrame:
    """Upsert with a partial update list: known customers keep their first order date and e-mail."""
    orders, customers = staged(spark, folder)
    old = sales.customer_ltv(customers, orders.where(F.col("order_date") <= F.lit(OLD_UNTIL)), OLD_UNTIL)
    new = sales.customer_ltv(customers, orders.where(F.col("order_date") >= F.lit(NEW_FROM)))
    return upsert(old, new, ["customer_id"], sales.LTV_UPDATE)


def merge_balances(spark: SparkSession, folder: str) -> DataFrame:
    """MERGE: orders are charged to known accounts and open new ones for the other customers."""
    accounts = table(spark, folder, "customer").where(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"),
        F.lit("known").alias("origin"),
    )
    charges = (
        table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("charge"))
    )
    merged = merge(
        accounts, charges, ["customer_id"],
        matched={"balance": F.col("t.balance") - F.col("s.charge")},
        not_matched={"customer_id": F.col("s.customer_id"), "balance": -F.col("s.charge"), "origin": F.lit("new")},
    )
    return merged.withColumn("balance", F.col("balance").cast("double"))


def incremental_events(spark: SparkSession, folder: str) -> DataFrame:
    """Append the events newer than the newest stored one."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    stored = events.where(F.col("ts") < moment(EVENTS_UNTIL)).withColumn("load", F.lit("first"))
    return loads.incremental(stored, events.withColumn("load", F.lit("second")), "ts")


def replace_vs_insert(spark: SparkSession, folder: str) -> DataFrame:
    """CREATE TABLE AS, INSERT … SELECT and CREATE OR REPLACE on written tables, with the customers of all segments."""
    customers = raw_customers(spark, folder).drop("nation_id")
    path = new_path(spark, "segments")
    late = F.coalesce(F.col("segment"), F.lit("")) >= "FURNITURE"
    create_table_as(customers.where(~late), f"{path}/appended")
    append(customers.where(late), f"{path}/appended")
    create_table_as(customers.where(~late), f"{path}/replaced")
    create_table_as(customers.where(late), f"{path}/replaced", replace=True)

    def read(name: str) -> DataFrame:
        return spark.read.schema(customers.schema).parquet(f"{path}/{name}").withColumn("target", F.lit(name))

    return read("appended").unionByName(read("replaced"))


def truncate_load_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Full refresh of the order table by year, then a refresh of the partitions of one run only."""
    orders = sales.stg_orders(raw_orders(spark, folder)).select(
        "order_id", "status", "order_date", F.year("order_date").alias("order_year")
    )
    path = new_path(spark, "orders-by-year")
    truncate_load(orders, path, ["order_year"])
    rerun = orders.where(F.col("order_date") >= F.lit(NEW_FROM)).withColumn("status", F.lit("R"))
    replace_partitions(rerun, path, ["order_year"])
    schema = "order_id bigint, status string, order_date date, order_year int"
    back = spark.read.schema(schema).parquet(path)
    return back.withColumn("order_year", F.col("order_year").cast("bigint"))


def insert_region(spark: SparkSession, folder: str) -> DataFrame:
    """INSERT INTO region VALUES (…)."""
    return insert_values(table(spark, folder, "region"), [(90, "ARCTIC"), (91, "ANTARCTIC")])


def row_count_gate(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = staged(spark, folder)
    return loads.require_rows({"staging.stg_orders": orders, "staging.stg_customers": customers})


def stored_policies(spark: SparkSession, folder: str) -> DataFrame:
    """One model published under each materialisation policy, the incremental one in two runs."""
    events = table(spark, folder, "events").select("event_id", "ts", "event_type")
    early = events.where(F.col("ts") < moment(EVENTS_UNTIL))
    path = new_path(spark, "policies")

    def publish(policy: str) -> DataFrame:
        where = f"{path}/{policy}"
        if policy == "incremental":
            loads.materialize(spark, f"events_{policy}", lambda: early, policy, "ts", where)
        df = loads.materialize(spark, f"events_{policy}", lambda: events, policy, "ts", where)
        return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("events")).withColumn("policy", F.lit(policy))

    out = publish(loads.POLICIES[0])
    for policy in loads.POLICIES[1:]:
        out = out.unionByName(publish(policy))
    return out


def stg_orders_window(spark: SparkSession, folder: str) -> DataFrame:
    return sales.stg_orders(raw_orders(spark, folder), AS_OF, lookback_days=365)


def sales_daily_for(spark: SparkSession, folder: str) -> DataFrame:
    """The single-day run of the daily mart: the day filter reaches the scan of the orders."""
    ds = dt.date(1999, 3, 1)
    raw = raw_orders(spark, folder).where(
        (F.col("order_date") >= moment(ds)) & (F.col("order_date") < moment(ds + dt.timedelta(days=1)))
    )
    return sales.sales_daily(sales.stg_orders(raw), sales.stg_customers(raw_accounts(spark, folder)), ds)
