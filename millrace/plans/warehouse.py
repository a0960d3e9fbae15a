"""The raw business tables, derived from the star schema the jobs are given."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import table

AS_OF = dt.date(2001, 8, 1)
MONEY = "decimal(15,2)"


def moment(day: dt.date) -> Column:
    """A day (at midnight) or a moment in the type of the stored timestamps, so that filters reach the scan.

    It goes through text: a Python datetime would pass through the session time zone.
    """
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.col("o_orderdate").alias("txn_date"),
    )


def raw_customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation_id"),
    )


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a currency that is never filled in, as the staging job expects to default it."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        F.lit(None).cast("string").alias("currency"),
    )


def raw_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Customer accounts: overdrawn ones have no e-mail, one segment has no acquisition channel."""
    first_order = (
        table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("signup_date"))
    )
    customer = table(spark, folder, "customer")
    return customer.join(first_order, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.when(
            F.col("c_acctbal") >= 0, F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.com "))
        ).alias("email"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("acquisition_channel"),
        "signup_date",
    )


def employees(spark: SparkSession, folder: str) -> DataFrame:
    """Customers seen as staff: the manager of ``n`` is ``n div 10``; number 0 has none."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("employee_id"),
        F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 10).cast("bigint")).alias("manager_id"),
        F.col("c_mktsegment").alias("dept"),
        F.col("c_acctbal").cast(MONEY).alias("salary"),
    )
