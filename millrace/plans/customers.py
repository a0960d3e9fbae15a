"""Customer flow: transactions → per-customer totals → summary → high-value customers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.flow import compose
from millrace.plans.warehouse import AS_OF, moment, raw_customers, raw_transactions


def customer_txn(transactions: DataFrame, as_of: dt.date = AS_OF, days: int = 365) -> DataFrame:
    recent = transactions.where(F.col("txn_date") >= moment(as_of - dt.timedelta(days=days)))
    return recent.groupBy("customer_id").agg(
        F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("txn_count")
    )


def customer_summary(txn: DataFrame, customers: DataFrame, floor: int = 100) -> DataFrame:
    kept = txn.where(F.col("total_amount") > floor)
    return kept.join(customers, "customer_id").select("customer_id", "name", "segment", "total_amount", "txn_count")


def high_value_customers(summary: DataFrame, floor: int = 500_000) -> DataFrame:
    return summary.where(F.col("total_amount") > floor).select("customer_id", "name", "total_amount")


def customer_flow(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All three tables; totals are shown as doubles by :func:`shown`."""
    return compose(
        {"raw.transactions": raw_transactions(spark, folder), "raw.customers": raw_customers(spark, folder)},
        {
            "mart.high_value_customers": (["mart.customer_summary"], high_value_customers),
            "mart.customer_summary": (["staging.customer_txn", "raw.customers"], customer_summary),
            "staging.customer_txn": (["raw.transactions"], customer_txn),
        },
    )


def shown(df: DataFrame) -> DataFrame:
    """Decimal columns as doubles for reports; sums stay exact until here."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)
            for f in df.schema.fields
        ]
    )
