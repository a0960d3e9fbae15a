"""Monthly revenue by segment and region, a chain of three common table expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.warehouse import moment, raw_customers, raw_orders
from millrace.sources.tables import table


def monthly_revenue(spark: SparkSession, folder: str, since: dt.date = dt.date(1996, 1, 1)) -> DataFrame:
    """Orders shrink to (month, customer) before they meet the customer dimension.

    The geography tables are joined without a hint: Spark broadcasts them by their measured size.
    """
    raw = raw_orders(spark, folder).where(F.col("order_date") >= moment(since))
    per_customer = raw.groupBy(
        F.trunc(F.col("order_date").cast("date"), "month").alias("month"), "customer_id"
    ).agg(F.sum("total_amount").alias("amount"), F.count("order_id").alias("orders"))
    region = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = raw_customers(spark, folder).join(region, F.col("nation_id") == F.col("n_nationkey"))
    enriched = per_customer.join(customers, "customer_id")
    monthly = enriched.groupBy("month", "segment", F.col("r_name").alias("region")).agg(
        F.sum("amount").cast("double").alias("revenue"),
        F.count("customer_id").alias("unique_customers"),
        F.sum("orders").alias("order_count"),
    )
    return monthly.withColumn(
        "revenue_per_customer", F.col("revenue") / F.nullif(F.col("unique_customers"), F.lit(0))
    ).orderBy(F.col("month").desc())
