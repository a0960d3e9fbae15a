"""Sales mart: staged orders and customers, daily sales, customer lifetime value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.warehouse import AS_OF, moment

# Lifetime-value tiers, highest first.
LTV_TIERS = ((4_000_000, "platinum"), (2_000_000, "gold"), (1_000_000, "silver"))
LTV_FLOOR = "bronze"
NOT_COUNTED = ("P",)


def stg_orders(orders: DataFrame, ds: dt.date = AS_OF, lookback_days: int | None = None) -> DataFrame:
    """Cleaned orders of the days up to ``ds``; without a look-back, all of them."""
    if lookback_days is not None:
        orders = orders.where(F.col("order_date") >= moment(ds - dt.timedelta(days=lookback_days)))
    return orders.where(F.col("order_id").isNotNull()).select(
        "order_id",
        "customer_id",
        F.col("order_date").cast("date").alias("order_date"),
        F.upper(F.trim("status")).alias("status"),
        F.coalesce("total_amount", F.lit(0)).cast("decimal(15,2)").alias("total_amount"),
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        moment(ds).alias("processed_at"),
    )


def stg_customers(accounts: DataFrame, ds: dt.date = AS_OF) -> DataFrame:
    return accounts.where(F.col("customer_id").isNotNull() & F.col("email").isNotNull()).select(
        "customer_id",
        F.lower(F.trim("email")).alias("email"),
        F.trim(F.concat("first_name", F.lit(" "), "last_name")).alias("full_name"),
        F.coalesce("acquisition_channel", F.lit("unknown")).alias("acquisition_channel"),
        F.col("signup_date").cast("date").alias("signup_date"),
        moment(ds).alias("processed_at"),
    )


def sales_daily(orders: DataFrame, customers: DataFrame, ds: dt.date | None = None) -> DataFrame:
    """Daily totals, for one partition day or for all days.

    Orders shrink to one row per (day, customer) before the join, so a customer with very many
    orders brings at most one row per day to it. ``customer_id`` is the key of ``customers``.
    """
    if ds is not None:
        orders = orders.where(F.col("order_date") == F.lit(ds))
    per_customer = orders.groupBy("order_date", "customer_id").agg(
        F.sum("total_amount").alias("revenue"), F.count("total_amount").alias("valued")
    )
    signup = customers.select("customer_id", "signup_date")
    days = (
        per_customer.join(signup, "customer_id", "left")
        .groupBy("order_date")
        .agg(
            F.sum("revenue").alias("total_revenue"),
            F.sum("valued").alias("valued"),
            F.count("customer_id").alias("unique_customers"),
            F.count(F.when(F.col("signup_date") == F.col("order_date"), F.col("customer_id"))).alias("new_customers"),
            F.count(F.when(F.col("signup_date") < F.col("order_date"), F.col("customer_id"))).alias(
                "returning_customers"
            ),
        )
    )
    order_counts = orders.groupBy("order_date").agg(F.count_distinct("order_id").alias("total_orders"))
    return days.join(order_counts, "order_date").select(
        F.col("order_date").alias("report_date"),
        "total_orders",
        F.col("total_revenue").cast("double").alias("total_revenue"),
        (F.col("total_revenue").cast("double") / F.col("valued")).alias("avg_order_value"),
        "unique_customers",
        "new_customers",
        "returning_customers",
    )


def customer_ltv(customers: DataFrame, orders: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Lifetime value per customer; orders are aggregated by customer before the join."""
    counted = orders.where(~F.col("status").isin(*NOT_COUNTED))
    totals = counted.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("total_amount").alias("revenue"),
        F.count("total_amount").alias("valued"),
    )
    segment = F.when(F.col("revenue") >= LTV_TIERS[0][0], LTV_TIERS[0][1])
    for bound, name in LTV_TIERS[1:]:
        segment = segment.when(F.col("revenue") >= bound, name)
    return customers.join(totals, "customer_id").select(
        "customer_id",
        "email",
        "acquisition_channel",
        "first_order_date",
        "last_order_date",
        "total_orders",
        F.col("revenue").cast("double").alias("total_revenue"),
        (F.col("revenue").cast("double") / F.col("valued")).alias("avg_order_value"),
        F.datediff(F.lit(as_of), "last_order_date").cast("bigint").alias("days_since_last_order"),
        segment.otherwise(LTV_FLOOR).alias("ltv_segment"),
        moment(as_of).alias("updated_at"),
    )


DAILY_UPDATE = (
    "total_orders", "total_revenue", "avg_order_value", "unique_customers", "new_customers", "returning_customers",
)
LTV_UPDATE = (
    "last_order_date", "total_orders", "total_revenue", "avg_order_value", "days_since_last_order", "ltv_segment",
    "updated_at",
)
