"""Queries of the remaining pipeline shapes: sets, windows, pivots, subqueries, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import scan
from millrace.operators.apply import apply_top_n
from millrace.operators.recursion import connect_by, hierarchy
from millrace.plans.warehouse import MONEY, employees, raw_customers
from millrace.sources.tables import table


def all_events(spark: SparkSession, folder: str) -> DataFrame:
    """UNION ALL of the click and view feeds, each tagged with a constant column."""
    events = table(spark, folder, "events")

    def feed(kind: str) -> DataFrame:
        return events.where(F.col("event_type") == kind).select("event_id", "user_id", F.lit(kind).alias("event_type"))

    return feed("click").unionByName(feed("view"))


def rank_customers(spark: SparkSession, folder: str) -> DataFrame:
    spend = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("total_amount"))
    )
    ranked = scan.rank(spend, [], "total_amount", "rank_by_spend")
    return ranked.withColumn("total_amount", F.col("total_amount").cast("double"))


def rank_in_segment(spark: SparkSession, folder: str) -> DataFrame:
    balances = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"),
        F.floor("c_acctbal").cast("bigint").alias("balance"),
    )
    return scan.rank(balances, ["segment"], "balance", "place", descending=False)


def row_number_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )
    return scan.row_number(orders, ["customer_id"], [F.col("order_date"), F.col("order_id")], "order_no")


def running_total(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_type", "ts", "event_id", F.col("value").cast(MONEY).alias("v"))
    summed = scan.running_sum(events, ["event_type"], [F.col("ts"), F.col("event_id")], {"running_value": F.col("v")})
    return summed.select("event_id", "event_type", F.col("running_value").cast("double").alias("running_value"))


def segment_share(spark: SparkSession, folder: str) -> DataFrame:
    """``SUM(x) OVER (PARTITION BY segment)``: the segment totals are aggregated once and joined back."""
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast(MONEY).alias("balance"),
    )
    totals = customer.groupBy("segment").agg(F.sum("balance").alias("segment_balance"))
    return customer.join(totals, "segment").select(
        "customer_id", "segment", F.col("balance").cast("double").alias("balance"),
        F.col("segment_balance").cast("double").alias("segment_balance"),
    )


def agg_family(spark: SparkSession, folder: str) -> DataFrame:
    """Every recognised aggregate per order status.

    Sums and counts combine in the map tasks. The median runs over ordered distinct values in range
    partitions, and the list is built from the distinct priorities, so no group is gathered whole.
    """
    orders = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("priority"),
    )
    value = F.col("amount").cast("double")
    basic = orders.groupBy("status").agg(
        F.sum("amount").cast("double").alias("sum_amount"),
        F.count(F.lit(1)).alias("row_count"),
        F.count("amount").alias("amount_count"),
        (F.sum("amount").cast("double") / F.count("amount")).alias("avg_amount"),
        F.min("amount").cast("double").alias("min_amount"),
        F.max("amount").cast("double").alias("max_amount"),
        F.round(F.stddev_samp(value), 2).alias("stddev_amount"),
        F.round(F.var_samp(value), 0).alias("variance_amount"),
    )
    customers = orders.groupBy("status").agg(F.count_distinct("customer_id").alias("customers"))
    priorities = (
        orders.select("status", "priority").distinct().groupBy("status")
        .agg(F.array_join(F.sort_array(F.collect_list("priority")), ",").alias("priorities"))
    )
    medians = scan.median(orders, ["status"], "amount", "median_amount").withColumn(
        "median_amount", F.round("median_amount", 3)
    )
    return basic.join(customers, "status").join(priorities, "status").join(medians, "status")


def listagg_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``LISTAGG`` of every line of an order, repeated values included."""
    flags = F.expr("listagg(l_returnflag, ',') WITHIN GROUP (ORDER BY l_linenumber, l_returnflag)")
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        flags.alias("return_flags"), F.count("l_returnflag").alias("flag_count")
    )


def pivot_status(spark: SparkSession, folder: str, statuses: tuple[str, ...] = ("F", "O", "P")) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    # A status beyond the named ones is summed up as the rest, so that no amount is lost.
    status = F.when(F.col("o_orderstatus").isin(*statuses), F.col("o_orderstatus")).otherwise("rest")
    pivoted = orders.withColumn("status", status).groupBy("year").pivot("status", [*statuses, "rest"]).agg(
        F.sum(F.col("o_totalprice").cast(MONEY))
    )
    return pivoted.select(
        F.col("year").cast("bigint").alias("year"),
        *[F.col(s).cast("double").alias(f"status_{s.lower()}") for s in (*statuses, "rest")],
    )


def unpivot_measures(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    summed = line.groupBy("l_returnflag", "l_linestatus").agg(
        *[F.sum(F.col(f"l_{m}").cast(MONEY)).alias(m) for m in ("quantity", "extendedprice", "discount", "tax")]
    )
    wide = summed.select(
        F.col("l_returnflag").alias("return_flag"), F.col("l_linestatus").alias("line_status"),
        *[F.col(m).cast("double").alias(m) for m in ("quantity", "extendedprice", "discount", "tax")],
    )
    return wide.unpivot(
        ["return_flag", "line_status"], ["quantity", "extendedprice", "discount", "tax"], "measure", "total"
    )


def _apply(spark: SparkSession, folder: str, n: int, keep_unmatched: bool) -> DataFrame:
    purchases = table(spark, folder, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount")
    )
    customers = raw_customers(spark, folder).select("customer_id", "name")
    order = [F.col("amount").desc(), F.col("order_id")]
    out = apply_top_n(customers, purchases, "customer_id", "o_custkey", order, n, keep_unmatched)
    return out.withColumn("place", F.col("place").cast("bigint"))


def cross_apply_top_orders(spark: SparkSession, folder: str) -> DataFrame:
    """CROSS APPLY: the two largest orders of each customer that has any."""
    return _apply(spark, folder, 2, False)


def outer_apply_top_order(spark: SparkSession, folder: str) -> DataFrame:
    """OUTER APPLY: the largest order of each customer, NULLs where there is none."""
    return _apply(spark, folder, 1, True)


def lateral_totals(spark: SparkSession, folder: str) -> DataFrame:
    """A correlated LATERAL aggregate; Catalyst turns it into a grouped join."""
    customer = table(spark, folder, "customer").alias("c")
    orders = table(spark, folder, "orders").where(F.col("o_custkey") == F.col("c.c_custkey").outer())
    totals = orders.select(F.count(F.lit(1)).alias("order_count"), F.max("o_totalprice").alias("largest_order"))
    return customer.lateralJoin(totals).select(
        F.col("c_custkey").alias("customer_id"), "order_count", "largest_order"
    )


def nested_subquery(spark: SparkSession, folder: str) -> DataFrame:
    """Three nested selects: line revenue → order revenue → customer revenue → segment average."""
    line = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("revenue")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    per_customer = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"))
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("revenue").cast("double").alias("revenue"))
    )


def scalar_subquery_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Orders above the average order value."""
    orders = table(spark, folder, "orders")
    amount = F.col("o_totalprice").cast(MONEY)
    mean = orders.select(F.sum(amount).cast("double") / F.count(F.lit(1))).scalar()
    return orders.where(F.col("o_totalprice") > mean).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount")
    )


def self_join_managers(spark: SparkSession, folder: str) -> DataFrame:
    """Each employee with the manager's department and whether the manager earns less."""
    staff = employees(spark, folder)
    e, m = staff.alias("e"), staff.alias("m")
    return e.join(m, F.col("e.manager_id") == F.col("m.employee_id")).select(
        F.col("e.employee_id").alias("employee_id"), F.col("m.employee_id").alias("manager_id"),
        F.col("m.dept").alias("manager_dept"), (F.col("m.salary") < F.col("e.salary")).alias("earns_more"),
    )


def hierarchy_levels(spark: SparkSession, folder: str) -> DataFrame:
    """START WITH manager_id IS NULL CONNECT BY PRIOR employee_id = manager_id."""
    walked = connect_by(employees(spark, folder), "employee_id", "manager_id")
    return walked.select("employee_id", "manager_id", F.col("level").cast("bigint").alias("level"))


def recursive_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive CTE: every employee with the chain of managers above as a path."""
    staff = employees(spark, folder).select("employee_id", "manager_id")
    walked = connect_by(staff, "employee_id", "manager_id", path=("path", F.col("employee_id"), "/"))
    return walked.select("employee_id", "path")


def hierarchy_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Each order under the one before it of the same customer: root, level and whether it is on a cycle.

    The first order of every fifth customer hangs below the last one, so that these orders form a cycle.
    """
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"))
    above = orders.groupBy("customer_id").agg(F.max("order_id").alias("last_id"))
    placed = scan.row_number(orders, ["customer_id"], [F.col("order_id")], "place")
    prior = placed.select("customer_id", (F.col("place") + 1).alias("place"), F.col("order_id").alias("prior_id"))
    chained = placed.join(prior, ["customer_id", "place"], "left").join(above, "customer_id").select(
        "order_id", F.when(F.col("prior_id").isNull() & (F.col("customer_id") % 5 == 0), F.col("last_id")).otherwise(F.col("prior_id")).alias("prior_id")
    )
    return hierarchy(chained, "order_id", "prior_id").withColumn("root", F.col("root").cast("bigint"))


def gross_margin(spark: SparkSession, folder: str) -> DataFrame:
    """Arithmetic, NULL handling and searched CASE in one projection."""
    line = table(spark, folder, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line_no"),
        F.col("l_partkey").alias("part_id"), F.col("l_shipdate").cast("date").alias("ship_date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("unit_price"),
        F.nvl(F.nullif("l_returnflag", F.lit("N")), F.lit("-")).alias("returned"),
        F.when(F.col("l_tax") > 0.05, "high").when(F.col("l_tax") > 0.02, "mid").otherwise("low").alias("tax_band"),
    )
