"""Incremental loads, row-count gates and table materialisation policies."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import append, create_table_as, table_exists

POLICIES = ("view", "table", "incremental", "ephemeral")


def newer_than(source: DataFrame, target: DataFrame, ts: str) -> DataFrame:
    """Rows of ``source`` past ``SELECT MAX(ts) FROM target``; the comparison reaches the scan of the source."""
    return source.where(F.col(ts) > target.select(F.max(ts)).scalar())


def incremental(target: DataFrame | None, source: DataFrame, ts: str) -> DataFrame:
    """The target after an incremental load; a missing or empty target gets a full load."""
    if target is None or target.isEmpty():
        return source
    return target.unionByName(newer_than(source, target, ts))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One ``(table, row_count, ok)`` row per staged table; ``ok`` is false for an empty one."""
    counts = [
        df.groupBy().agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).withColumn("ok", F.col("row_count") > 0)


def require_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The count table, with an error raised while it is read when any staged table is empty."""
    message = F.concat(F.lit("row count validation failed for "), F.col("table"))
    return row_counts(tables).withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(message)))


def materialize(
    spark: SparkSession, name: str, build: Callable[[], DataFrame], policy: str = "view", ts: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """Publish a model under its policy; unknown policies act as ``view``.

    ``incremental`` appends the rows newer than the stored ones, and loads all on the first run.
    """
    df = build()
    if policy == "ephemeral":
        return df
    if policy in ("table", "incremental"):
        if path is None:
            raise ValueError("a stored model needs a path")
        if policy == "incremental" and table_exists(spark, path):
            stored = spark.read.schema(df.schema).parquet(path)
            append(newer_than(df, stored, ts) if ts and not stored.isEmpty() else df, path)
        else:
            create_table_as(df, path, replace=True)
        df = spark.read.schema(df.schema).parquet(path)
    df.createOrReplaceTempView(name)
    return df


def materialization_rule(has_aggregate: bool, has_window: bool) -> str:
    """Policy given to a compiled model: stored when it aggregates or ranks, else a view."""
    return "table" if has_aggregate or has_window else "view"
