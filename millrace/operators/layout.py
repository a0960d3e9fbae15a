"""Partitioning of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_script(df: DataFrame) -> DataFrame:
    """Spread a corpus over the cluster by script; a fixed count keeps AQE from merging the partitions
    by their size, which is far smaller than the work they expand to."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "script_id")
