"""CROSS APPLY and OUTER APPLY with a top-n body."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key.

    The rank filter lets Spark cut every key to ``n`` rows in each map task before the shuffle,
    so a hot key sends at most ``n`` rows per task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).withColumnRenamed("__place", "place")


def apply_top_n(
    outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, order: Sequence[Column], n: int,
    keep_unmatched: bool = False,
) -> DataFrame:
    """``outer CROSS|OUTER APPLY (SELECT … FROM inner WHERE inner_key = outer_key ORDER BY … LIMIT n)``."""
    best = top_n_per_key(inner, [inner_key], order, n)
    how = "left" if keep_unmatched else "inner"
    return outer.join(best, F.col(outer_key) == F.col(inner_key), how).drop(inner_key)
