"""Ordered computations that do not gather a whole group in one task.

A plain window puts every row of a partition key into one task. Here the rows are laid out in
range partitions over (keys, order), so that a hot key spreads over many of them; a window runs
inside each (range partition, key) slice, and the totals of earlier slices are added back. Within
a range partition only the first key can continue from an earlier one, so the table of carried
totals has fewer rows than there are range partitions and is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.staging import stage

_SLICE = "__slice"


def _null_safe(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Add one inclusive running total per entry of ``sums``, restarted for each key.

    ``order`` has to be a total order inside a key for the result to be repeatable.
    """
    value_cols = {name: f"__v_{name}" for name in sums}
    laid_out = (
        df.withColumns({value_cols[n]: c for n, c in sums.items()})
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn(_SLICE, F.spark_partition_id())
    )
    staged = stage(laid_out, "scan")

    totals = staged.groupBy(*keys, _SLICE).agg(*[F.sum(v).alias(f"{v}_t") for v in value_cols.values()])
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        _SLICE,
        F.count(F.lit(1)).over(earlier).alias("__before"),
        *[F.sum(f"{v}_t").over(earlier).alias(f"{v}_c") for v in value_cols.values()],
    ).where("__before > 0").drop("__before")

    inside = (
        Window.partitionBy(_SLICE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = staged.withColumns({n: F.sum(v).over(inside) for n, v in value_cols.items()})
    joined = local.join(F.broadcast(carried), _null_safe(local, carried, [*keys, _SLICE]), "left")
    kept = [local[c] for c in df.columns]
    # A slice whose values are all NULL has a NULL total; SUM skips it, and so does coalesce.
    return joined.select(
        *kept,
        *[
            F.when(local[n].isNull(), carried[f"{v}_c"])
            .otherwise(local[n] + F.coalesce(carried[f"{v}_c"], F.lit(0)))
            .alias(n)
            for n, v in value_cols.items()
        ],
    )


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)``; no keys means one global order."""
    return running_sum(df, keys, order, {out: F.lit(1).cast("bigint")})


def rank(df: DataFrame, keys: Sequence[str], value: str, out: str, descending: bool = True) -> DataFrame:
    """``RANK() OVER (PARTITION BY keys ORDER BY value)``.

    The running count is taken over the distinct values, so that ties, however many, are one row.
    """
    columns = [*keys, value]
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    placed = running_sum(counts, keys, [order], {"__upto": F.col("__n")}).select(
        *columns, (F.col("__upto") - F.col("__n") + 1).alias(out)
    )
    return df.join(placed, _null_safe(df, placed, columns)).select(*[df[c] for c in df.columns], placed[out])


def median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact ``MEDIAN(value)`` per key from the running count over distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    running = running_sum(counts, keys, [F.col(value).asc()], {"__upto": F.col("__n")})
    sizes = df.groupBy(*keys).agg(F.count(value).alias("__size"))
    low = F.floor((F.col("__size") + 1) / 2)
    high = F.floor(F.col("__size") / 2) + 1

    def covers(position: Column) -> Column:
        return (F.col("__upto") >= position) & (F.col("__upto") - F.col("__n") < position)

    joined = sizes.join(running, _null_safe(sizes, running, keys), "left").select(
        *[sizes[k] for k in keys], "__size", "__n", "__upto", F.col(value).cast("double").alias("__value")
    )
    return joined.groupBy(*keys).agg(
        (
            (F.max(F.when(covers(low), F.col("__value"))) + F.max(F.when(covers(high), F.col("__value")))) / 2
        ).alias(out)
    )
