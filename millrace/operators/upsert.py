"""Upsert and MERGE as one full outer join on the key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_row_per_key(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail when a key occurs twice, as the statement itself does; NULL keys equal nothing, so they may.

    The aggregation is keyed like the join that follows, so both share one exchange of the source.
    """
    rest = [c for c in source.columns if c not in keys]
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    packed = source.where(whole).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*rest) if rest else F.lit(0)).alias("__row")
    )
    checked = packed.withColumn(
        "__row", F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(F.lit("two source rows for one key")))
    )
    unique = checked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
    return unique.unionByName(source.where(~whole).select(*keys, *rest))


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    matched: Mapping[str, Column] | None,
    not_matched: Mapping[str, Column] | None,
    check_unique: bool = True,
) -> DataFrame:
    """The table after ``MERGE INTO target USING source ON keys``.

    ``matched`` maps columns to update to expressions over ``t`` and ``s``; ``not_matched`` maps
    columns to insert to expressions over ``s``. Columns not named keep the old value or are NULL.
    ``None`` leaves the branch out. Rows with a NULL key never match.
    """
    if check_unique:
        source = _one_row_per_key(source, keys)
    marked_t = target.withColumn("__in_t", F.lit(True)).alias("t")
    marked_s = source.withColumn("__in_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = marked_t.join(marked_s, on, "full_outer" if not_matched is not None else "left")

    is_new = F.col("t.__in_t").isNull()
    is_match = F.col("t.__in_t").isNotNull() & F.col("s.__in_s").isNotNull()
    out = []
    for field in target.schema.fields:
        old = F.col(f"t.{field.name}")
        value = old
        if matched is not None and field.name in matched:
            value = F.when(is_match, matched[field.name]).otherwise(old)
        if not_matched is not None:
            fresh = not_matched.get(field.name, F.lit(None))
            value = F.when(is_new, fresh).otherwise(value)
        out.append(value.cast(field.dataType).alias(field.name))
    return joined.select(*out)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """The table after ``INSERT … ON CONFLICT (keys) DO UPDATE SET c = EXCLUDED.c`` for ``update``."""
    return merge(
        target,
        source,
        keys,
        matched={c: F.col(f"s.{c}") for c in update},
        not_matched={c: F.col(f"s.{c}") for c in target.columns},
    )
