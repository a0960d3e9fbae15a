"""Recursive queries: hierarchies by doubling walks, any other step as a frontier join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.operators.staging import Rounds, stage


def recursive_union(
    anchor: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int | None = None, distinct: bool = False
) -> DataFrame:
    """``WITH RECURSIVE r AS (anchor UNION ALL step(r))``: every round sees only the rows of the last.

    Unlike the built-in recursive CTE there is no row or level limit, and each round is a written table.
    It ends when a round is empty. ``distinct`` is the plain ``UNION``: a row counts once, so that a cycle ends
    by itself; otherwise ``max_rounds`` is for data that may hold one. A step that walks a hierarchy is better
    written as ``connect_by``, which takes rounds by the logarithm of the depth.
    """
    columns = anchor.columns
    rounds = Rounds(anchor.sparkSession, "recursion")
    fresh = rounds.add(anchor.distinct() if distinct else anchor)
    while fresh:
        if max_rounds is not None and rounds.count > max_rounds:
            raise RuntimeError(f"no end within {max_rounds} rounds; the data may hold a cycle")
        more = step(rounds.last()).select(*columns)
        # An intersection of all columns rather than a join, as NULLs are equal here.
        fresh = rounds.add(more.distinct().subtract(rounds.all()) if distinct else more)
    return rounds.all()


def connect_by(
    nodes: DataFrame, node: str, parent: str, start_with: Column | None = None, level: str = "level",
    path: tuple[str, Column, str] | None = None,
) -> DataFrame:
    """``START WITH … CONNECT BY PRIOR node = parent`` with the ``LEVEL`` pseudo-column.

    By default the walk starts at rows whose parent is NULL. ``path`` (name, text, separator) adds the texts
    of all rows from the start on, as ``SYS_CONNECT_BY_PATH`` does. Rounds grow with the logarithm of the
    depth. A cycle that a start leads to is an error, found in as few rounds; ``hierarchy`` marks it.
    """
    text = path[1].cast("string") if path else F.lit("")
    rows = stage(nodes.withColumns({"__row": F.monotonically_increasing_id(), "__text": text}), "hierarchy")
    starts = rows.where(F.col(parent).isNull() if start_with is None else start_with)
    step = F.concat(F.lit(path[2] if path else ""), F.col("__text"))
    below = rows.select(F.col(parent).alias("__prior"), F.col("__row").alias("dst"), step.alias("__path"))
    arcs = rows.select(F.col(node).alias("__prior"), F.col("__row").alias("src")).join(below, "__prior")
    names = ["__path"] if path else []
    found = graph.walks(starts.select(F.col("__row").alias("node"), F.col("__text").alias("__path")), arcs, [], path=names)
    placed = found.select(F.col("node").alias("__row"), (F.col("steps") + 1).cast("int").alias(level), *[F.col(n).alias(path[0]) for n in names])
    return rows.join(placed, "__row").select(*nodes.columns, level, *([path[0]] if path else []))


def hierarchy(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Every row of ``nodes`` with its ``root``, its ``level`` and whether it is ``on_cycle``.

    A root is a row without a parent or whose parent is no row here, at level 1. Rows on or behind a cycle have
    neither root nor level. ``node`` has to be unique where it is not NULL; a row without one is its own root
    and no parent. By pointer jumping: each row points to its parent first, then to where that points.
    """
    rows = stage(nodes.withColumn("__row", F.monotonically_increasing_id()), "hierarchy")
    named = rows.where(F.col(node).isNotNull()).select(F.col(node).alias("__parent"), F.col("__row").alias("__up"))
    first = rows.select("__row", F.col(parent).alias("__parent")).join(named, "__parent", "left")
    open_ = F.col("__up").isNotNull()
    state, n = graph.written(
        first.select("__row", "__up", F.when(open_, F.col("__up")).otherwise(F.col("__row")).alias("__top"), F.when(open_, 1).otherwise(0).cast("bigint").alias("__above")),
        "pointers", open=open_,
    )
    length, most = 1, None
    while n["open"]:
        if length >= graph.SHORT:
            most = rows.count() if most is None else most
            if length >= most:
                break
        upper = state.select(F.col("__row").alias("__up"), F.col("__up").alias("__up2"), F.col("__top").alias("__top2"), F.col("__above").alias("__above2"))
        joined = state.where(open_).join(upper, "__up").select(
            "__row", F.col("__up2").alias("__up"), F.col("__top2").alias("__top"), (F.col("__above") + F.col("__above2")).alias("__above")
        )
        state, n = graph.written(joined.unionByName(state.where(~open_)), "pointers", open=open_)
        length *= 2
    # After as many steps as there are rows, what still has a way up is on a cycle or behind one, and points to one.
    cyclic = state.where(open_).select(F.col("__up").alias("__row")).distinct().withColumn("__on", F.lit(True))
    roots = rows.select(F.col("__row").alias("__top"), F.col(node).alias("root"))
    placed = state.join(roots, "__top").join(cyclic, "__row", "left").select(
        "__row", F.when(~open_, F.col("root")).alias("root"),
        F.when(~open_, F.col("__above") + 1).alias("level"), F.coalesce("__on", F.lit(False)).alias("on_cycle"),
    )
    return rows.join(placed.withColumn("__open", F.col("level").isNull()), "__row").select(*nodes.columns, "root", "level", "on_cycle")
