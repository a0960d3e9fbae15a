"""Dependencies between the statements of each script."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import sqltext as sql
from millrace.operators import graph


def producers(statements: DataFrame) -> DataFrame:
    """The statement that writes each table; the last writer wins."""
    written = statements.where("target_table IS NOT NULL")
    return written.groupBy("script_id", F.col("target_table").alias("table")).agg(F.max("stmt_no").alias("src"))


def _reads(statements: DataFrame) -> DataFrame:
    return statements.select("script_id", F.col("stmt_no").alias("dst"), F.explode("source_tables").alias("table"))


def edges(statements: DataFrame, mode: str = "last_writer") -> DataFrame:
    """``(script_id, src, dst, via_table)``; no statement depends on itself.

    ``last_writer`` links every reader to the last writer of the table wherever it stands;
    ``nearest_prior`` links it to the closest writer before it, found in one ordered pass.
    """
    if mode == "last_writer":
        linked = _reads(statements).join(producers(statements), ["script_id", "table"])
    elif mode == "nearest_prior":
        writes = statements.where("target_table IS NOT NULL").select(
            "script_id", F.col("stmt_no").alias("dst"), F.col("target_table").alias("table"), F.lit(True).alias("writes")
        )
        both = _reads(statements).withColumn("writes", F.lit(False)).unionByName(writes)
        earlier = (
            Window.partitionBy("script_id", "table").orderBy("dst", "writes")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        linked = both.withColumn("src", F.last(F.when(F.col("writes"), F.col("dst")), True).over(earlier)).where(
            "NOT writes AND src IS NOT NULL"
        )
    else:
        raise ValueError(f"unknown edge mode {mode!r}")
    return linked.where("src <> dst").select("script_id", "src", "dst", F.col("table").alias("via_table")).distinct()


def predecessors(edges: DataFrame) -> DataFrame:
    return edges.groupBy("script_id", F.col("dst").alias("stmt_no")).agg(
        F.sort_array(F.collect_set("src")).alias("predecessors")
    )


def levels(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """``(script_id, stmt_no, level)``; the level is NULL on and behind a cycle."""
    nodes = statements.select("script_id", F.col("stmt_no").alias("node"))
    return graph.levels(nodes, edges, ["script_id"]).withColumnRenamed("node", "stmt_no")


def cycles(edges: DataFrame) -> DataFrame:
    """``(script_id, stmt_no, component)``: the statements on a cycle; equal components depend on each other.

    Statements that only wait behind a cycle are not listed, though no order can place them either.
    """
    return graph.components(edges, ["script_id"]).withColumnRenamed("node", "stmt_no")


def dependency_labels(statements: DataFrame, edges: DataFrame, levels: DataFrame) -> DataFrame:
    """Distinct ``(upstream, downstream)`` task labels with the earliest place of the downstream task."""
    named = statements.select("script_id", "stmt_no", sql.safe_label(F.col("label")).alias("label"))
    up = named.select("script_id", F.col("stmt_no").alias("src"), F.col("label").alias("upstream"))
    down = named.join(levels, ["script_id", "stmt_no"]).select(
        "script_id", F.col("stmt_no").alias("dst"), F.col("label").alias("downstream"), "level"
    )
    linked = edges.join(up, ["script_id", "src"]).join(down, ["script_id", "dst"])
    return linked.groupBy("script_id", "upstream", "downstream").agg(F.min("level").alias("level"))
