"""Dependencies between the statements of all scripts, through the tables that they share.

A mart that every script writes and reads would give as many edges as writers times readers. ``edges`` links
each read to one writer only, the last before it in the order of (script, statement), and ``downstream`` walks
from table to table, so both stay as large as the reads and writes are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import graph, scan
from millrace.operators.staging import stage


def uses(statements: DataFrame) -> DataFrame:
    """``(table, script_id, stmt_no, writes)``: one row per table that a statement reads, and one if it writes one."""
    reads = statements.select(F.explode("source_tables").alias("table"), "script_id", "stmt_no", F.lit(0).alias("writes"))
    written = statements.where("target_table IS NOT NULL").select(
        F.col("target_table").alias("table"), "script_id", "stmt_no", F.lit(1).alias("writes")
    )
    return reads.unionByName(written)


def edges(statements: DataFrame) -> DataFrame:
    """``(src_script, src_stmt, dst_script, dst_stmt, via_table)``: each read and the last write of its table before it.

    An as-of join without a window over a table: uses are numbered in order within range partitions, by how
    many writes of the table came so far, so that a table with a third of all uses spreads over many tasks.
    A read then equals its write in (table, number). A statement reads before it writes.
    """
    order = [F.col("script_id"), F.col("stmt_no"), F.col("writes")]
    numbered = stage(scan.running_sum(uses(statements), ["table"], order, {"version": F.col("writes")}), "uses")
    write = numbered.where("writes = 1").select(
        "table", "version", F.col("script_id").alias("src_script"), F.col("stmt_no").alias("src_stmt")
    )
    read = numbered.where("writes = 0 AND version > 0")
    return read.join(write, ["table", "version"]).select(
        "src_script", "src_stmt", F.col("script_id").alias("dst_script"), F.col("stmt_no").alias("dst_stmt"),
        F.col("table").alias("via_table"),
    )


def downstream(statements: DataFrame, tables: DataFrame) -> DataFrame:
    """``(table, depends)``: the tables that ``tables`` (table) lead to, in any script and over any number of steps.

    Marts that many scripts write and many read are hubs: no pairs of their writers and readers are made.
    """
    links = edges_between_tables(statements)
    starts = tables.select(F.col("table").alias("origin"), F.col("table").alias("node")).distinct()
    reached = graph.spread(starts, links, [], ["origin"]).where("origin <> node")
    return reached.select(F.col("origin").alias("table"), F.col("node").alias("depends"))


def edges_between_tables(statements: DataFrame) -> DataFrame:
    """``(src, dst)``: the distinct tables that some statement reads to write another."""
    pairs = statements.where("target_table IS NOT NULL").select(F.explode("source_tables").alias("src"), F.col("target_table").alias("dst"))
    return pairs.where("src <> dst").distinct()
