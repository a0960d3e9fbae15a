"""Lineage graph of each script: typed nodes, edges, degrees and the export tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import sqltext as sql
from millrace.plans.impact import latest, model_reads, task_reads
from millrace.plans.models import MART_SCHEMAS

TASK_SNIPPET = 200


def edges(digest: DataFrame, tasks: DataFrame) -> DataFrame:
    """Distinct ``(script_id, source, target)``: read table → reader, and node → task that reads it."""
    reads = model_reads(digest).select("script_id", "source", F.col("reader").alias("target")).distinct()
    known = (
        digest.select("script_id", F.col("name").alias("source"))
        .unionByName(reads.select("script_id", "source")).distinct()
    )
    to_task = task_reads(tasks, digest).select("script_id", F.col("node").alias("source"), F.col("task_id").alias("target"))
    return reads.unionByName(to_task.join(known, ["script_id", "source"], "left_semi")).distinct()


def nodes(digest: DataFrame, tasks: DataFrame) -> DataFrame:
    """``(script_id, id, label, node_type, snippet, column_count)``; a definition beats a reference."""
    schema = F.substring_index("name", ".", 1)
    is_mart = F.col("is_final") & F.col("name").contains(".") & schema.isin(*MART_SCHEMAS)
    defined = latest(digest, "is_final", "snippet", "column_count").select(
        "script_id", F.col("name").alias("id"),
        F.when(is_mart, "dbt_model").otherwise("cte").alias("node_type"), "snippet", "column_count",
    )
    named = model_reads(digest).select("script_id", F.col("source").alias("id")).distinct()
    referenced = named.join(defined, ["script_id", "id"], "left_anti").select(
        "script_id", "id", F.when(F.col("id").contains("."), "table").otherwise("cte").alias("node_type"),
        F.concat(F.lit("Referenced as: "), "id").alias("snippet"), F.lit(0).cast("bigint").alias("column_count"),
    )
    task_nodes = tasks.select(
        "script_id", F.col("task_id").alias("id"), F.lit("dag_task").alias("node_type"),
        F.substring("raw_sql", 1, TASK_SNIPPET).alias("snippet"), F.lit(0).cast("bigint").alias("column_count"), "label",
    )
    return defined.unionByName(referenced).withColumn("label", sql.last_part(F.col("id"))).unionByName(task_nodes)


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Upstream and downstream lists and degrees of each node."""
    up = edges.groupBy("script_id", F.col("target").alias("id")).agg(F.sort_array(F.collect_set("source")).alias("up"))
    down = edges.groupBy("script_id", F.col("source").alias("id")).agg(F.sort_array(F.collect_set("target")).alias("dn"))
    none = F.array().cast("array<string>")
    return (
        nodes.select("script_id", "id").join(up, ["script_id", "id"], "left").join(down, ["script_id", "id"], "left")
        .select(
            "script_id", "id", F.coalesce("up", none).alias("upstream"), F.coalesce("dn", none).alias("downstream")
        )
        .withColumns({
            "in_degree": F.size("upstream").cast("bigint"), "out_degree": F.size("downstream").cast("bigint"),
        })
    )


def export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables in the shape of the JSON sink."""
    node = nodes.select("script_id", "id", "label", "node_type", "column_count", "snippet")
    return node, edges.select("script_id", "source", "target")
