"""Statement catalogue of a script corpus: one narrow projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import sqltext as sql


def statements(scripts: DataFrame, blocks: str = "drop") -> DataFrame:
    """One row per non-empty statement with its nine catalogue fields, and the veiled text for later stages.

    ``has_where``, ``has_group_by`` and all names come from comment-free text with literals veiled.
    """
    parts = F.split(sql.drop_blocks(sql.veil(F.col("sql_text")), blocks), ";").alias("parts")
    ended = F.transform("parts", lambda p, i: F.struct(p.alias("text"), (i < F.size("parts") - 1).alias("ended")))
    present = F.filter(ended, lambda x: sql.strip(sql.cut_comments(x["text"])) != "")
    split = (
        scripts.select("script_id", parts)
        .select("script_id", F.posexplode(present).alias("stmt_no", "part"))
        .select("script_id", "stmt_no", "part", sql.strip(sql.cut_comments(F.col("part.text"))).alias("veiled"))
    )
    typed = split.withColumn("statement_type", sql.statement_type(F.col("veiled"))).withColumn(
        "target_table", sql.target_table(F.col("veiled"), F.col("statement_type"))
    )
    terminator = F.when(F.col("part.ended"), ";").otherwise("")
    return typed.select(
        "script_id",
        "stmt_no",
        F.concat(F.lit("stmt_"), F.col("stmt_no").cast("string")).alias("stmt_id"),
        sql.strip(F.concat(sql.unveil(F.col("part.text")), terminator)).alias("raw_sql"),
        sql.unveil(F.col("veiled")).alias("clean_sql"),
        "statement_type",
        "target_table",
        sql.source_tables(F.col("veiled"), F.col("target_table")).alias("source_tables"),
        F.col("veiled").rlike(r"(?i)\bWHERE\b").alias("has_where"),
        F.col("veiled").rlike(r"(?i)\bGROUP\s+BY\b").alias("has_group_by"),
        sql.aggregations(F.col("veiled")).alias("aggregations"),
        sql.task_label(F.col("statement_type"), F.col("target_table"), F.col("stmt_no")).alias("label"),
        "veiled",
    )


def rejected(scripts: DataFrame) -> DataFrame:
    """Scripts that yield no statements, with the reason; the rest of the corpus goes on."""
    text = sql.strip(F.regexp_replace(sql.cut_comments(sql.drop_blocks(sql.veil(F.col("sql_text")))), ";", " "))
    reason = F.when(text == "", "no statements")
    return scripts.select("script_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def rejected_labels(statements: DataFrame) -> DataFrame:
    """Labels that are not safe as task ids, with the sanitised form that is used instead."""
    return statements.where(~F.col("label").rlike(sql.SAFE_IDENTIFIER)).select(
        "script_id", "stmt_no", "label", sql.safe_label(F.col("label")).alias("task_id")
    )


def normalised(scripts: DataFrame) -> DataFrame:
    return scripts.select("script_id", sql.normalise(F.col("sql_text")).alias("clean_text"))


def tables_touched(statements: DataFrame) -> DataFrame:
    """Distinct ``(script_id, table, role)`` rows."""
    reads = statements.select("script_id", F.explode("source_tables").alias("table"), F.lit("read").alias("role"))
    writes = statements.where(F.col("target_table").isNotNull()).select(
        "script_id", F.col("target_table").alias("table"), F.lit("write").alias("role")
    )
    return reads.unionByName(writes).distinct()


def type_rollup(statements: DataFrame) -> DataFrame:
    """Statements, scripts and filtered statements per statement type."""
    return statements.groupBy("statement_type").agg(
        F.count(F.lit(1)).alias("statements"),
        F.count_distinct("script_id").alias("scripts"),
        F.count(F.when(F.col("has_where"), 1)).alias("filtered"),
        F.count(F.when(F.col("has_group_by"), 1)).alias("grouped"),
    )


def most_read(statements: DataFrame, n: int | None = None) -> DataFrame:
    """All tables by how many statements read them, ties by name; the first ``n`` of them if asked for."""
    reads = statements.select(F.explode("source_tables").alias("table")).groupBy("table")
    ordered = reads.agg(F.count(F.lit(1)).alias("readers")).orderBy(F.col("readers").desc(), "table")
    return ordered if n is None else ordered.limit(n)


def checksums(scripts: DataFrame) -> DataFrame:
    return scripts.select("script_id", F.sha2("sql_text", 256).alias("checksum"))


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scripts added, removed or changed between two corpus snapshots; only checksums are shuffled."""
    o, n = checksums(old).alias("o"), checksums(new).alias("n")
    change = (
        F.when(F.col("o.script_id").isNull(), "added")
        .when(F.col("n.script_id").isNull(), "removed")
        .when(F.col("o.checksum") != F.col("n.checksum"), "changed")
    )
    joined = o.join(n, F.col("o.script_id") == F.col("n.script_id"), "full_outer").select(
        F.coalesce("o.script_id", "n.script_id").alias("script_id"), change.alias("change"),
        F.col("o.checksum").alias("old_checksum"), F.col("n.checksum").alias("new_checksum"),
    )
    return joined.where(F.col("change").isNotNull())
