"""Template-style models: references, sources, configuration and the project graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import sqltext as sql
from millrace.sources.tables import scripts_from_directory

# The template calls.
REF = r"""(?i)\{\{\s*ref\(\s*['"]([^'"]+)['"]\s*\)\s*\}\}"""
SOURCE = r"""(?i)\{\{\s*source\(\s*['"]([^'"]+)['"]\s*,\s*['"]([^'"]+)['"]\s*\)\s*\}\}"""
MATERIALIZED = r"""(?i)\{\{\s*config\s*\([^)]*materialized\s*=\s*['"]([^'"]+)['"][^)]*\)\s*\}\}"""
INCREMENTAL = r"(?i)\{%-?\s*if\s+is_incremental\(\)\s*-?%\}"
DEFAULT_MATERIALIZATION = "view"


def _safe():
    return F.col("name").rlike(sql.SAFE_MODEL_NAME)


def parse(models: DataFrame) -> DataFrame:
    """The model record of each accepted ``(project, name, sql_text)`` row."""
    text = F.col("sql_text")

    def pair(group: int):
        return F.regexp_extract_all(text, F.lit(SOURCE), F.lit(group))

    pairs = F.zip_with(pair(1), pair(2), lambda s, t: F.struct(s.alias("schema"), t.alias("table")))
    configured = F.lower(F.regexp_extract(text, MATERIALIZED, 1))
    return models.where(_safe()).select(
        "project",
        "name",
        F.array_distinct(F.regexp_extract_all(text, F.lit(REF), F.lit(1))).alias("deps"),
        F.array_distinct(pairs).alias("sources"),
        F.when(configured != "", configured).otherwise(DEFAULT_MATERIALIZATION).alias("materialization"),
        text.rlike(INCREMENTAL).alias("is_incremental"),
    )


def project_from_directory(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """The ``(project, name, sql_text)`` rows of all model files below ``folder``."""
    return scripts_from_directory(spark, folder).select(F.lit(project).alias("project"), "name", "sql_text")


def rejected(models: DataFrame) -> DataFrame:
    """Models with an unsafe name or of excessive size."""
    reason = F.when(~F.col("name").rlike(sql.SAFE_MODEL_NAME), "unsafe name").when(~_safe(), "too large")
    return models.select("project", "name", reason.alias("reason")).where("reason IS NOT NULL")


def edges(parsed: DataFrame) -> DataFrame:
    """``(project, src, dst)`` where both models are in the project."""
    wanted = parsed.select("project", F.explode("deps").alias("src"), F.col("name").alias("dst"))
    known = parsed.select("project", F.col("name").alias("src"))
    return wanted.join(known, ["project", "src"], "left_semi").where("src <> dst").distinct()
