"""Column impact, rename and breaking-change answers for a whole corpus at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import sqltext as sql
from millrace.operators import graph
from millrace.operators.layout import by_script
from millrace.plans import catalog, models as model_plans

KEY = ["script_id"]


def digest(models: DataFrame) -> DataFrame:
    """What the graphs need of each named model, without its text: references, columns, a short snippet."""
    names = F.transform("items", lambda i: sql.column_name(i))
    return models.where("name IS NOT NULL").select(
        "script_id", "stmt_no", "ord", "is_final", "name",
        sql.table_refs(F.col("body")).alias("refs"),
        F.array_distinct(F.filter(names, lambda n: n.isNotNull())).alias("columns"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("column_count"),
        sql.shorten(sql.unveil(F.col("body"))).alias("snippet"),
    )


def latest(models: DataFrame, *columns: str) -> DataFrame:
    """The definition of each named model that counts, which is the last one."""
    best = models.where("name IS NOT NULL").groupBy("script_id", "name").agg(
        F.max_by(F.struct(*columns), F.struct("stmt_no", "ord")).alias("d")
    )
    return best.select("script_id", "name", "d.*")


def resolved(reads: DataFrame, digest: DataFrame) -> DataFrame:
    """``reads`` (script_id, stmt_no, reader, ref, …) with what each means, ``source``, and whether that ``is_model``.

    A reference means the model of that full name if its script defines one in the same or an earlier
    statement, else all such models but the reader whose last part it is, else the table it names.
    """
    first = digest.groupBy("script_id", "name").agg(F.min("stmt_no").alias("since"))
    keyed = first.select("script_id", "name", "since", F.explode(model_plans.reference_keys(F.col("name"))).alias("ref"))
    own = F.col("name") == F.col("ref")
    options = keyed.groupBy("script_id", "ref").agg(
        F.min(F.when(own, F.col("since"))).alias("own"),
        F.collect_list(F.when(~own, F.struct("name", "since"))).alias("others"),
    )
    others = F.filter("others", lambda o: (o["since"] <= F.col("stmt_no")) & (o["name"] != F.col("reader")))
    meant = F.when(F.col("own") <= F.col("stmt_no"), F.array("ref")).otherwise(F.transform(others, lambda o: o["name"]))
    found = reads.join(options, ["script_id", "ref"], "left").select(
        *reads.columns, F.coalesce(meant, F.array().cast("array<string>")).alias("meant")
    )
    is_model = F.size("meant") > 0
    return found.select(
        *reads.columns, is_model.alias("is_model"),
        F.explode(F.when(is_model, F.col("meant")).otherwise(F.array("ref"))).alias("source"),
    )


def model_reads(digest: DataFrame) -> DataFrame:
    """What each model reads: ``(script_id, stmt_no, reader, ref, is_model, source)``."""
    reads = digest.select("script_id", "stmt_no", F.col("name").alias("reader"), F.explode("refs").alias("ref"))
    return resolved(reads, digest)


def task_reads(tasks: DataFrame, digest: DataFrame) -> DataFrame:
    """``(script_id, task_id, node)``: the models and tables a task reads."""
    reads = tasks.select(
        "script_id", "stmt_no", F.col("target_table").alias("reader"), "task_id", F.explode("source_tables").alias("ref")
    )
    return resolved(reads, digest).select("script_id", "task_id", F.col("source").alias("node")).distinct()


def model_edges(digest: DataFrame) -> DataFrame:
    """``(script_id, src, dst)``: a model reads one that its script defines in the same or an earlier statement."""
    reads = model_reads(digest).where("is_model AND source <> reader")
    return reads.select("script_id", F.col("source").alias("src"), F.col("reader").alias("dst")).distinct()


def column_index(digest: DataFrame) -> DataFrame:
    """``(script_id, column, model)``: which models project a column."""
    return latest(digest, "columns").select(
        "script_id", F.explode("columns").alias("column"), F.col("name").alias("model")
    )


def tasks(statements: DataFrame) -> DataFrame:
    """One task per statement with a target, known by its statement; the label is for display only.

    ``(script_id, stmt_no, task_id, label, source_tables, target_table, raw_sql)``
    """
    return statements.where("target_table IS NOT NULL").select(
        "script_id", "stmt_no", F.concat(F.lit("stmt_"), F.col("stmt_no").cast("string")).alias("task_id"),
        sql.safe_label(F.col("label")).alias("label"), "source_tables", "target_table", "raw_sql",
    )


def impact(index: DataFrame, edges: DataFrame, reading: DataFrame) -> DataFrame:
    """Affected models, affected tasks and blast radius of every column of every script.

    A model is affected when it projects the column; a task when it reads such a model or a descendant
    of one, by ``reading`` (see ``task_reads``). Descendants are found per column in one walk from all
    projecting models.
    """
    starts = index.withColumnRenamed("model", "node")
    touched = graph.reachable(starts, edges, KEY, ["column"])
    hit_tasks = touched.join(reading, ["script_id", "node"]).select("script_id", "column", "task_id").distinct()
    by_model = index.groupBy("script_id", "column").agg(F.sort_array(F.collect_set("model")).alias("affected_models"))
    by_task = hit_tasks.groupBy("script_id", "column").agg(F.sort_array(F.collect_set("task_id")).alias("tasks"))
    found = by_model.join(by_task, ["script_id", "column"], "left").withColumn(
        "affected_tasks", F.coalesce("tasks", F.array().cast("array<string>"))
    )
    return found.select(
        "script_id", "column", "affected_models", "affected_tasks",
        (F.size("affected_models") + F.size("affected_tasks")).cast("bigint").alias("blast_radius"),
    )


def affected_edges(index: DataFrame, edges: DataFrame) -> DataFrame:
    """Model edges inside the affected set of each column: ``(script_id, column, src, dst)``."""
    src = index.withColumnRenamed("model", "src")
    dst = index.withColumnRenamed("model", "dst")
    return edges.join(src, ["script_id", "src"]).join(dst, ["script_id", "column", "dst"]).select(
        "script_id", "column", "src", "dst"
    )


def dependency_tree(index: DataFrame, edges: DataFrame) -> DataFrame:
    """Affected children of every affected model; leaves have an empty list."""
    children = affected_edges(index, edges).groupBy("script_id", "column", F.col("src").alias("model")).agg(
        F.sort_array(F.collect_set("dst")).alias("found")
    )
    return index.join(children, ["script_id", "column", "model"], "left").select(
        "script_id", "column", F.col("model").alias("parent"),
        F.coalesce("found", F.array().cast("array<string>")).alias("children"),
    )


def critical_path(index: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """The longest path through the affected models of each column.

    Where these form a cycle the path is the first affected model only; ``places`` gives the position
    of each model, ``(script_id, model, place)``.
    """
    keys = ["script_id", "column"]
    nodes = index.select(*keys, F.col("model").alias("node"))
    paths = graph.longest_path(nodes, affected_edges(index, edges), keys)
    cyclic = paths.where("path IS NULL").select(*keys)
    first = (
        index.join(cyclic, keys, "left_semi").join(places, ["script_id", "model"])
        .groupBy(*keys).agg(F.array(F.min_by("model", "place")).alias("path"))
    )
    return paths.where("path IS NOT NULL").unionByName(first)


def word_index(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables that answer renames without the texts: where each word stands, and how each line reads.

    ``(script_id, model, line_no, word)``, laid out by word so that a stored index is read where a word can be, and
    ``(script_id, model, line_no, line_hint)``. Both are of the definition of each model that counts.
    """
    current = latest(models, "body").withColumnRenamed("name", "model")
    lines = current.select("script_id", "model", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    words = lines.select("script_id", "model", "line_no", F.explode(sql.words(F.col("line"))).alias("word"))
    hints = lines.select("script_id", "model", "line_no", sql.strip(sql.unveil(F.col("line"))).alias("line_hint"))
    return words.repartitionByRange("word", "script_id").sortWithinPartitions("word", "script_id"), hints


def rename_impact(words: DataFrame, hints: DataFrame, index: DataFrame, renames: DataFrame) -> DataFrame:
    """The first line of each projecting model that holds the old name as a word.

    ``renames`` is ``(script_id, old_value, new_value)``, ``words`` and ``hints`` are a stored ``word_index``: the
    lookup is an equality join on words, and a line is fetched only for the hits.
    """
    wanted = renames.withColumn("column", F.lower("old_value"))
    projecting = index.join(wanted, ["script_id", "column"]).withColumnRenamed("column", "word")
    named = projecting.join(words, ["script_id", "model", "word"])
    first = named.groupBy("script_id", "model", "old_value", "new_value").agg(F.min("line_no").alias("line_no"))
    return first.join(hints, ["script_id", "model", "line_no"]).select(
        "script_id",
        F.concat(F.lit("models/"), sql.last_part(F.col("model")), F.lit(".sql")).alias("file_path"),
        "line_hint",
        F.lit("rename").alias("change_type"),
        "old_value",
        "new_value",
    )


def version_columns(versions: DataFrame) -> DataFrame:
    """``(script_id, column, in_v1, in_v2, type_v1, type_v2)``; both versions are parsed in one pass."""
    each = versions.select(
        "script_id",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("version"), F.col(f"v{n}").alias("sql_text")) for n in (1, 2)
        ])).alias("v"),
    ).select(F.struct("script_id", "v.version").alias("script_id"), "v.sql_text")
    parsed = model_plans.models(catalog.statements(by_script(each)))
    items = parsed.where("is_final").select(
        F.col("script_id.script_id").alias("id"), F.col("script_id.version").alias("version"), "stmt_no",
        F.posexplode("items").alias("item", "expr"),
    )
    kind = sql.cast_type(F.col("expr"))
    typed = items.select(
        F.col("id").alias("script_id"), "version", F.struct("stmt_no", "item").alias("place"),
        sql.column_name(F.col("expr")).alias("column"), F.when(kind != "", kind).alias("data_type"),
    ).where("column IS NOT NULL")

    def type_of(version: int):
        named = (F.col("version") == version) & F.col("data_type").isNotNull()
        return F.max_by(F.when(named, F.col("data_type")), F.when(named, F.col("place"))).alias(f"type_v{version}")

    return typed.groupBy("script_id", "column").agg(
        F.max(F.col("version") == 1).alias("in_v1"), F.max(F.col("version") == 2).alias("in_v2"),
        type_of(1), type_of(2),
    )


def breaking_changes(versions: DataFrame) -> DataFrame:
    """One row per script: added, removed, renamed and retyped columns, and whether the change breaks readers.

    One removal with one addition is read as a rename.
    """
    columns = version_columns(versions)
    retyped = F.col("in_v1") & F.col("in_v2") & (F.col("type_v1") != F.col("type_v2"))

    def listed(condition, value):
        return F.sort_array(F.collect_list(F.when(condition, value)))

    grouped = columns.groupBy("script_id").agg(
        listed(~F.col("in_v1"), F.col("column")).alias("added"),
        listed(~F.col("in_v2"), F.col("column")).alias("removed"),
        listed(
            retyped, F.concat("column", F.lit(" "), F.col("type_v1"), F.lit(" -> "), F.col("type_v2"))
        ).alias("type_changes"),
    )
    none = F.array().cast("array<string>")
    full = versions.select("script_id").join(grouped, "script_id", "left").select(
        "script_id", *[F.coalesce(c, none).alias(c) for c in ("added", "removed", "type_changes")]
    )
    one_each = (F.size("added") == 1) & (F.size("removed") == 1)
    renamed = F.when(one_each, F.array(F.concat(F.element_at("removed", 1), F.lit(" -> "), F.element_at("added", 1))))
    settled = full.withColumn("renamed", F.coalesce(renamed, none)).select(
        "script_id", "renamed", "type_changes",
        F.when(one_each, none).otherwise(F.col("added")).alias("added"),
        F.when(one_each, none).otherwise(F.col("removed")).alias("removed"),
    )

    def phrase(column: str, text: str, names: bool = False):
        count = F.concat(F.size(column).cast("string"), F.lit(text))
        listing = F.concat(F.lit(": ['"), F.array_join(column, "', '"), F.lit("']"))
        return F.when(F.size(column) > 0, F.concat(count, listing) if names else count)

    summary = F.concat_ws(
        "; ",
        phrase("removed", " column(s) removed", names=True),
        phrase("renamed", " column(s) renamed"),
        phrase("type_changes", " type change(s)"),
        phrase("added", " column(s) added (non-breaking)"),
    )
    return settled.select(
        "script_id", "added", "removed", "renamed", "type_changes",
        ((F.size("removed") + F.size("renamed") + F.size("type_changes")) > 0).alias("is_breaking"),
        F.when(summary == "", "No changes detected").otherwise(summary).alias("summary"),
    )
