"""Models of a corpus: every common table expression and every final select, with its items.

The text is tokenised at parentheses, commas and the words SELECT and FROM; windows over the
tokens of one statement give the nesting depth, the CTE a token lies in and its place in the select
list. The corpus is shuffled once by script, as text; the windows and both regroupings reuse that
partitioning. A statement's tokens are bounded by the script size limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import sqltext as sql

# Schemas whose tables count as marts.
MART_SCHEMAS = ("mart", "marts", "dw", "warehouse")

_MARK = "\u0001"
_TOKEN = f"[(),]|{_MARK}\\w+{_MARK}|[^(),{_MARK}]+"
_SELECT, _FROM = f"{_MARK}SELECT{_MARK}", f"{_MARK}FROM{_MARK}"
_FINAL = 2**31 - 1
_OPENS_CTE = r"(?i)\bAS\s*(?:(?:NOT\s+)?MATERIALIZED\s*)?$"


def _tokens(statements: DataFrame) -> DataFrame:
    """One row per token. Everything drawn from the text is a column before the explosion, which then
    repeats short values only. The outer form keeps the optimizer from adding a filter on the number of
    tokens, which it would push below the projections and so lex every statement twice."""
    kept = ["script_id", "stmt_no", "statement_type", "target_table"]
    body = statements.select(*kept, sql.select_body(F.col("veiled"), F.col("statement_type")).alias("body"))
    inner = F.regexp_replace("body", r"(?i)^\s*WITH\s+(?:RECURSIVE\s+)?", "")
    marked = F.regexp_replace(inner, r"(?i)\b(SELECT|FROM)\b", f"{_MARK}$1{_MARK}")
    lexed = body.select(
        *kept,
        F.col("body").rlike(r"(?i)^\s*WITH\b").alias("has_with"),
        F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0)).alias("tokens"),
    )
    return lexed.select(*kept, "has_with", F.posexplode_outer("tokens").alias("pos", "tok")).where("tok IS NOT NULL")


def _word(token: Column) -> Column:
    return F.upper(token)


def _placed(tokens: DataFrame) -> DataFrame:
    """Add the nesting level of each token, the select it lies in and its role there.

    The running values need two passes over one order: the level first, then everything that asks for it.
    """
    order = Window.partitionBy("script_id", "stmt_no").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tok, level = F.col("tok"), F.col("level")
    delta = F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)

    leveled = (
        tokens.withColumn("delta", delta)
        .withColumn("level", F.sum("delta").over(upto) - F.greatest(F.col("delta"), F.lit(0)))
        .withColumn("before", F.lag("tok").over(order))
    )
    opening = (tok == "(") & (level == 0)
    opens = opening & F.coalesce(F.col("before").rlike(_OPENS_CTE), F.lit(False))
    scoped = leveled.withColumns({
        "main": F.max(~F.col("has_with") | ((_word(tok) == _SELECT) & (level == 0))).over(upto),
        "opened": F.sum(opens.cast("int")).over(upto),
        "in_cte": F.last(F.when(opening, opens), True).over(upto),
    })
    paren = tok.isin("(", ")")
    role = (
        F.when(F.col("main"), "body")
        .when((level >= 1) & F.col("in_cte"), "body")
        .when((level == 0) & ~paren, "head")
    )
    ord_ = F.when(F.col("main"), _FINAL).when(level >= 1, F.col("opened") - 1).otherwise(F.col("opened"))
    return scoped.select(
        "script_id", "stmt_no", "statement_type", "target_table", "pos", "tok", "level", role.alias("role"),
        ord_.alias("ord"),
    ).where("role IS NOT NULL")


def _sectioned(placed: DataFrame) -> DataFrame:
    """Add the section of each token: 0 before the select list, 1 in it, 2 after; and the item number.

    The list runs from the first SELECT to the next FROM of the same nesting level; the comma that
    starts an item counts as part of it.
    """
    upto = (
        Window.partitionBy("script_id", "stmt_no", "ord", "role")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    word, is_select = _word(F.col("tok")), _word(F.col("tok")) == _SELECT
    based = placed.withColumns({
        "base": F.first(F.when(is_select, F.col("level")), True).over(upto),
        "selects": F.sum(is_select.cast("int")).over(upto),
    })
    here = F.coalesce(F.col("level") == F.col("base"), F.lit(False))
    counted = based.withColumns({
        "closed": F.max(here & (word == _FROM)).over(upto),
        "commas": F.sum((here & (F.col("tok") == ",")).cast("int")).over(upto),
    })
    section = (
        F.when(F.col("closed"), 2).when(F.col("base").isNull() | (is_select & (F.col("selects") == 1)), 0).otherwise(1)
    )
    return counted.withColumn("section", section).withColumn(
        "item", F.when(F.col("section") == 1, F.col("commas")).otherwise(0)
    )


def models(statements: DataFrame) -> DataFrame:
    """One row per select: ``(script_id, stmt_no, ord, statement_type, is_final, name, body, items)``.

    CTEs come first in definition order; the final select has the greatest ``ord``, and its name is the
    full target table or NULL. ``body`` and ``items`` are veiled text. ``items`` is NULL without a
    SELECT … FROM pair.
    """
    sections = _sectioned(_placed(_tokens(statements)))
    text = F.expr("listagg(tok, '') WITHIN GROUP (ORDER BY pos)")
    joined = sections.groupBy("script_id", "stmt_no", "ord", "role", "section", "item").agg(
        F.translate(text, _MARK, "").alias("text"),
        F.min("pos").alias("pos"),
        F.any_value("statement_type").alias("statement_type"),
        F.any_value("target_table").alias("target_table"),
    )
    body = F.col("role") == "body"

    def gathered(condition: Column) -> Column:
        pieces = F.sort_array(F.collect_list(F.when(condition, F.struct("pos", "text"))))
        return F.transform(pieces, lambda p: p["text"])

    grouped = joined.groupBy("script_id", "stmt_no", "ord").agg(
        F.array_join(gathered(~body), "").alias("head"),
        F.array_join(gathered(body), "").alias("body"),
        gathered(body & (F.col("section") == 1)).alias("parts"),
        F.max(body & (F.col("section") == 2)).alias("has_from"),
        F.any_value("statement_type").alias("statement_type"),
        F.any_value("target_table").alias("target_table"),
        F.max(body).alias("has_body"),
    )
    is_final = F.col("ord") == _FINAL
    ctes_before = F.count(F.lit(1)).over(Window.partitionBy("script_id", "stmt_no")) - 1
    items = F.transform(F.col("parts"), lambda p: sql.strip(F.regexp_replace(p, "^,", "")))
    cte_name = sql.table_name(F.regexp_extract("head", rf"^[\s,]*({sql.WORD})", 1))
    return grouped.where("has_body").select(
        "script_id",
        "stmt_no",
        F.when(is_final, ctes_before).otherwise(F.col("ord")).alias("ord"),
        "statement_type",
        is_final.alias("is_final"),
        F.when(is_final, F.col("target_table")).otherwise(cte_name).alias("name"),
        sql.strip(F.col("body")).alias("body"),
        F.when(F.col("has_from"), F.filter(items, lambda i: i != "")).alias("items"),
    )


def compiled(models: DataFrame) -> DataFrame:
    """The named models that come from a query; plain value inserts define none."""
    return models.where("name IS NOT NULL AND statement_type <> 'INSERT_VALUES'")


def model_columns(models: DataFrame) -> DataFrame:
    """One row per named select item with its type, description and transformation class."""
    item = compiled(models).select(
        "script_id", "stmt_no", "ord", "is_final", F.col("name").alias("model"), F.posexplode("items").alias("item", "expr")
    )
    named = item.withColumn("column", sql.column_name(F.col("expr"))).where("column IS NOT NULL")
    return named.select(
        "script_id", "stmt_no", "ord", "is_final", "model", "item", "column",
        sql.unveil(F.col("expr")).alias("expr"),
        sql.transformation(F.col("expr")).alias("transformation"),
        sql.cast_type(F.col("expr")).alias("data_type"),
        sql.column_description(F.col("column"), F.col("expr")).alias("description"),
    )


def column_counts(models: DataFrame) -> DataFrame:
    """Select items per model; ``*`` is one, no select list is none."""
    return compiled(models).select(
        "script_id", "stmt_no", F.col("name").alias("model"), F.coalesce(F.size("items"), F.lit(0)).alias("column_count")
    )


def model_catalog(models: DataFrame) -> DataFrame:
    """Layer, materialisation and description of every compiled model."""
    body = F.col("body")
    grouped = body.rlike(r"(?i)\bGROUP\s+BY\b") | body.rlike(sql.AGGREGATE)
    windowed = body.rlike(sql.WINDOW)
    schema = F.when(F.col("name").contains("."), F.substring_index("name", ".", 1)).otherwise("staging")
    short = sql.last_part(F.col("name"))
    return compiled(models).select(
        "script_id",
        "stmt_no",
        "ord",
        short.alias("name"),
        F.when(F.col("is_final"), "target").otherwise("cte").alias("kind"),
        F.when(F.col("is_final") & schema.isin(*MART_SCHEMAS), "marts").otherwise("staging").alias("layer"),
        F.when(grouped | windowed, "table").otherwise("view").alias("materialized"),
        F.concat_ws(
            " ",
            F.concat(F.lit("dbt model: "), short, F.lit(".")),
            F.when(grouped, "Aggregated grain."),
            F.when(body.rlike(r"(?i)\bUNION\s+ALL\b"), "UNION ALL of multiple sub-selects."),
            F.when(windowed, "Contains window functions."),
        ).alias("description"),
        sql.unveil(body).alias("body"),
    )


def reference_keys(name: Column) -> Column:
    """What a reference may say to mean a model: its full name, or its last part without a dot."""
    return F.array_distinct(F.array(name, sql.last_part(name)))


def reference_kinds(models: DataFrame) -> DataFrame:
    """Each table a model reads, with whether it means an earlier model of its script.

    Only the first definition of a name is compared with its readers, not every definition.
    """
    place = F.struct("stmt_no", "ord")
    named = compiled(models)
    short = sql.last_part(F.col("name"))
    keyed = named.select("script_id", "stmt_no", "ord", F.explode(reference_keys(F.col("name"))).alias("ref"))
    defined = keyed.groupBy("script_id", "ref").agg(F.min(place).alias("first_place"))
    reads = named.select(
        "script_id", "stmt_no", "ord", short.alias("model"), F.explode(sql.table_refs(F.col("body"))).alias("ref")
    ).withColumn("short", sql.last_part(F.col("ref")))
    known = F.col("first_place").isNotNull() & (F.col("first_place") < place)
    return reads.join(defined, ["script_id", "ref"], "left").select(
        "script_id", "stmt_no", "ord", "model", "ref", "short", F.coalesce(known, F.lit(False)).alias("is_model")
    )


def model_refs(models: DataFrame) -> DataFrame:
    """Sorted model and source references of each model that has any."""
    refs = reference_kinds(models)
    dotted = F.col("ref").contains(".")
    return refs.groupBy("script_id", "stmt_no", "ord", "model").agg(
        F.sort_array(F.collect_set(F.when(F.col("is_model"), F.col("short")))).alias("model_refs"),
        F.sort_array(F.collect_set(F.when(~F.col("is_model") & dotted, F.col("ref")))).alias("source_refs"),
    )


def source_catalog(models: DataFrame) -> DataFrame:
    """External tables per script and schema."""
    outside = reference_kinds(models).where(~F.col("is_model") & F.col("ref").contains("."))
    return outside.groupBy("script_id", F.substring_index("ref", ".", 1).alias("schema")).agg(
        F.sort_array(F.collect_set(F.regexp_replace("ref", r"^[^.]*\.", ""))).alias("tables")
    )
