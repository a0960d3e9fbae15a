"""Column trace: the way of a column through the CTEs and the final select of each statement.

A hop is the first item of a select that mentions a column. Where the column goes next is the
nearest later select that mentions the hop's output, found for all hops in one ordered pass; all
traces then follow these links together, in rounds that double the distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import sqltext as sql
from millrace.operators import graph
from millrace.operators.staging import stage

UNNAMED = "final_output"
_AT = ["script_id", "stmt_no", "ord", "input_col"]


def items(models: DataFrame) -> DataFrame:
    """Every select item with its model, transformation class and text."""
    name = F.coalesce(sql.last_part(F.col("name")), F.lit(UNNAMED)).alias("model_name")
    item = models.select("script_id", "stmt_no", "ord", "is_final", name, F.posexplode("items").alias("item", "expr"))
    return item.select(
        "script_id", "stmt_no", "ord", "item", "is_final", "model_name",
        sql.transformation(F.col("expr")).alias("transformation"),
        sql.unveil(F.col("expr")).alias("snippet"),
    )


def hops(models: DataFrame) -> DataFrame:
    """The first item per select and mentioned word, with the name it goes on under."""
    item = models.select("script_id", "stmt_no", "ord", F.posexplode("items").alias("item", "expr"))
    read = item.select(
        "script_id", "stmt_no", "ord", "item", sql.bare_name(F.regexp_extract("expr", sql.ALIAS, 1)).alias("alias"),
        sql.words(F.col("expr")).alias("words"),
    )
    word = read.select("script_id", "stmt_no", "ord", "item", "alias", F.explode("words").alias("input_col"))
    first = word.groupBy(*_AT).agg(F.min(F.struct("item", "alias")).alias("first"))
    return first.select(
        *_AT,
        F.col("first.item").alias("item"),
        F.when(F.col("first.alias") != "", F.col("first.alias")).otherwise(F.col("input_col")).alias("output_col"),
    )


def _linked(hops: DataFrame) -> DataFrame:
    """Add ``next_ord``: the nearest later select that mentions the output column."""
    mention = hops.select("script_id", "stmt_no", F.col("input_col").alias("column"), "ord", F.lit(0).alias("asks"))
    ask = hops.select(
        "script_id", "stmt_no", F.col("output_col").alias("column"), "ord", F.lit(1).alias("asks")
    ).distinct()
    later = (
        Window.partitionBy("script_id", "stmt_no", "column").orderBy(F.col("ord").desc(), F.col("asks").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    following = F.last(F.when(F.col("asks") == 0, F.col("ord")), True).over(later)
    answers = (
        mention.unionByName(ask).withColumn("next_ord", following).where("asks = 1")
        .select("script_id", "stmt_no", F.col("column").alias("output_col"), "ord", "next_ord")
    )
    return hops.join(answers, ["script_id", "stmt_no", "ord", "output_col"])


def trace_steps(models: DataFrame, questions: DataFrame) -> DataFrame:
    """``(script_id, column, hop, …)`` for every asked ``(script_id, column)``; each statement starts afresh."""
    links = stage(_linked(hops(models)), "hops")
    start = links.groupBy("script_id", "stmt_no", F.col("input_col").alias("column")).agg(F.min("ord").alias("ord"))
    asked = questions.select("script_id", F.lower("column").alias("column")).distinct()
    place = F.struct("stmt_no", "ord", F.col("column").alias("input_col")).alias("node")
    starts = asked.join(start, ["script_id", "column"]).select("script_id", "column", place)
    onward = links.where("next_ord IS NOT NULL").select(
        "script_id", F.struct("stmt_no", "ord", "input_col").alias("src"),
        F.struct("stmt_no", F.col("next_ord").alias("ord"), F.col("output_col").alias("input_col")).alias("dst"),
    )
    visited = graph.reachable(starts, onward, ["script_id"], ["column"]).select("script_id", "column", "node.*")
    order = Window.partitionBy("script_id", "column").orderBy("stmt_no", "ord")
    return visited.join(links, _AT).join(items(models), ["script_id", "stmt_no", "ord", "item"]).select(
        "script_id", "column", F.row_number().over(order).cast("bigint").alias("hop"), "stmt_no", "model_name",
        "is_final", "input_col", "output_col", "transformation", "snippet",
    )


def trace_rollup(steps: DataFrame, statements: DataFrame, questions: DataFrame) -> DataFrame:
    """Found, depth, final output and source table of every asked column."""
    cte = F.transform(sql.cte_names(F.col("veiled")), lambda n: F.lower(n))
    read = F.transform(F.regexp_extract_all("veiled", F.lit(sql.FROM_REF), F.lit(1)), lambda t: sql.table_name(t))
    outside = F.array_except(read, cte)
    onward = Window.partitionBy("script_id").orderBy(F.col("stmt_no").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    origin = statements.select(
        "script_id", F.col("stmt_no").alias("first_stmt"),
        F.last(F.try_element_at(outside, F.lit(1)), True).over(onward).alias("source_table"),
    )
    keys = ["script_id", "column"]
    found = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("depth"),
        F.min("stmt_no").alias("first_stmt"),
        F.max_by(F.when(F.col("is_final"), F.col("model_name")), F.when(F.col("is_final"), F.col("stmt_no"))).alias(
            "final_output"
        ),
    )
    placed = found.join(origin, ["script_id", "first_stmt"])
    asked = questions.select("script_id", F.lower("column").alias("column")).distinct()
    return asked.join(placed, keys, "left").select(
        *keys, F.col("depth").isNotNull().alias("found"), F.coalesce("depth", F.lit(0)).alias("depth"),
        "final_output", "source_table",
    )


_DOTTED = rf"{sql.WORD}(?:\.{sql.WORD})*"
_LAST = r'\.?("[^"]*"|[^".]*)$'
# Words that follow a table name and are no alias of it.
NO_ALIAS = (
    "WHERE", "JOIN", "ON", "USING", "LEFT", "RIGHT", "FULL", "INNER", "OUTER", "CROSS", "NATURAL", "LATERAL", "GROUP", "ORDER",
    "HAVING", "UNION", "EXCEPT", "INTERSECT", "MINUS", "LIMIT", "OFFSET", "FETCH", "PIVOT", "UNPIVOT", "START", "CONNECT",
    "WINDOW", "QUALIFY", "SET", "WHEN",
)


def scopes(models: DataFrame) -> DataFrame:
    """``(script_id, stmt_no, ord, ref, called)``: the tables of each select and the names that qualify their columns."""
    tokens = F.regexp_extract_all("body", F.lit(rf"{_DOTTED}|[(),]"), F.lit(0))

    def taken(tokens):
        def one(word, i):
            after, then = F.get(tokens, i + 2), F.get(tokens, i + 3)
            alias = F.when(F.upper(after) == "AS", then).when(~F.upper(after).isin(*NO_ALIAS, "(", ")", ","), after)
            return F.struct(F.upper(word).alias("word"), F.get(tokens, i + 1).alias("ref"), alias.alias("alias"))

        return F.filter(F.transform(tokens, one), lambda s: s["word"].isin("FROM", "JOIN") & ~s["ref"].isin("(", ")", ","))

    found = models.select("script_id", "stmt_no", "ord", F.inline(F.get(F.transform(F.array(tokens), taken), 0)))
    ref = sql.table_name(F.col("ref"))
    return found.select(
        "script_id", "stmt_no", "ord", ref.alias("ref"), F.coalesce(sql.bare_name(F.col("alias")), sql.bare_name(sql.last_part(ref))).alias("called")
    ).distinct()


def feeds(models: DataFrame) -> DataFrame:
    """``scopes`` that a select of the same script defines, with that select: ``(…, from_stmt, from_ord)``.

    A name means the last CTE of its statement before the select, else the target of the last statement before
    it, by its full name or, said without a dot, by its last part.
    """
    at = ["script_id", "stmt_no", "ord"]
    scope = stage(scopes(models), "scopes")
    named = models.where("name IS NOT NULL").select("script_id", F.col("stmt_no").alias("from_stmt"), F.col("ord").alias("from_ord"), "is_final", "name")
    short = F.array_distinct(F.array("name", sql.last_part(F.col("name"))))
    target = named.where("is_final").withColumn("ref", F.explode(short))
    cte = named.where("NOT is_final").withColumn("ref", F.col("name"))
    options = cte.unionByName(target).drop("name")
    own = (F.col("from_stmt") == F.col("stmt_no")) & (F.col("from_ord") < F.col("ord")) & ~F.col("is_final")
    earlier = (F.col("from_stmt") < F.col("stmt_no")) & F.col("is_final")
    meant = scope.join(options, ["script_id", "ref"]).where(own | earlier)
    best = F.max(F.struct("from_stmt", "from_ord")).alias("best")
    return meant.groupBy(*at, "ref", "called").agg(best).select(*at, "called", "best.*")


def trace_across(models: DataFrame, questions: DataFrame) -> DataFrame:
    """Every select item that an asked column flows into, in its statement and in those that read its results.

    A graph over items: one leads to another where that item's select reads the first one's select and its
    text names the column the first puts out, unqualified or by the name the table has there. A trace starts at
    the items that mention the column in the first select that does, and takes all ways from there. Renames are
    followed; ``*`` hands on no named column.
    """
    item = models.select("script_id", "stmt_no", "ord", "is_final", "name", F.posexplode("items").alias("item", "expr"))
    item = stage(item, "items")
    said = F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("expr", sql.ALIAS, ""), F.lit(_DOTTED), F.lit(0))))
    word = item.select("script_id", "stmt_no", "ord", "item", said.alias("word"))
    rest = F.regexp_replace("word", _LAST, "")
    mention = stage(word.select(
        "script_id", "stmt_no", "ord", "item", sql.bare_name(sql.last_part(F.col("word"))).alias("column"),
        F.when(rest != "", sql.bare_name(sql.last_part(rest))).alias("by"),
    ).distinct(), "mentions")
    output = item.select(
        "script_id", F.col("stmt_no").alias("from_stmt"), F.col("ord").alias("from_ord"), F.col("item").alias("from_item"),
        sql.column_name(F.col("expr")).alias("column"),
    )
    read = mention.join(feeds(models), ["script_id", "stmt_no", "ord"]).where("by IS NULL OR by = called")
    linked = read.join(output, ["script_id", "from_stmt", "from_ord", "column"])
    edges = linked.select(
        "script_id", F.struct(F.col("from_stmt").alias("stmt_no"), F.col("from_ord").alias("ord"), F.col("from_item").alias("item")).alias("src"),
        F.struct("stmt_no", "ord", "item").alias("dst"),
    )
    asked = questions.select("script_id", F.lower("column").alias("column")).distinct()
    place = F.struct("stmt_no", "ord")
    first = mention.groupBy("script_id", "column").agg(F.min(place).alias("place")).select("script_id", "column", "place.*")
    begun = asked.join(first, ["script_id", "column"]).join(mention, ["script_id", "column", "stmt_no", "ord"])
    starts = begun.select("script_id", "column", F.struct("stmt_no", "ord", "item").alias("node"))
    reached = graph.reachable(starts, edges, ["script_id"], ["column"]).select("script_id", "column", "node.*")
    order = Window.partitionBy("script_id", "column").orderBy("stmt_no", "ord", "item")
    shown = item.select(
        "script_id", "stmt_no", "ord", "item", F.coalesce(sql.last_part(F.col("name")), F.lit(UNNAMED)).alias("model_name"),
        sql.column_name(F.col("expr")).alias("output_col"), sql.transformation(F.col("expr")).alias("transformation"),
        sql.unveil(F.col("expr")).alias("snippet"),
    )
    return reached.join(shown, ["script_id", "stmt_no", "ord", "item"]).select(
        "script_id", "column", F.row_number().over(order).cast("bigint").alias("hop"), "stmt_no", "model_name",
        "output_col", "transformation", "snippet",
    )
