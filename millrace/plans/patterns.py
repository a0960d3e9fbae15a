"""Complex-pattern detection over a corpus: offsets, scores, warnings and nesting depth.

Only numbers leave the scan of the text: each rule splits the text before its matches and keeps the
length and the line count of every piece, so the shuffle that follows carries no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import sqltext as sql
from millrace.operators.layout import by_script

# Pattern type, score, pattern.
RULES = (
    ("RECURSIVE_CTE", 3, r"(?i)\bWITH\s+RECURSIVE\b"),
    ("RECURSIVE_CTE", 3, r"(?i)\bCONNECT\s+BY\b"),
    ("CTE", 1, r"(?i)\bWITH\s+\w+\s+AS\s*\("),
    ("MERGE", 2, r"(?i)\bMERGE\s+INTO\b"),
    ("DYNAMIC_SQL", 3, r"(?i)\bEXECUTE\s+IMMEDIATE\b"),
    ("DYNAMIC_SQL", 3, r"(?i)\bsp_executesql\b"),
    ("DYNAMIC_SQL", 3, r"""(?i)\bEXEC(?:UTE)?\s*\(\s*['"]"""),
    ("OUT_PARAMETER", 1, r"(?i)\bOUT(?:PUT)?\b\s+\w"),
    ("WINDOW_FUNCTION", 1, r"(?i)\bOVER\s*\("),
    ("PIVOT", 2, r"(?i)\bPIVOT\s*\("),
    ("UNPIVOT", 2, r"(?i)\bUNPIVOT\s*\("),
    ("LATERAL_JOIN", 2, r"(?i)\bLATERAL\s*\("),
    ("LATERAL_JOIN", 2, r"(?i)\b(?:CROSS|OUTER)\s+APPLY\b"),
)
NESTED = "NESTED_SUBQUERY"
NESTED_FROM = 3
NEAR = 20

# Pattern type, warning code, message.
WARNINGS = (
    ("RECURSIVE_CTE", "W001",
     "Recursive CTE detected — ensure the anchor/recursive parts are correctly identified."),
    ("CTE", "W002", "CTE block detected — extract_cte_dependencies() for full dependency order."),
    ("NESTED_SUBQUERY", "W003", "Deeply nested subquery (3+ levels) detected — lineage may be incomplete."),
    ("MERGE", "W004",
     "MERGE statement detected — both source and target tables are referenced; verify lineage."),
    ("DYNAMIC_SQL", "W005", "Dynamic SQL detected — static analysis cannot resolve runtime-constructed queries."),
    ("OUT_PARAMETER", "W006", "OUT/OUTPUT parameter detected — result set may flow through an output variable."),
    ("WINDOW_FUNCTION", "W007",
     "Window function (OVER) detected — no special handling required; noting for lineage."),
    ("PIVOT", "W008", "PIVOT detected — column names may be dynamic; verify lineage manually."),
    ("UNPIVOT", "W009", "UNPIVOT detected — column names may be dynamic; verify lineage manually."),
    ("LATERAL_JOIN", "W010",
     "LATERAL / APPLY join detected — correlated subquery; inner tables included in lineage."),
)

_MARK = "\u0001"
_PAREN = -1
_CTE = [rule[0] for rule in RULES].index("CTE")
_RECURSIVE = [number for number, rule in enumerate(RULES) if rule[0] == "RECURSIVE_CTE"]
_PARENS = r"(?i)\(\s*SELECT\b|[()]"


def _searchable(scripts: DataFrame) -> DataFrame:
    """Comments, literals and quoted names blanked in place, so that offsets are those of the original text."""
    text = F.translate(sql.blanked(F.col("sql_text")), _MARK, " ")
    return scripts.select("script_id", text.alias("text"))


def _piece(number: int, n: Column, chars, lines, step) -> Column:
    return F.struct(
        F.lit(number).alias("rule"), n.alias("n"), chars.cast("int").alias("chars"), lines.cast("int").alias("lines"),
        step.cast("int").alias("step"),
    )


def _cut(number: int, pattern: str) -> Column:
    """The text cut before every match of a rule."""
    return F.split(F.regexp_replace("text", pattern, f"{_MARK}$0"), _MARK).alias(f"cut{number}")


def _pieces_before_hits(number: int) -> Column:
    """One entry per match: the length and the line breaks of the text between it and the match before."""
    parts = F.col(f"cut{number}")
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p, i: _piece(number, i, F.length(p), F.length(p) - F.length(F.translate(p, "\n", "")), F.lit(0)),
    )


def _parentheses() -> Column:
    """One entry per parenthesis: −1 closes, 1 opens, 2 opens a subquery."""
    found = F.regexp_extract_all("text", F.lit(_PARENS), F.lit(0))
    step = lambda t: F.when(t == ")", -1).when(t == "(", 1).otherwise(2)
    return F.transform(found, lambda t, i: _piece(_PAREN, i, F.lit(0), F.lit(0), step(t)))


def _depths(parens: DataFrame) -> DataFrame:
    """Add the depth of each subquery parenthesis; a stray closing one counts for nothing.

    The depth that never falls below zero is the running sum less its running minimum, where that is negative.
    """
    upto = (
        Window.partitionBy("script_id", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    depth = F.col("total") - F.least(F.min("total").over(upto), F.lit(0))
    return parens.withColumn("total", F.sum(F.least("step", F.lit(1))).over(upto)).withColumn(
        "depth", F.when(F.col("step") == 2, depth)
    )


def nesting_depth(scripts: DataFrame) -> DataFrame:
    """Deepest parenthesis of each script that is followed by SELECT."""
    parens = _searchable(scripts).select("script_id", F.inline_outer(_parentheses()))
    return _depths(parens).groupBy("script_id").agg(
        F.coalesce(F.max("depth"), F.lit(0)).cast("bigint").alias("max_depth")
    )


def _of_rule(position: int) -> Column:
    out = F.when(F.col("rule") == _PAREN, (NESTED, NESTED_FROM)[position])
    for number, rule in enumerate(RULES):
        out = out.when(F.col("rule") == number, rule[position])
    return out


def pattern_hits(scripts: DataFrame) -> DataFrame:
    """``(script_id, pattern_type, location, complexity_score, line)``.

    The text is scanned in one stage and its numbers are shuffled once, by script; every window below
    works in that layout. A plain CTE close to a recursive hit is dropped: the nearest recursive hits on
    both sides come from one ordered pass. Deep nesting is one hit at the start of the script.
    """
    cuts = [_cut(number, rule[2]) for number, rule in enumerate(RULES)]
    pieces = F.concat(*[_pieces_before_hits(number) for number in range(len(RULES))], F.col("parens"))
    searched = _searchable(scripts).select("script_id", *cuts, _parentheses().alias("parens"))
    spread = by_script(searched.select("script_id", F.inline(pieces)))
    upto = (
        Window.partitionBy("script_id", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = _depths(spread).select(
        "script_id", "rule", "n", "depth",
        F.sum("chars").over(upto).alias("location"), (F.sum("lines").over(upto) + 1).alias("line"),
    )
    recursive = F.when(F.col("rule").isin(*_RECURSIVE), F.col("location"))
    # Both frames grow from their start, so each is one pass; a frame that shrinks is redone for every row.
    in_script, so_far = Window.partitionBy("script_id"), (Window.unboundedPreceding, Window.currentRow)
    before = F.last(recursive, True).over(in_script.orderBy("location").rangeBetween(*so_far))
    after = F.last(recursive, True).over(in_script.orderBy(F.col("location").desc()).rangeBetween(*so_far))
    deepest = F.max("depth").over(Window.partitionBy("script_id"))
    near = ((F.col("location") - F.col("before")) < NEAR) | ((F.col("after") - F.col("location")) < NEAR)
    is_paren, is_cte = F.col("rule") == _PAREN, F.col("rule") == _CTE
    kept = placed.withColumns({"before": before, "after": after, "deepest": deepest}).where(
        F.when(is_paren, (F.col("n") == 0) & (F.col("deepest") >= NESTED_FROM))
        .when(is_cte, ~F.coalesce(near, F.lit(False)))
        .otherwise(True)
    )
    return kept.select(
        "script_id", _of_rule(0).alias("pattern_type"), "location", _of_rule(1).cast("bigint").alias("complexity_score"),
        "line",
    )


def warnings(scripts: DataFrame) -> DataFrame:
    """One warning per script and code, at the first hit."""
    first = pattern_hits(scripts).groupBy("script_id", "pattern_type").agg(F.min("line").alias("line"))
    kind = F.col("pattern_type")

    def lookup(position: int) -> Column:
        out = F.when(kind == WARNINGS[0][0], WARNINGS[0][position])
        for entry in WARNINGS[1:]:
            out = out.when(kind == entry[0], entry[position])
        return out

    return first.select("script_id", lookup(1).alias("code"), lookup(2).alias("message"), "line")


def complexity(scripts: DataFrame) -> DataFrame:
    """Hits and total score per script that has any."""
    return pattern_hits(scripts).groupBy("script_id").agg(
        F.count(F.lit(1)).alias("patterns"),
        F.sum("complexity_score").alias("score"),
        F.max("complexity_score").alias("worst"),
    )


def cte_order(scripts: DataFrame) -> DataFrame:
    """CTE names of each script in definition order, for scripts that define any."""
    text = sql.cut_comments(sql.veil(F.col("sql_text")))
    return scripts.select(
        "script_id", F.posexplode(sql.cte_names(text)).alias("position", "cte")
    )
