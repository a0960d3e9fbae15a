"""Column functions over SQL text.

``veil`` moves every character of string literals, double-quoted identifiers and comments to private
code points, one for one, so that later patterns see neither a keyword nor a separator in them;
``unveil`` brings them back. The quotes of an identifier stay, and no other double quote does, so a
pattern knows a quoted name by them. Table names keep their quotes, column names lose them.
Comments are also framed by two marks, so that they can be cut out of veiled text.
All patterns but ``BLOCK_END`` stay within the syntax that Java and RE2 share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The recognised aggregate names.
AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX", "STDDEV", "VARIANCE", "MEDIAN", "LISTAGG")

_PRIVATE = 0x10F000
PLAIN = "".join(chr(c) for c in range(0x20, 0x7F) if chr(c) != "'")
VEILED = "".join(chr(_PRIVATE + ord(c)) for c in PLAIN)
COMMENT_START, COMMENT_END, CUT = chr(_PRIVATE + 1), chr(_PRIVATE + 2), chr(_PRIVATE + 3)

PIECES = r"""(?s)'[^']*'?|"[^"]*"|--[^\n]*|/\*.*?\*/|[^'"/\-]+|."""
COMMENT = f"{COMMENT_START}[^{COMMENT_END}]*{COMMENT_END}"
# Possessive, so that a long run of comments neither recurses nor backtracks.
_GAP = rf"\s*+(?:{COMMENT}\s*+)*+"
BLOCK_END = rf"(?i)\bEND\b{_GAP};"
BLOCK_BODY = r"(?is)\bBEGIN\b.*$"
UNWRAPPED = rf"(?is)\bBEGIN\b(.*)\bEND\b{_GAP};$"

_QUOTED = r'"[^"]*"'
WORD = rf"(?:\w+|{_QUOTED})"
_NAMED_TABLE = rf'\bCREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+((?:[^\s"]|{_QUOTED})[^\s"]*(?:{_QUOTED}[^\s"]*)*)\s+AS'
_INTO = rf'\bINSERT\s+INTO\s+((?:[^\s("]|{_QUOTED})[^\s("]*(?:{_QUOTED}[^\s("]*)*)(?:\s*\([^()]*\)\s*|\s+)'
CTAS = rf"(?is){_NAMED_TABLE}\s*\(?\s*(?:SELECT|WITH)\b"
INSERT_SELECT = rf"(?is){_INTO}\(?\s*(?:SELECT|WITH)\b"
INSERT_VALUES = rf"(?is){_INTO}VALUES\b"
CTAS_BODY = rf"(?is){_NAMED_TABLE}\s*(.*)$"
INSERT_BODY = rf"(?is){_INTO}(.*)$"
TABLE_REF = rf"(?i)\b(?:FROM|JOIN)\s+({WORD}(?:\.{WORD})*)"
FROM_REF = rf"(?i)\bFROM\s+({WORD}(?:\.{WORD})?)"
CTE_NAME = rf"(?i)(\b\w+|{_QUOTED})\s*(?:\([^()]*\)\s*)?\bAS\s*(?:(?:NOT\s+)?MATERIALIZED\s*)?\("
AGGREGATE = rf"(?i)\b({'|'.join(AGGREGATES)})\s*\("
WINDOW = r"(?i)\bOVER\s*\("
CAST = r"(?is)\bCAST\s*\(.+?\s+AS\s+(\w+(?:\s*\(\s*\d+\s*(?:,\s*\d+\s*)?\))?)\s*\)"
ALIAS = rf"(?i)\bAS\s+({WORD})\s*$"
LAST_PART = rf'({_QUOTED}|[^".]*)$'
SAFE_IDENTIFIER = r"^[a-zA-Z0-9_.\-]+$"
SAFE_MODEL_NAME = r"^[a-zA-Z][a-zA-Z0-9_]*$"

# Words that cannot name a common table expression.
NOT_A_CTE = (
    "WITH", "SELECT", "FROM", "WHERE", "JOIN", "ON", "AND", "OR", "AS", "RECURSIVE", "TABLE", "INTO", "SET", "GROUP",
    "ORDER", "HAVING", "UNION", "EXCEPT", "INTERSECT", "LIMIT", "OFFSET",
)


def _pieces(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(PIECES), F.lit(0))


def _is_comment(piece: Column) -> Column:
    return piece.startswith("--") | piece.startswith("/*")


def _rebuild(sql: Column, comment, literal) -> Column:
    def piece(p: Column) -> Column:
        quoted = p.startswith("'") | p.startswith('"')
        return F.when(_is_comment(p), comment(p)).when(quoted, literal(p)).otherwise(p)

    return F.array_join(F.transform(_pieces(sql), piece), "")


def _hide(text: Column) -> Column:
    return F.translate(text, PLAIN, VEILED)


def strip(text: Column) -> Column:
    """Trim every kind of white space."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def strip_comments(sql: Column) -> Column:
    """Each comment becomes one space; comment marks inside literals are left alone."""
    return _rebuild(sql, lambda p: F.lit(" "), lambda p: p)


def blanked(sql: Column) -> Column:
    """Only code is left: comments, and what literals and quoted names hold, are blanks of the same length.

    Line breaks and quotes stay, so that offsets are those of the text and a literal can be seen to begin.
    """

    def blank(text: Column) -> Column:
        return F.regexp_replace(text, r"[^\n]", " ")

    def quoted(p: Column) -> Column:
        ended = (F.length(p) > 1) & p.endswith(F.substring(p, 1, 1))
        return F.concat(F.substring(p, 1, 1), blank(F.substring(p, F.lit(2), F.length(p) - F.when(ended, 2).otherwise(1))), F.when(ended, F.substring(p, 1, 1)).otherwise(""))

    return _rebuild(sql, blank, quoted)


def veil(sql: Column) -> Column:
    def quoted(p: Column) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        named = p.startswith('"') & (F.length(p) > 1)
        return F.when(named, F.concat(F.lit('"'), _hide(inner), F.lit('"'))).otherwise(_hide(p))

    return _rebuild(sql, lambda p: F.concat(F.lit(COMMENT_START), _hide(p), F.lit(COMMENT_END)), quoted)


def unveil(text: Column) -> Column:
    return F.translate(F.translate(text, COMMENT_START + COMMENT_END, ""), VEILED, PLAIN)


def cut_comments(veiled: Column) -> Column:
    """Comments of veiled text become one space each."""
    return F.regexp_replace(veiled, COMMENT, " ")


def drop_blocks(veiled: Column, mode: str = "drop") -> Column:
    """PL/SQL blocks: ``drop`` removes them with their body, ``unwrap`` removes only the delimiters.

    A block goes from a BEGIN to the first END that a semicolon follows. The text is cut after each such END,
    so every part but the last ends in one and its first BEGIN opens the block: one pass, whatever is left open.
    """
    if mode not in ("drop", "unwrap"):
        raise ValueError(f"unknown block mode {mode!r}")
    body, put = (BLOCK_BODY, "") if mode == "drop" else (UNWRAPPED, "$1")
    return _replaced_up_to(veiled, BLOCK_END, body, put)


def _replaced_up_to(text: Column, ending: str, opened: str, put: str) -> Column:
    """Replace what ``opened`` matches in each part of ``text`` that ends in ``ending``; the rest stays."""
    parts = F.split(F.regexp_replace(text, ending, f"$0{CUT}"), CUT)

    def whole(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.regexp_replace(p, opened, put)).otherwise(p)), "")

    return F.get(F.transform(F.array(parts), whole), 0)


def normalise(sql: Column) -> Column:
    """Comment-free text with template expressions neutralised and blanks collapsed."""
    text = strip_comments(sql)
    text = _replaced_up_to(text, r"\}\}", r"(?s)\{\{.*$", " __JINJA_EXPR__ ")
    text = F.regexp_replace(text, r"(?s)\{%-?.*?-?%\}", " ")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def table_name(name: Column) -> Column:
    """Lower case without trailing punctuation, of a name in veiled text."""
    return F.regexp_replace(F.lower(unveil(name)), r"[);,]+$", "")


def last_part(name: Column) -> Column:
    """What follows the last dot outside quotes."""
    return F.regexp_extract(name, LAST_PART, 1)


def bare_name(word: Column) -> Column:
    """A column's name, quoted or not, in lower case without quotes."""
    return F.lower(unveil(F.translate(word, '"', "")))


def statement_type(sql: Column) -> Column:
    return (
        F.when(sql.rlike(CTAS), "CTAS")
        .when(sql.rlike(INSERT_SELECT), "INSERT_SELECT")
        .when(sql.rlike(INSERT_VALUES), "INSERT_VALUES")
        .otherwise("UNKNOWN")
    )


def target_table(sql: Column, kind: Column) -> Column:
    into = F.regexp_extract(sql, rf"(?is){_INTO}", 1)
    return F.when(kind == "CTAS", table_name(F.regexp_extract(sql, rf"(?is){_NAMED_TABLE}\b", 1))).when(
        kind.isin("INSERT_SELECT", "INSERT_VALUES"), table_name(into)
    )


def select_body(sql: Column, kind: Column) -> Column:
    """The query of a statement: what follows its CREATE or INSERT head."""
    return (
        F.when(kind == "CTAS", F.regexp_extract(sql, CTAS_BODY, 2))
        .when(kind == "INSERT_SELECT", F.regexp_extract(sql, INSERT_BODY, 2))
        .otherwise(sql)
    )


def table_refs(sql: Column) -> Column:
    """Tables after FROM and JOIN, lower case, distinct, in first-seen order, without ``dual``."""
    found = F.regexp_extract_all(sql, F.lit(TABLE_REF), F.lit(1))
    return F.array_remove(F.array_distinct(F.transform(found, lambda t: table_name(t))), "dual")


def cte_names(sql: Column) -> Column:
    """Names defined after the first WITH, in order."""
    after = F.regexp_extract(sql, r"(?is)\bWITH\b.*$", 0)
    found = F.regexp_extract_all(after, F.lit(CTE_NAME), F.lit(1))
    return F.transform(F.filter(found, lambda n: ~F.upper(n).isin(*NOT_A_CTE)), lambda n: unveil(n))


def source_tables(sql: Column, target: Column) -> Column:
    """Referenced tables without the target and the statement's own CTEs.

    Lists are subtracted as a whole: an expression inside a lambda would be computed anew per element.
    """
    own = F.transform(cte_names(sql), lambda n: F.lower(n))
    return F.array_remove(F.array_except(table_refs(sql), own), F.coalesce(target, F.lit("")))


def aggregations(sql: Column) -> Column:
    found = F.regexp_extract_all(sql, F.lit(AGGREGATE), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda f: F.upper(f))))


def task_label(kind: Column, target: Column, number: Column) -> Column:
    verb = F.when(kind == "CTAS", "create_").otherwise("insert_")
    return F.when(target.isNotNull(), F.concat(verb, last_part(target))).otherwise(
        F.concat(F.lit("stmt_"), number.cast("string"))
    )


def safe_label(label: Column) -> Column:
    """A label of letters, digits and underscores that does not start with a digit."""
    cleaned = F.regexp_replace(label, "[^a-zA-Z0-9_]", "_")
    return F.when(cleaned.rlike("^[0-9]|^$"), F.concat(F.lit("task_"), cleaned)).otherwise(cleaned)


def column_name(expr: Column) -> Column:
    """Output name of a select item: its alias, else its last bare word; NULL when it has none."""
    alias = F.regexp_extract(expr, ALIAS, 1)
    words = F.filter(F.split(expr, r"[\s,.()+*/\-]"), lambda t: t.rlike(f"^{WORD}$"))
    return bare_name(
        F.when(strip(expr) == "*", "*").when(alias != "", alias).otherwise(F.try_element_at(words, F.lit(-1)))
    )


def cast_type(expr: Column) -> Column:
    """Type named by the first CAST, upper case without blanks; empty when there is none."""
    return F.upper(F.regexp_replace(F.regexp_extract(expr, CAST, 1), r"\s+", ""))


def column_description(name: Column, expr: Column) -> Column:
    function = F.upper(F.regexp_extract(expr, AGGREGATE, 1))
    return (
        F.when(name == "*", "All columns from upstream")
        .when(function != "", F.concat(function, F.lit(" of "), name))
        .when(expr.rlike(WINDOW), F.concat(F.lit("Window function result: "), name))
        .when(expr.rlike(CAST), F.concat(F.lit("Cast column: "), name))
        .otherwise(F.concat(F.lit("Column: "), name))
    )


def transformation(expr: Column) -> Column:
    """What a select item does to its input, by fixed priority."""
    function = F.upper(F.regexp_extract(expr, AGGREGATE, 1))
    return (
        F.when(function != "", F.concat(F.lit("aggregate:"), function))
        .when(expr.rlike(WINDOW), "window_function")
        .when(expr.rlike(CAST), F.concat(F.lit("cast:"), cast_type(expr)))
        .when(expr.rlike(ALIAS), "rename")
        .when(expr.rlike(r"[+\-*/]"), "arithmetic")
        .when(expr.rlike(r"(?i)\b(?:COALESCE|NVL|NULLIF)\b"), "null_handling")
        .when(expr.rlike(r"(?i)\bCASE\b"), "case_expression")
        .otherwise("passthrough")
    )


def words(expr: Column) -> Column:
    """Distinct words and quoted names of a veiled expression, in lower case without quotes."""
    found = F.regexp_extract_all(expr, F.lit(WORD), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: bare_name(w)))


_CUT = " [...]"


def shorten(text: Column, width: int = 300) -> Column:
    """Blanks collapsed; longer text ends at a word boundary with a cut sign, within ``width``."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    kept = F.regexp_extract(flat, rf"^(.{{0,{width - len(_CUT)}}})\s", 1)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(kept, F.lit(_CUT)))
