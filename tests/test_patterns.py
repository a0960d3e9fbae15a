import random
import re

import pytest

from millrace.plans import patterns


def hits(scripts, text):
    return sorted((r.location, r.pattern_type, r.complexity_score) for r in patterns.pattern_hits(scripts(text)).collect())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("WITH a AS (SELECT 1 FROM t) SELECT * FROM a", [(0, "CTE", 1)]),
        ("WITH RECURSIVE a AS (SELECT 1 FROM t) SELECT * FROM a", [(0, "RECURSIVE_CTE", 3)]),
        ("SELECT 1 FROM t CONNECT  BY PRIOR a = b", [(16, "RECURSIVE_CTE", 3)]),
        ("MERGE INTO t USING s ON (1=1)", [(0, "MERGE", 2)]),
        ("x; EXECUTE IMMEDIATE 'drop'", [(3, "DYNAMIC_SQL", 3)]),
        ("EXEC sp_executesql @q", [(5, "DYNAMIC_SQL", 3)]),
        ("EXECUTE ( 'select')", [(0, "DYNAMIC_SQL", 3)]),
        ("PROCEDURE p (a IN INT, b OUT INT)", [(25, "OUT_PARAMETER", 1)]),
        ("SELECT RANK() OVER (ORDER BY a) FROM t", [(14, "WINDOW_FUNCTION", 1)]),
        ("SELECT * FROM t PIVOT (SUM(a) FOR b IN (1))", [(16, "PIVOT", 2)]),
        ("SELECT * FROM t UNPIVOT (a FOR b IN (c))", [(16, "UNPIVOT", 2)]),
        ("SELECT * FROM t, LATERAL (SELECT 1 FROM u)", [(17, "LATERAL_JOIN", 2)]),
        ("SELECT * FROM t CROSS APPLY f(a) OUTER APPLY g(b)", [(16, "LATERAL_JOIN", 2), (33, "LATERAL_JOIN", 2)]),
        ("SELECT (SELECT (SELECT (SELECT 1 FROM a) FROM b) FROM c) FROM d", [(0, "NESTED_SUBQUERY", 3)]),
        ("SELECT (SELECT (SELECT 1 FROM b) FROM c) FROM d", []),
        ("SELECT a FROM t", []),
        ("SELECT a /* OVER (x) */ FROM t -- MERGE INTO x", []),
        ("/* é */ SELECT 1 OVER (a)", [(17, "WINDOW_FUNCTION", 1)]),
    ],
)
def test_each_pattern(scripts, text, expected):
    assert hits(scripts, text) == sorted(expected)


def test_plain_cte_close_to_a_recursive_one(scripts):
    close = "CONNECT BY a WITH b AS (SELECT 1 FROM t)"
    far = "CONNECT BY a         WITH b AS (SELECT 1 FROM t)"
    assert [h[1] for h in hits(scripts, close)] == ["RECURSIVE_CTE"]
    assert [h[1] for h in hits(scripts, far)] == ["RECURSIVE_CTE", "CTE"]
    behind = "WITH b AS (  \n   CONNECT BY a"
    assert [h[1] for h in hits(scripts, behind)] == ["RECURSIVE_CTE"]


def brute_depth(text):
    text = re.sub(r"'[^']*'?", "''", text)
    depth = deepest = 0
    for i, ch in enumerate(text):
        if ch == "(":
            depth += 1
            if re.match(r"SELECT\b", text[i + 1 : i + 60].lstrip(), re.IGNORECASE):
                deepest = max(deepest, depth)
        elif ch == ")":
            depth = max(0, depth - 1)
    return deepest


def test_offsets_and_depths_against_brute_force(scripts):
    rng = random.Random(3)
    parts = [
        "OVER (", "(SELECT", "( \n select ", ")", "'(select'", "merge  into", "\n", " x ", "PIVOT(", "OUT a", "CROSS APPLY",
        ") ) )", "(", "WITH q AS (", "CONNECT BY", "y" * 25, "EXEC('", "'",
    ]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(60)]
    table = scripts(*texts)
    depth = {r.script_id: r.max_depth for r in patterns.nesting_depth(table).collect()}
    assert depth == {i: brute_depth(t) for i, t in enumerate(texts)}

    expected = set()
    for i, text in enumerate(texts):
        # What literals hold is no code; their quotes are.
        bare = re.sub("'[^']*'?", lambda m: "'" + re.sub(r"[^\n]", " ", m[0][1:-1] if m[0][1:].endswith("'") else m[0][1:]) + ("'" if m[0][1:].endswith("'") else ""), text)
        found = [(m.start(), kind, score) for kind, score, rx in patterns.RULES for m in re.finditer(rx, bare)]
        recursive = [p for p, kind, _ in found if kind == "RECURSIVE_CTE"]
        found = [f for f in found if f[1] != "CTE" or all(abs(f[0] - p) >= 20 for p in recursive)]
        if depth[i] >= 3:
            found.append((0, "NESTED_SUBQUERY", 3))
        expected |= {(i, *f, text[: f[0]].count("\n") + 1) for f in found}
    got = {
        (r.script_id, r.location, r.pattern_type, r.complexity_score, r.line)
        for r in patterns.pattern_hits(table).collect()
    }
    assert got == expected


def test_literals_and_quoted_names_never_match(scripts):
    quiet = [
        "SELECT 'merge into x; with a as (' FROM t;", 'SELECT "over (", "x out y" FROM t', "SELECT 'a''pivot (' FROM t", "SELECT 'lateral (\n outer apply",
        "-- execute immediate\nSELECT '(select (select (select' FROM t /* connect by */",
    ]
    assert patterns.pattern_hits(scripts(*quiet)).count() == 0
    loud = [("EXEC('drop table x')", "DYNAMIC_SQL", 0), ("SELECT 'over (' , sum(x) OVER (y)", "WINDOW_FUNCTION", 25), ("x 'merge into' MERGE INTO t", "MERGE", 15)]
    got = patterns.pattern_hits(scripts(*[t for t, *_ in loud])).orderBy("script_id").collect()
    assert [(r.pattern_type, r.location) for r in got] == [(k, p) for _, k, p in loud]


def test_warnings_name_the_first_line(scripts):
    got = {(r.code, r.line) for r in patterns.warnings(scripts("-- a\nMERGE INTO t\nMERGE INTO u; EXECUTE IMMEDIATE x")).collect()}
    assert got == {("W004", 2), ("W005", 3)}
    assert patterns.warnings(scripts("SELECT 1")).count() == 0


def test_every_pattern_has_a_warning():
    assert {kind for kind, _, _ in patterns.RULES} | {patterns.NESTED} == {kind for kind, _, _ in patterns.WARNINGS}
    assert sorted(code for _, code, _ in patterns.WARNINGS) == [f"W{n:03}" for n in range(1, 11)]


def test_complexity(scripts):
    r = patterns.complexity(scripts("MERGE INTO t; SELECT 1 OVER (a)")).first()
    assert (r.patterns, r.score, r.worst) == (2, 3, 2)


def test_cte_order(scripts):
    text = "-- WITH z AS (\nCREATE TABLE t AS WITH base AS (SELECT 1 FROM a), mid (x) AS (SELECT 1 FROM base), last AS ( SELECT 2 FROM mid) SELECT 1 FROM last"
    got = [r.cte for r in patterns.cte_order(scripts(text)).orderBy("position").collect()]
    assert got == ["base", "mid", "last"]
    assert patterns.cte_order(scripts("SELECT CAST(a AS (b)) FROM t")).count() == 0


def test_any_number_of_blanks_before_a_subquery_counts(scripts):
    text = "SELECT 1 FROM (" + " " * 5000 + "SELECT 2 FROM a) x"
    assert [r.max_depth for r in patterns.nesting_depth(scripts(text)).collect()] == [1]
