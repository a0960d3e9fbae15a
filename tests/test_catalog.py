import pytest
from pyspark.sql import functions as F

from millrace.functions import sqltext as sql
from millrace.plans import catalog, statement_graph

CHAIN = """
CREATE TABLE staging.spend AS SELECT id, SUM(x) AS total, COUNT(*) AS n FROM raw.pay GROUP BY id;
CREATE TABLE mart.summary AS SELECT c.id, s.total FROM staging.spend s JOIN raw.people c ON s.id = c.id WHERE s.total > 1;
INSERT INTO mart.top SELECT id, total FROM mart.summary;
"""


def listed(df):
    return {(r.script_id, r.stmt_no): r for r in df.collect()}


def one(scripts, text, **options):
    return [r for _, r in sorted(listed(catalog.statements(scripts(text), **options)).items())]


def edge_set(df):
    return {(r.src, r.dst) for r in df.collect()}


def test_chain(scripts):
    a, b, c = one(scripts, CHAIN)
    assert [r.statement_type for r in (a, b, c)] == ["CTAS", "CTAS", "INSERT_SELECT"]
    assert [r.label for r in (a, b, c)] == ["create_spend", "create_summary", "insert_top"]
    assert (a.target_table, a.source_tables) == ("staging.spend", ["raw.pay"])
    assert b.source_tables == ["staging.spend", "raw.people"]
    assert a.aggregations == ["COUNT", "SUM"] and c.aggregations == []
    assert (a.has_group_by, a.has_where, b.has_group_by, b.has_where) == (True, False, False, True)
    assert a.stmt_id == "stmt_0" and a.raw_sql.endswith(";") and not a.clean_sql.endswith(";")


@pytest.mark.parametrize(
    "text, kind, target",
    [
        ("create table A.B as select 1 from x", "CTAS", "a.b"),
        ("CREATE OR REPLACE TABLE t AS WITH q AS (SELECT 1 FROM a) SELECT * FROM q", "CTAS", "t"),
        ("CREATE TABLE t AS (SELECT 1 FROM a)", "CTAS", "t"),
        ("INSERT INTO t(a, b) SELECT 1, 2 FROM x", "INSERT_SELECT", "t"),
        ("INSERT INTO s.t (a)\nWITH q AS (SELECT 1 FROM z) SELECT * FROM q", "INSERT_SELECT", "s.t"),
        ("INSERT INTO t VALUES (1)", "INSERT_VALUES", "t"),
        ("INSERT INTO t (a) VALUES (1)", "INSERT_VALUES", "t"),
        ("SELECT 1 FROM dual", "UNKNOWN", None),
        ("MERGE INTO t USING s ON (1 = 1) WHEN MATCHED THEN UPDATE SET a = 1", "UNKNOWN", None),
        ("SELECT 'CREATE TABLE t AS SELECT 1' FROM x", "UNKNOWN", None),
        ("INSERT INTO tSELECT x", "UNKNOWN", None),
    ],
)
def test_statement_type_and_target(scripts, text, kind, target):
    (r,) = one(scripts, text)
    assert (r.statement_type, r.target_table) == (kind, target)
    assert r.label == ("stmt_0" if target is None else r.label)


@pytest.mark.parametrize(
    "text, sources",
    [
        ("SELECT * FROM a JOIN b.c ON 1=1 LEFT JOIN a x ON 1=1", ["a", "b.c"]),
        ("SELECT SYSDATE FROM DUAL", []),
        ("SELECT valid_from AS v FROM t", ["t"]),
        ("SELECT 'from x' FROM t -- from y\n/* join z */", ["t"]),
        ("WITH q AS (SELECT 1 FROM a) SELECT * FROM q JOIN b ON 1=1", ["a", "b"]),
        ("WITH Q (n) AS (SELECT 1 FROM a) SELECT * FROM q", ["a"]),
        ("INSERT INTO t SELECT * FROM t JOIN u ON 1=1", ["u"]),
        ("SELECT EXTRACT(YEAR FROM d) FROM t", ["d", "t"]),
        ("SELECT * FROM a, b", ["a"]),
    ],
)
def test_sources(scripts, text, sources):
    assert one(scripts, text)[0].source_tables == sources


def test_separators_in_literals_comments_and_names(scripts):
    a, b = one(scripts, "SELECT ';' , \"x;y\" FROM a -- ; no\n; /* ; */ SELECT 'it''s;' FROM b; -- end;")
    assert a.source_tables == ["a"] and b.source_tables == ["b"]
    assert a.raw_sql == "SELECT ';' , \"x;y\" FROM a -- ; no\n;"
    assert b.clean_sql == "SELECT 'it''s;' FROM b"
    assert b.raw_sql == "/* ; */ SELECT 'it''s;' FROM b;"


def test_comment_words_do_not_set_flags(scripts):
    (r,) = one(scripts, "SELECT a FROM t -- where group by\n")
    assert (r.has_where, r.has_group_by) == (False, False)


def test_all_nine_aggregates(scripts):
    calls = ", ".join(f"{name.lower()} (x)" for name in sql.AGGREGATES)
    (r,) = one(scripts, f"SELECT {calls}, my_sum(x), summary FROM t")
    assert r.aggregations == sorted(sql.AGGREGATES)


def test_blocks_are_dropped_or_unwrapped(scripts):
    text = "BEGIN INSERT INTO t SELECT 1 FROM a; END /* x */ ; SELECT 2 FROM b"
    assert [r.source_tables for r in one(scripts, text)] == [["b"]]
    assert [r.source_tables for r in one(scripts, text, blocks="unwrap")] == [["a"], ["b"]]
    with pytest.raises(ValueError):
        catalog.statements(scripts(text), blocks="keep")


def test_rejected(scripts):
    table = scripts("", "  \n", "-- only\n/* remarks; */ ;;", "SELECT 1 FROM a", "SELECT '" + "x" * 6_000_000 + "' FROM a")
    got = {r.script_id: r.reason for r in catalog.rejected(table).collect()}
    assert got == {0: "no statements", 1: "no statements", 2: "no statements"}
    assert {r.script_id for r in catalog.statements(table).select("script_id").collect()} == {3, 4}


def test_long_runs_of_comments_and_blanks(scripts):
    remarks = "BEGIN x := CASE WHEN 1 THEN 2 END" + "\n-- remark" * 20_000 + "\n; SELECT 1 FROM a"
    blanks = "SELECT 1" + " " * 1_000_000 + "FROM b"
    got = catalog.statements(scripts(remarks, blanks)).select("script_id", "source_tables").collect()
    assert {r.script_id: r.source_tables for r in got if r.source_tables} == {0: ["a"], 1: ["b"]}


def test_normalise(scripts):
    text = "SELECT  a,\t{{ ref('x') }} --c\nFROM {% if b %} t {%- endif -%}\n\n\n\nWHERE '--' = b /* d\n */ "
    got = catalog.normalised(scripts(text)).first().clean_text
    assert got == "SELECT a, __JINJA_EXPR__ \nFROM t \n\nWHERE '--' = b"


def test_veil_round_trip(spark, scripts):
    text = "a 'q; ''w' -- c;\n\"d e\" /* f */ - / ö '\U0001F600' 'open"
    df = scripts(text).select(sql.unveil(sql.veil(F.col("sql_text"))).alias("back"), sql.veil(F.col("sql_text")).alias("v"))
    r = df.first()
    assert r.back == text
    assert ";" not in r.v


def test_blanks_keep_offsets(scripts):
    text = "SELECT 1 -- über\nFROM /* a\nb */ t WHERE x = 'from\ny' AND \"a b\" = '' OR z = 'open"
    got = scripts(text).select(sql.blanked(F.col("sql_text")).alias("t")).first().t
    assert got == "SELECT 1        \nFROM     \n     t WHERE x = '    \n ' AND \"   \" = '' OR z = '    "


def test_blocks_left_open_take_linear_time(scripts):
    """50,000 BEGINs without an END, and as many with one behind them all."""
    import time

    def seconds(n):
        table = scripts("BEGIN x " * n + "; SELECT 1 FROM t", "BEGIN x " * n + "END; SELECT 1 FROM u", "{{ x " * n, "END; " * n + "SELECT 2 FROM v")
        started = time.perf_counter()
        got = catalog.statements(table).groupBy("script_id").agg(F.count("stmt_no").alias("n")).collect()
        catalog.normalised(table).agg(F.max(F.length("clean_text"))).collect()
        assert {r.script_id: r.n for r in got} == {0: 2, 1: 1, 2: 1, 3: n + 1}
        return time.perf_counter() - started

    seconds(100)
    assert seconds(50_000) < 20


def test_blocks_end_at_the_first_end_before_a_semicolon(scripts):
    text = "BEGIN a; BEGIN b; END IF; c; END /* x */ ; SELECT 1 FROM t; END; SELECT 2 FROM u; begin d"
    got = [r.clean_sql for r in catalog.statements(scripts(text)).orderBy("stmt_no").collect()]
    assert got == ["SELECT 1 FROM t", "END", "SELECT 2 FROM u", "begin d"]
    text = "BEGIN CREATE TABLE x AS SELECT 1 FROM a; END; SELECT 2 FROM u"
    got = [r.clean_sql for r in catalog.statements(scripts(text), blocks="unwrap").orderBy("stmt_no").collect()]
    assert got == ["CREATE TABLE x AS SELECT 1 FROM a", "SELECT 2 FROM u"]


def test_labels(spark):
    df = spark.createDataFrame([("a-b",), ("1x",), ("",), ("ok_1",)], "label string")
    assert [r[0] for r in df.select(sql.safe_label(F.col("label"))).collect()] == ["a_b", "task_1x", "task_", "ok_1"]


def test_unsafe_labels(scripts):
    table = catalog.statements(scripts("CREATE TABLE s.a$b AS SELECT 1 FROM x"))
    r = catalog.rejected_labels(table).first()
    assert (r.label, r.task_id) == ("create_a$b", "create_a_b")


def test_tables_touched_rollup_and_most_read(scripts):
    table = catalog.statements(scripts(CHAIN, "SELECT 1 FROM raw.pay"))
    touched = {(r.script_id, r.table, r.role) for r in catalog.tables_touched(table).collect()}
    assert (0, "mart.summary", "read") in touched and (0, "mart.summary", "write") in touched and len(touched) == 8
    roll = {r.statement_type: (r.statements, r.scripts) for r in catalog.type_rollup(table).collect()}
    assert roll == {"CTAS": (2, 1), "INSERT_SELECT": (1, 1), "UNKNOWN": (1, 1)}
    assert [(r.table, r.readers) for r in catalog.most_read(table, 1).collect()] == [("raw.pay", 2)]


def test_snapshot_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "script_id int, sql_text string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "script_id int, sql_text string")
    assert {(r.script_id, r.change) for r in catalog.snapshot_changes(old, new).collect()} == {
        (2, "changed"), (3, "removed"), (4, "added"),
    }


DIAMOND = """CREATE TABLE a AS SELECT x FROM raw.r; CREATE TABLE b AS SELECT x FROM a;
CREATE TABLE c AS SELECT x FROM a; CREATE TABLE d AS SELECT b.x FROM b JOIN c ON 1 = 1"""
CYCLE = "CREATE TABLE a AS SELECT x FROM b; CREATE TABLE b AS SELECT x FROM a; CREATE TABLE c AS SELECT x FROM raw.r"
REBUILD = "CREATE TABLE t AS SELECT x FROM r; CREATE TABLE u AS SELECT x FROM t; INSERT INTO t SELECT x FROM u"


@pytest.mark.parametrize(
    "text, edges, levels",
    [
        (CHAIN, {(0, 1), (1, 2)}, [0, 1, 2]),
        (DIAMOND, {(0, 1), (0, 2), (1, 3), (2, 3)}, [0, 1, 1, 2]),
        ("CREATE TABLE a AS SELECT 1 FROM x; CREATE TABLE b AS SELECT 1 FROM y", set(), [0, 0]),
        (CYCLE, {(0, 1), (1, 0)}, [None, None, 0]),
        ("SELECT 1 FROM a; CREATE TABLE b AS SELECT 1 FROM c", set(), [0, 0]),
        ("CREATE TABLE b AS SELECT x FROM a; CREATE TABLE a AS SELECT x FROM r", {(1, 0)}, [1, 0]),
        (REBUILD, {(1, 2), (2, 1)}, [0, None, None]),
    ],
)
def test_statement_graph(scripts, text, edges, levels):
    table = catalog.statements(scripts(text))
    links = statement_graph.edges(table)
    assert edge_set(links) == edges
    placed = statement_graph.levels(table, links)
    got = {r.stmt_no: r.level for r in placed.collect()}
    assert [got[i] for i in range(len(levels))] == levels
    assert {r.stmt_no for r in statement_graph.cycles(links).collect()} == {i for i, v in enumerate(levels) if v is None}


def test_cycles_leave_out_what_waits_behind_them(scripts):
    text = """CREATE TABLE a AS SELECT x FROM b; CREATE TABLE b AS SELECT x FROM a; CREATE TABLE c AS SELECT x FROM b;
        CREATE TABLE d AS SELECT x FROM c JOIN e USING (x); CREATE TABLE e AS SELECT x FROM d; CREATE TABLE f AS SELECT x FROM e"""
    links = statement_graph.edges(catalog.statements(scripts(text)))
    got = {(r.stmt_no, r.component) for r in statement_graph.cycles(links).collect()}
    assert got == {(0, 0), (1, 0), (3, 3), (4, 3)}


def test_nearest_prior_writer(scripts):
    table = catalog.statements(scripts(REBUILD, "CREATE TABLE b AS SELECT x FROM a; CREATE TABLE a AS SELECT x FROM r"))
    got = {(r.script_id, r.src, r.dst) for r in statement_graph.edges(table, "nearest_prior").collect()}
    assert got == {(0, 0, 1), (0, 1, 2)}
    with pytest.raises(ValueError):
        statement_graph.edges(table, "all")


def test_predecessors_and_labels(scripts):
    table = catalog.statements(scripts(DIAMOND))
    links = statement_graph.edges(table)
    before = {r.stmt_no: r.predecessors for r in statement_graph.predecessors(links).collect()}
    assert before == {1: [0], 2: [0], 3: [1, 2]}
    named = statement_graph.dependency_labels(table, links, statement_graph.levels(table, links))
    assert {(r.upstream, r.downstream, r.level) for r in named.collect()} == {
        ("create_a", "create_b", 1), ("create_a", "create_c", 1), ("create_b", "create_d", 2), ("create_c", "create_d", 2),
    }


def test_labels_of_one_table_merge(scripts):
    text = "INSERT INTO t SELECT x FROM a; CREATE TABLE u AS SELECT x FROM t; INSERT INTO t SELECT x FROM b"
    table = catalog.statements(scripts(text))
    assert edge_set(statement_graph.edges(table)) == {(2, 1)}


QUOTED = """CREATE TABLE "Mart"."My, T" AS WITH "From Here" AS (SELECT "A b", 'it "is" from x' AS c FROM "raw"."Orders x")
SELECT "A b" AS "Total", c FROM "From Here" h"""


def test_quoted_names(scripts):
    from millrace.plans import models

    table = catalog.statements(scripts(QUOTED))
    (row,) = table.collect()
    assert (row.statement_type, row.target_table, row.source_tables) == ("CTAS", '"mart"."my, t"', ['"raw"."orders x"'])
    assert (row.label, row.raw_sql, row.clean_sql) == ('create_"my, t"', QUOTED, QUOTED)
    found = models.model_columns(models.models(table)).orderBy("ord", "item").collect()
    assert [(r.model, r.column) for r in found] == [
        ('"from here"', "a b"), ('"from here"', "c"), ('"mart"."my, t"', "total"), ('"mart"."my, t"', "c"),
    ]
    shown = [str(v) for r in [row, *found] for k, v in r.asDict().items() if k != "veiled"]
    assert not any(0x10F000 <= ord(ch) < 0x10F100 for v in shown for ch in v)


def test_a_single_double_quote_is_no_name(scripts):
    (row,) = catalog.statements(scripts("INSERT INTO a.t SELECT 'x\" y' AS q FROM b.s -- \"")).collect()
    assert (row.target_table, row.source_tables) == ("a.t", ["b.s"])
