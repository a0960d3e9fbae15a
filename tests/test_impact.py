import pytest

from millrace.operators import graph
from millrace.operators.staging import stage
from millrace.plans import catalog, impact, lineage, models, trace

CHAIN = """
CREATE TABLE staging.spend AS SELECT id, SUM(x) AS total, COUNT(*) AS n FROM raw.pay GROUP BY id;
CREATE TABLE mart.summary AS SELECT c.id, c.name, s.total, s.n FROM staging.spend s JOIN raw.people c ON s.id = c.id;
INSERT INTO mart.top SELECT id, name, total FROM mart.summary WHERE total > 10;
"""
CTES = """CREATE TABLE mart.tides AS
WITH gauges AS (SELECT gauge_no, MAX(level) AS peak FROM sea.readings GROUP BY gauge_no),
Coasts AS (SELECT g.gauge_no, g.peak AS height, h.coast FROM sea.harbours h JOIN gauges g USING (gauge_no)),
steep AS (SELECT coast, height * 100 AS centimetres FROM coasts WHERE height > 3)
SELECT centimetres, coast FROM steep"""
LOOP = "CREATE TABLE t AS SELECT a FROM r; CREATE TABLE u AS SELECT a FROM t; INSERT INTO t SELECT a FROM u"


class Corpus:
    def __init__(self, scripts, *texts):
        self.statements = catalog.statements(scripts(*texts))
        self.models = models.models(self.statements)
        self.digest = impact.digest(self.models)
        self.index = impact.column_index(self.digest)
        self.edges = impact.model_edges(self.digest)
        self.tasks = impact.tasks(self.statements)
        self.reading = impact.task_reads(self.tasks, self.digest)

    def impact(self):
        return {(r.script_id, r.column): r for r in impact.impact(self.index, self.edges, self.reading).collect()}

    def critical(self):
        first = self.digest.selectExpr("script_id", "name AS model", "struct(stmt_no, ord) AS place")
        first = first.groupBy("script_id", "model").agg({"place": "min"}).withColumnRenamed("min(place)", "place")
        return {r.column: r.path for r in impact.critical_path(self.index, self.edges, first).collect()}


def test_chain_impact(scripts):
    c = Corpus(scripts, CHAIN)
    got = c.impact()
    total = got[(0, "total")]
    assert total.affected_models == ["mart.summary", "mart.top", "staging.spend"]
    assert total.affected_tasks == ["stmt_1", "stmt_2"] and total.blast_radius == 5
    n = got[(0, "n")]
    assert n.affected_models == ["mart.summary", "staging.spend"]
    assert n.affected_tasks == ["stmt_1", "stmt_2"]
    assert got[(0, "name")].affected_tasks == ["stmt_2"]
    assert (0, "unknown") not in got


def test_tree_and_critical_path(scripts):
    c = Corpus(scripts, CHAIN)
    tree = {(r.column, r.parent): r.children for r in impact.dependency_tree(c.index, c.edges).collect()}
    assert tree[("total", "staging.spend")] == ["mart.summary"] and tree[("total", "mart.top")] == []
    paths = c.critical()
    assert paths["total"] == ["staging.spend", "mart.summary", "mart.top"]
    assert paths["n"] == ["staging.spend", "mart.summary"] and paths["name"] == ["mart.summary", "mart.top"]


def test_cyclic_models_have_the_first_one_as_path(scripts):
    c = Corpus(scripts, LOOP)
    assert {(r.src, r.dst) for r in c.edges.collect()} == {("t", "u"), ("u", "t")}
    assert c.critical() == {"a": ["t"]}
    assert c.impact()[(0, "a")].affected_models == ["t", "u"]


def test_model_graph_needs_an_earlier_definition(scripts):
    c = Corpus(scripts, "CREATE TABLE b AS SELECT x FROM a; CREATE TABLE a AS SELECT x FROM r; CREATE TABLE c AS SELECT x FROM a")
    assert {(r.src, r.dst) for r in c.edges.collect()} == {("a", "c")}


def test_ctes_of_any_case_join_the_graph(scripts):
    c = Corpus(scripts, CTES)
    assert {(r.src, r.dst) for r in c.edges.collect()} == {
        ("gauges", "coasts"), ("coasts", "steep"), ("steep", "mart.tides"),
    }
    closed = {(r.src, r.dst) for r in graph.closure(c.edges, ["script_id"]).collect()}
    assert ("gauges", "mart.tides") in closed and len(closed) == 6


def test_same_short_name_in_two_schemas(scripts):
    c = Corpus(scripts, "CREATE TABLE staging.o AS SELECT a FROM r; CREATE TABLE mart.o AS SELECT a FROM staging.o")
    assert {(r.src, r.dst) for r in c.edges.collect()} == {("staging.o", "mart.o")}


def test_last_definition_counts(scripts):
    c = Corpus(scripts, "CREATE TABLE t AS SELECT a FROM r; INSERT INTO t SELECT b FROM s")
    assert [(r.column, r.model) for r in c.index.collect()] == [("b", "t")]


def test_rename(spark, scripts):
    c = Corpus(scripts, CHAIN, "CREATE TABLE x.y AS SELECT 'total' AS k,\n  Total + 1 AS total\nFROM t")
    renames = spark.createDataFrame([(0, "total", "amount"), (1, "TOTAL", "amount"), (0, "nope", "x")],
                                    "script_id bigint, old_value string, new_value string")
    got = {(r.script_id, r.file_path): r for r in impact.rename_impact(*impact.word_index(c.models), c.index, renames).collect()}
    assert set(got) == {(0, "models/spend.sql"), (0, "models/summary.sql"), (0, "models/top.sql"), (1, "models/y.sql")}
    hit = got[(1, "models/y.sql")]
    assert (hit.line_hint, hit.change_type, hit.old_value, hit.new_value) == ("Total + 1 AS total", "rename", "TOTAL", "amount")


def test_renames_read_the_stored_index_only(spark, scripts):
    c = Corpus(scripts, CHAIN)
    words, hints = (stage(t, n) for t, n in zip(impact.word_index(c.models), ("words", "hints")))
    renames = spark.createDataFrame([(0, "total", "amount")], "script_id bigint, old_value string, new_value string")
    index = stage(c.index, "columns")
    found = impact.rename_impact(words, hints, index, renames)
    read = {f.split("/millrace/")[1].split("/")[1].split("-")[0] for f in found.inputFiles()}
    assert read == {"words", "hints", "columns"} and found.count() == 3
    one = words.where("word = 'total' AND script_id = 0")
    assert "EqualTo(word,total)" in one._jdf.queryExecution().executedPlan().toString() and one.count() > 0


@pytest.mark.parametrize(
    "v1, v2, changed, breaking, summary",
    [
        ("SELECT a, b FROM t", "SELECT a, b FROM t", {}, False, "No changes detected"),
        ("SELECT a, b FROM t", "SELECT a FROM t", {"removed": ["b"]}, True, "1 column(s) removed: ['b']"),
        ("SELECT a FROM t", "SELECT a, b FROM t", {"added": ["b"]}, False, "1 column(s) added (non-breaking)"),
        ("SELECT a, b FROM t", "SELECT a, b AS c FROM t", {"renamed": ["b -> c"]}, True, "1 column(s) renamed"),
        ("SELECT CAST(x AS INT) AS a FROM t", "SELECT CAST(x AS TEXT) AS a FROM t", {"type_changes": ["a INT -> TEXT"]}, True,
         "1 type change(s)"),
        ("SELECT CAST(x AS DECIMAL(8,2)) AS a FROM t", "SELECT x AS a FROM t", {}, False, "No changes detected"),
        ("SELECT a, b, c FROM t", "SELECT a, d FROM t", {"removed": ["b", "c"], "added": ["d"]}, True,
         "2 column(s) removed: ['b', 'c']; 1 column(s) added (non-breaking)"),
        ("SELECT A FROM t -- CAST(a AS INT)", "SELECT a FROM t", {}, False, "No changes detected"),
        ("", "SELECT a FROM t", {"added": ["a"]}, False, "1 column(s) added (non-breaking)"),
        ("WITH q AS (SELECT a, b FROM t) SELECT a FROM q", "WITH q AS (SELECT a FROM t) SELECT a FROM q", {}, False,
         "No changes detected"),
    ],
)
def test_breaking_changes(spark, v1, v2, changed, breaking, summary):
    df = spark.createDataFrame([(5, v1, v2)], "script_id int, v1 string, v2 string")
    (r,) = impact.breaking_changes(df).collect()
    for field in ("added", "removed", "renamed", "type_changes"):
        assert r[field] == changed.get(field, [])
    assert (r.is_breaking, r.summary) == (breaking, summary)


def ask(spark, scripts, text, *columns):
    c = Corpus(scripts, text)
    questions = spark.createDataFrame([(0, x) for x in columns], "script_id bigint, column string")
    steps = trace.trace_steps(c.models, questions)
    roll = {r.column: r for r in trace.trace_rollup(steps, c.statements, questions).collect()}
    return sorted(steps.collect(), key=lambda r: (r.column, r.hop)), roll


def test_trace_follows_aliases(spark, scripts):
    steps, roll = ask(spark, scripts, CTES, "level", "missing")
    assert [(r.model_name, r.input_col, r.output_col, r.transformation) for r in steps] == [
        ("gauges", "level", "peak", "aggregate:MAX"),
        ("coasts", "peak", "height", "rename"),
        ("steep", "height", "centimetres", "rename"),
        ("tides", "centimetres", "centimetres", "passthrough"),
    ]
    assert [r.hop for r in steps] == [1, 2, 3, 4]
    r = roll["level"]
    assert (r.found, r.depth, r.final_output, r.source_table) == (True, 4, "tides", "sea.readings")
    r = roll["missing"]
    assert (r.found, r.depth, r.final_output, r.source_table) == (False, 0, None, None)


def test_trace_takes_the_first_mention_and_skips_silent_ctes(spark, scripts):
    text = """WITH a AS (SELECT x + 1 AS y, x AS z FROM t), b AS (SELECT q FROM u), c AS (SELECT COALESCE(y, 0) FROM a)
    SELECT y AS out FROM c"""
    steps, roll = ask(spark, scripts, text, "x")
    assert [(r.model_name, r.output_col, r.snippet) for r in steps] == [
        ("a", "y", "x + 1 AS y"), ("c", "y", "COALESCE(y, 0)"), ("final_output", "out", "y AS out"),
    ]
    assert roll["x"].final_output == "final_output" and roll["x"].source_table == "t"


def test_trace_restarts_per_statement_and_asks_by_any_case(spark, scripts):
    steps, roll = ask(spark, scripts, "CREATE TABLE a AS SELECT x AS y FROM t; CREATE TABLE b AS SELECT x, y FROM a", "X")
    assert [(r.stmt_no, r.model_name, r.input_col, r.output_col) for r in steps] == [(0, "a", "x", "y"), (1, "b", "x", "x")]
    assert (roll["x"].final_output, roll["x"].source_table) == ("b", "t")


def test_words_in_literals_are_no_mention_and_quoted_names_are(spark, scripts):
    steps, _ = ask(spark, scripts, "SELECT 'x' AS a, 'a \"x\" b' AS b, f(x) AS c FROM t", "x")
    assert [r.output_col for r in steps] == ["c"]
    steps, _ = ask(spark, scripts, "SELECT 'x' AS a, \"x\" AS b, f(x) AS c FROM t", "x")
    assert [r.output_col for r in steps] == ["b"]


def test_an_alias_counts_as_a_mention(spark, scripts):
    steps, _ = ask(spark, scripts, "SELECT SUM(amount) AS total FROM t", "total")
    assert [(r.input_col, r.output_col, r.transformation) for r in steps] == [("total", "total", "aggregate:SUM")]


def graph_of(scripts, text):
    c = Corpus(scripts, text)
    nodes = lineage.nodes(c.digest, c.tasks)
    edges = lineage.edges(c.digest, c.tasks)
    return nodes, edges


def test_lineage(scripts):
    nodes, edges = graph_of(scripts, CHAIN + "; INSERT INTO ref.codes VALUES (1)")
    kind = {r.id: (r.node_type, r.column_count, r.label) for r in nodes.collect()}
    assert kind == {
        "staging.spend": ("cte", 3, "spend"), "mart.summary": ("dbt_model", 4, "summary"), "mart.top": ("dbt_model", 3, "top"),
        "raw.pay": ("table", 0, "pay"), "raw.people": ("table", 0, "people"), "ref.codes": ("cte", 0, "codes"),
        "stmt_0": ("dag_task", 0, "create_spend"), "stmt_1": ("dag_task", 0, "create_summary"),
        "stmt_2": ("dag_task", 0, "insert_top"), "stmt_3": ("dag_task", 0, "insert_codes"),
    }
    links = {(r.source, r.target) for r in edges.collect()}
    assert links == {
        ("raw.pay", "staging.spend"), ("staging.spend", "mart.summary"), ("raw.people", "mart.summary"),
        ("mart.summary", "mart.top"), ("raw.pay", "stmt_0"), ("staging.spend", "stmt_1"),
        ("raw.people", "stmt_1"), ("mart.summary", "stmt_2"),
    }
    near = {r.id: (r.upstream, r.downstream, r.in_degree, r.out_degree) for r in lineage.neighbours(nodes, edges).collect()}
    assert near["mart.summary"] == (["raw.people", "staging.spend"], ["mart.top", "stmt_2"], 2, 2)
    node, edge = lineage.export(nodes, edges)
    assert "label" in node.columns and edge.columns == ["script_id", "source", "target"]


def test_undotted_reference_and_definition_beats_reference(scripts):
    nodes, _ = graph_of(scripts, "CREATE TABLE b AS SELECT x FROM a; CREATE TABLE a AS SELECT y FROM loose")
    kind = {r.id: (r.node_type, r.column_count) for r in nodes.where("node_type <> 'dag_task'").collect()}
    assert kind == {"b": ("cte", 1), "a": ("cte", 1), "loose": ("cte", 0)}


def test_snippets_are_short(scripts):
    words = ", ".join(f"column_{i}" for i in range(80))
    nodes, _ = graph_of(scripts, f"CREATE TABLE b AS SELECT   {words}\nFROM a")
    snippet = nodes.where("id = 'b'").first().snippet
    assert len(snippet) <= 300 and snippet.endswith(", [...]".lstrip(", ")) and snippet.startswith("SELECT column_0, column_1")


TWO_SCHEMAS = """INSERT INTO staging.o SELECT x FROM raw.o; INSERT INTO mart.o SELECT x FROM staging.o;
CREATE TABLE mart.p AS SELECT x FROM o; CREATE TABLE mart.q AS SELECT x FROM mart.o"""


def test_two_schemas_agree_in_every_graph(scripts):
    c = Corpus(scripts, TWO_SCHEMAS)
    edges = {(r.src, r.dst) for r in c.edges.collect()}
    assert edges == {("staging.o", "mart.o"), ("staging.o", "mart.p"), ("mart.o", "mart.p"), ("mart.o", "mart.q")}
    refs = {r.stmt_no: (r.model_refs, r.source_refs) for r in models.model_refs(c.models).collect()}
    assert refs == {0: ([], ["raw.o"]), 1: (["o"], []), 2: (["o"], []), 3: (["o"], [])}
    x = c.impact()[(0, "x")]
    assert x.affected_models == ["mart.o", "mart.p", "mart.q", "staging.o"] and x.affected_tasks == ["stmt_1", "stmt_2", "stmt_3"]
    nodes, links = lineage.nodes(c.digest, c.tasks), lineage.edges(c.digest, c.tasks)
    assert {r.id: r.label for r in nodes.where("node_type = 'dag_task'").collect()} == {
        "stmt_0": "insert_o", "stmt_1": "insert_o", "stmt_2": "create_p", "stmt_3": "create_q",
    }
    linked = {(r.source, r.target) for r in links.collect()}
    assert edges < linked and ("staging.o", "stmt_2") in linked and ("mart.o", "stmt_2") in linked
    assert not {s for s, _ in linked} - {r.id for r in nodes.collect()}
