import pytest

from millrace.plans import catalog, dbt, models, patterns

CTES = """CREATE TABLE mart.offer AS
WITH ripe AS (SELECT variety, COUNT(tree_no) AS trees FROM farm.trees WHERE age > 4 GROUP BY variety),
Prices AS (SELECT v.name, v.cents / 100 AS euros FROM farm.varieties v),
worth AS (SELECT r.variety, r.trees * p.euros AS total FROM prices p JOIN ripe r ON r.variety = p.name)
SELECT total, variety FROM worth"""


def parse(scripts, *texts):
    return models.models(catalog.statements(scripts(*texts)))


def selects(scripts, text):
    return sorted(parse(scripts, text).collect(), key=lambda r: (r.stmt_no, r.ord))


def items(scripts, text):
    return [r["items"] for r in selects(scripts, text)]


def columns(scripts, text):
    rows = models.model_columns(parse(scripts, text)).collect()
    return [r for r in sorted(rows, key=lambda r: (r.stmt_no, r.ord, r.item))]


def test_ctes_and_final_select(scripts):
    rows = selects(scripts, CTES)
    assert [r.name for r in rows] == ["ripe", "prices", "worth", "mart.offer"]
    assert [r.is_final for r in rows] == [False, False, False, True]
    assert rows[2].body == "SELECT r.variety, r.trees * p.euros AS total FROM prices p JOIN ripe r ON r.variety = p.name"
    assert rows[3].body == "SELECT total, variety FROM worth"
    assert rows[3]["items"] == ["total", "variety"]


@pytest.mark.parametrize(
    "text, names",
    [
        ("WITH a (x, y) AS (SELECT 1 FROM t) SELECT * FROM a", ["a", None]),
        ("WITH RECURSIVE a AS (SELECT 1 FROM t UNION ALL SELECT 2 FROM a) SELECT * FROM a", ["a", None]),
        ("WITH a AS MATERIALIZED (SELECT 1 FROM t), b AS NOT MATERIALIZED (SELECT 2 FROM a) SELECT * FROM b", ["a", "b", None]),
        ("INSERT INTO t WITH a AS (SELECT (1) FROM t2) SELECT * FROM a", ["a", "t"]),
        ("WITH a AS (WITH z AS (SELECT 1 FROM q) SELECT * FROM z) SELECT * FROM a", ["a", None]),
        ("CREATE TABLE t AS (SELECT a FROM b)", ["t"]),
        ("INSERT INTO t VALUES (1)", ["t"]),
    ],
)
def test_names(scripts, text, names):
    assert [r.name for r in selects(scripts, text)] == names


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT a, f(b, g(c, d)), e FROM t", ["a", "f(b, g(c, d))", "e"]),
        ("SELECT EXTRACT(YEAR FROM d) AS y, (SELECT MAX(v) FROM m) AS top, z FROM t",
         ["EXTRACT(YEAR FROM d) AS y", "(SELECT MAX(v) FROM m) AS top", "z"]),
        ("SELECT a FROM t UNION ALL SELECT b, c FROM u", ["a"]),
        ("SELECT * FROM t", ["*"]),
        ("SELECT 1", None),
        ("CREATE TABLE t AS (SELECT a, b FROM c)", ["a", "b"]),
        ("SELECT a,, b FROM t", ["a", "b"]),
        ("MERGE INTO t USING (SELECT a, b FROM s) x ON (1 = 1)", ["a", "b"]),
        ("SELECT selected, from_date FROM t", ["selected", "from_date"]),
    ],
)
def test_items(scripts, text, expected):
    assert items(scripts, text) == [expected]


def test_commas_and_words_inside_literals(scripts):
    rows = columns(scripts, "CREATE TABLE t AS SELECT 'a, b FROM c' AS x, \"p, from q\", y FROM z")
    assert [(r.column, r.expr) for r in rows] == [
        ("x", "'a, b FROM c' AS x"), ("p, from q", '"p, from q"'), ("y", "y"),
    ]


@pytest.mark.parametrize(
    "expr, name, kind, data_type, description",
    [
        ("t.amount", "amount", "passthrough", "", "Column: amount"),
        ("amount AS Total", "total", "rename", "", "Column: total"),
        ("SUM(x) AS s", "s", "aggregate:SUM", "", "SUM of s"),
        ("SUM(x) OVER (ORDER BY y) AS s", "s", "aggregate:SUM", "", "SUM of s"),
        ("RANK() OVER (ORDER BY y) AS r", "r", "window_function", "", "Window function result: r"),
        ("CAST(x AS int) AS c", "c", "cast:INT", "INT", "Cast column: c"),
        ("CAST(f(x) AS DECIMAL(10, 2)) AS c", "c", "cast:DECIMAL(10,2)", "DECIMAL(10,2)", "Cast column: c"),
        ("a + b", "b", "arithmetic", "", "Column: b"),
        ("COALESCE(a, b)", "b", "null_handling", "", "Column: b"),
        ("NVL(a, b) AS n", "n", "rename", "", "Column: n"),
        ("CASE WHEN a THEN b END", "end", "case_expression", "", "Column: end"),
        ("'2024-01-01' AS d", "d", "rename", "", "Column: d"),
        ("COUNT(*)", "count", "aggregate:COUNT", "", "COUNT of count"),
        ("c.*", "c", "arithmetic", "", "Column: c"),
        ("DISTINCT customer", "customer", "passthrough", "", "Column: customer"),
    ],
)
def test_column_facts(scripts, expr, name, kind, data_type, description):
    (r,) = columns(scripts, f"CREATE TABLE m AS SELECT {expr} FROM t")
    assert (r.column, r.transformation, r.data_type, r.description) == (name, kind, data_type, description)


def test_star(scripts):
    (r,) = columns(scripts, "CREATE TABLE m AS SELECT * FROM t")
    assert (r.column, r.description) == ("*", "All columns from upstream")


def test_column_counts(scripts):
    text = "CREATE TABLE m AS SELECT * FROM t; CREATE TABLE n AS SELECT a, f(b, c) FROM t; INSERT INTO o VALUES (1)"
    got = {r.model: r.column_count for r in models.column_counts(parse(scripts, text)).collect()}
    assert got == {"m": 1, "n": 2}


def test_catalog(scripts):
    text = CTES + """; CREATE TABLE staging.u AS SELECT a, 'x' AS k FROM b UNION ALL SELECT a, 'y' AS k FROM c;
    CREATE TABLE plain AS SELECT RANK() OVER (ORDER BY a) AS r FROM b"""
    rows = {r.name: r for r in models.model_catalog(parse(scripts, text)).collect()}
    assert {n: (r.kind, r.layer, r.materialized) for n, r in rows.items()} == {
        "ripe": ("cte", "staging", "table"), "prices": ("cte", "staging", "view"), "worth": ("cte", "staging", "view"),
        "offer": ("target", "marts", "view"), "u": ("target", "staging", "view"), "plain": ("target", "staging", "table"),
    }
    assert rows["ripe"].description == "dbt model: ripe. Aggregated grain."
    assert rows["u"].description == "dbt model: u. UNION ALL of multiple sub-selects."
    assert rows["plain"].description == "dbt model: plain. Contains window functions."


def test_refs_and_sources(scripts):
    parsed = parse(scripts, CTES + "; INSERT INTO x SELECT total AS month FROM mart.offer JOIN farm.trees r ON 1 = 1")
    got = {r.model: (r.model_refs, r.source_refs) for r in models.model_refs(parsed).collect()}
    assert got == {
        "ripe": ([], ["farm.trees"]), "prices": ([], ["farm.varieties"]), "worth": (["prices", "ripe"], []),
        "offer": (["worth"], []), "x": (["offer"], ["farm.trees"]),
    }
    sources = {r.schema: r.tables for r in models.source_catalog(parsed).collect()}
    assert sources == {"farm": ["trees", "varieties"]}


def test_items_rebuild_the_select_list(scripts):
    listing = "a, f(b, (c), g(d, 'x,y')), CASE WHEN e IN (1, 2) THEN 3 END AS h , i"
    (parts,) = items(scripts, f"SELECT {listing} FROM t")
    assert len(parts) == 4 and ",".join(parts).replace(" ", "").count(",") == listing.count(",") - 1


def test_dbt_records(spark):
    text = """{{ config(tags=['a'], materialized = "TABLE", x=1) }}
    SELECT * FROM {{ ref('a') }} JOIN {{ref("b")}} JOIN {{ ref( 'a' ) }} JOIN {{ source('s', "t") }} JOIN {{ source('s','t') }}
    {%- if is_incremental() -%} WHERE 1 = 1 {% endif %}"""
    df = spark.createDataFrame(
        [("p", "m", text), ("p", "a", "SELECT 1"), ("p", "bad-name", "SELECT 1"), ("p", "b", "SELECT {{ ref('a') }} {{ ref('zz') }}")],
        "project string, name string, sql_text string",
    )
    rows = {r.name: r for r in dbt.parse(df).collect()}
    m = rows["m"]
    assert m.deps == ["a", "b"] and [tuple(s) for s in m.sources] == [("s", "t")]
    assert (m.materialization, m.is_incremental) == ("table", True)
    assert (rows["a"].materialization, rows["a"].is_incremental) == ("view", False)
    assert {(r.name, r.reason) for r in dbt.rejected(df).collect()} == {("bad-name", "unsafe name")}
    assert {(r.src, r.dst) for r in dbt.edges(dbt.parse(df)).collect()} == {("a", "m"), ("b", "m"), ("a", "b")}


def test_dbt_directory(spark, tmp_path):
    (tmp_path / "marts").mkdir()
    (tmp_path / "raw_events.sql").write_text("SELECT * FROM {{ source('app', 'events') }}")
    (tmp_path / "marts" / "fct.sql").write_text("SELECT * FROM {{ ref('raw_events') }}")
    parsed = dbt.parse(dbt.project_from_directory(spark, str(tmp_path), "p"))
    assert [(r.src, r.dst) for r in dbt.edges(parsed).collect()] == [("raw_events", "fct")]


def test_one_shuffle_of_the_corpus(scripts):
    plan = parse(scripts, CTES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_scripts_are_read_whole(spark, scripts):
    """A wide select, very many statements and a deep nest; each step has to stay linear in the text."""
    wide = "CREATE TABLE t AS SELECT " + ", ".join(f"f(a{i}, 'x;y{i}') AS c{i}" for i in range(5000)) + " FROM raw.r"
    many = "\n".join(f"CREATE TABLE t{i} AS SELECT a, b{i} FROM raw.r WHERE x = ';' -- c;\n;" for i in range(3000))
    deep = "SELECT " + "(" * 5000 + "SELECT 1" + ")" * 5000 + " FROM t"
    table = scripts(wide, many, deep)
    statements = catalog.statements(table)
    assert {r.script_id: r["count"] for r in statements.groupBy("script_id").count().collect()} == {0: 1, 1: 3000, 2: 1}
    parsed = models.models(statements)
    got = {r.script_id: r.n for r in parsed.groupBy("script_id").agg({"items": "count"}).withColumnRenamed("count(items)", "n").collect()}
    assert got == {0: 1, 1: 3000, 2: 1}
    assert models.model_columns(parsed).where("script_id = 0").count() == 5000
    assert parsed.where("script_id = 0").first()["items"][4999].endswith("AS c4999")
    depth = {r.script_id: r.max_depth for r in patterns.nesting_depth(table).collect()}
    assert depth == {0: 0, 1: 0, 2: 5000}
