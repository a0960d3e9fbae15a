"""A corpus of scripts derived from the customer table: one script per customer.

Each customer gets one of the script shapes below, filled with its number and segment. Scripts of
one segment write a shared mart. The shapes cover every statement form the analytics know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.layout import by_script
from millrace.sources.tables import table

CHAIN = """-- weigh the parcels of depot {k}
CREATE TABLE hub.parcels_{k} AS
SELECT route_id, MAX(weight) AS heaviest, SUM(fee) AS fees
FROM raw.parcels
WHERE scanned_at < SYSDATE AND route_id IS NOT NULL
GROUP BY route_id;

/* look up where the routes go
   from raw.unused */
CREATE TABLE mart.route_load_{k} AS
SELECT r.city, p.route_id, p.heaviest, p.fees
FROM raw.routes r
JOIN hub.parcels_{k} p ON p.route_id = r.route_id
WHERE r.closed = 0;

INSERT INTO mart.seg_{seg}
SELECT city, fees, heaviest
FROM mart.route_load_{k}
WHERE heaviest BETWEEN 5 AND 40;
"""

DIAMOND = """CREATE TABLE stage.base_{k} AS SELECT id, amount, region FROM raw.invoices;
CREATE TABLE stage.north_{k} AS SELECT id, amount FROM stage.base_{k} WHERE region = 'north';
CREATE TABLE stage.south_{k} AS SELECT id, amount AS south_amount FROM stage.base_{k} WHERE region = 'south';
CREATE TABLE mart.both_{k} AS
SELECT n.id, n.amount, s.south_amount, n.amount - s.south_amount
FROM stage.north_{k} n JOIN stage.south_{k} s ON n.id = s.id
"""

CTES = """CREATE TABLE mart.sensor_{k} AS
WITH readings AS (
    SELECT device_id, reading, taken_at, site FROM raw.telemetry WHERE unit IN ('C', 'K') AND reading > -90
),
hourly AS (
    SELECT s.zone, DATE_TRUNC('hour', r.taken_at) AS hour, r.reading AS degrees, r.device_id
    FROM raw.sites s JOIN readings r ON r.site = s.site
),
spread AS (
    SELECT zone, hour, MIN(degrees) AS coldest, AVG(degrees) AS typical, COUNT(DISTINCT device_id) AS devices
    FROM hourly GROUP BY zone, hour
)
SELECT hour, zone, coldest, devices, typical - NULLIF(coldest, 0) AS gap
FROM spread
ORDER BY zone;
INSERT INTO mart.seg_{seg} SELECT zone, devices, gap FROM mart.sensor_{k};
"""

UNION = """CREATE TABLE lake.alerts_{k} AS
SELECT 'smoke' AS cause, alarm_no, raised_by FROM raw.smoke_alarms
UNION ALL
SELECT 'flood' AS cause, alarm_no, raised_by FROM raw.flood_alarms;
CREATE OR REPLACE TABLE lake.alert_copy_{k} AS SELECT * FROM lake.alerts_{k};
"""

WINDOWS = """CREATE TABLE warehouse.ranked_{k} AS
SELECT customer_id, CAST(total AS DECIMAL(10, 2)) AS total, CAST(joined AS DATE) AS joined,
       RANK() OVER (ORDER BY total DESC) AS place,
       COALESCE(nick, name), CASE WHEN total > 5 THEN 1 ELSE 0 END, total * 2, upper(name) AS label,
       EXTRACT(YEAR FROM joined) AS since
FROM raw.members m
"""

PROCEDURE = """CREATE PROCEDURE pay_{k}(p_id IN NUMBER, p_total OUT NUMBER) IS
  v_sql VARCHAR2(200);
  v_sql := 'DELETE FROM tmp_{k}; COMMIT';
  EXECUTE IMMEDIATE v_sql;
  EXEC('drop table x');
  EXEC sp_executesql v_sql;
MERGE INTO mart.accounts_{k} a
USING (SELECT id, amount FROM raw.payments) s
ON (a.id = s.id)
WHEN MATCHED THEN UPDATE SET a.amount = s.amount
WHEN NOT MATCHED THEN INSERT (id, amount) VALUES (s.id, s.amount);
"""

LITERALS = """-- nothing comes from raw.nowhere; really
CREATE TABLE staging.notes_{k} AS /* from raw.neither */
SELECT id, 'a;b(c, from x -- y' AS note, "from", 'it''s' AS quoted
FROM raw.notes -- join raw.neither
WHERE note <> 'join raw.never; (';

-- trailing remark
"""

CYCLE = """CREATE TABLE work.left_{k} AS SELECT id, total FROM work.right_{k};
CREATE TABLE work.right_{k} AS SELECT id, total FROM work.left_{k};
CREATE TABLE work.after_{k} AS SELECT id, total FROM work.right_{k} JOIN work.free_{k} USING (id);
CREATE TABLE work.free_{k} AS SELECT id FROM raw.items;
"""

VALUES = """INSERT INTO ref.codes_{k} VALUES (1, 'one');
INSERT INTO ref.stats_{k} (dept, middle, names)
SELECT dept, MEDIAN(salary), LISTAGG(name, ',') FROM raw.staff GROUP BY dept;
CREATE TABLE ref.today_{k} AS SELECT SYSDATE AS today FROM dual;
INSERT INTO ref.copy_{k} SELECT t.today, c.* FROM ref.today_{k} t JOIN ref.codes_{k} c ON 1 = 1;
"""

SHAPES = """CREATE TABLE org.tree_{k} AS
WITH RECURSIVE chart AS (
  SELECT id, boss_id, 1 AS depth FROM raw.staff WHERE boss_id IS NULL
  UNION ALL
  SELECT s.id, s.boss_id, c.depth + 1 FROM raw.staff s JOIN chart c ON s.boss_id = c.id
)
SELECT id, depth FROM chart;
SELECT part_no, LEVEL FROM raw.assemblies START WITH holder_no IS NULL CONNECT BY PRIOR part_no = holder_no;
SELECT * FROM raw.sales PIVOT (SUM(amount) FOR quarter IN ('q1', 'q2'));
SELECT * FROM raw.wide UNPIVOT (amount FOR quarter IN (q1, q2));
SELECT d.id, x.top FROM raw.depts d, LATERAL (SELECT MAX(s.pay) AS top FROM raw.staff s WHERE s.dept = d.id) x;
SELECT d.id, y.n FROM raw.depts d CROSS APPLY (SELECT COUNT(*) AS n FROM raw.staff s) y OUTER APPLY f(d.id);
"""

NESTED = """BEGIN
  DELETE FROM tmp.gone_{k};
END;
CREATE TABLE mart.deep_{k} AS
SELECT id, (SELECT MAX(v) FROM raw.limits) AS top
FROM (SELECT id FROM (SELECT id, amount FROM ( SELECT id, amount FROM raw.facts WHERE amount > (1 + (2 * 3))) a) b) c
WHERE id NOT IN (SELECT id FROM raw.blocked)
"""

REMARK = """-- script {k} was retired

/* nothing; left */
"""

MART = """TRUNCATE TABLE staging.bookings_{k};
INSERT INTO staging.bookings_{k} (booking_id, customer_id, day, amount)
SELECT b.booking_id, b.customer_id, CAST(b.day AS DATE) AS day, COALESCE(b.amount, 0) AS amount
FROM raw.bookings AS b
WHERE b.booking_id IS NOT NULL;
INSERT INTO mart.seg_{seg} (day, bookings, total)
WITH Daily (day, bookings, total) AS (
  SELECT day, COUNT(booking_id) AS bookings, SUM(amount) AS total FROM staging.bookings_{k} GROUP BY day
),
keep AS (SELECT day, bookings, total FROM daily WHERE total > 0)
SELECT day, bookings, total FROM keep
ON CONFLICT (day) DO UPDATE SET total = EXCLUDED.total;
CREATE TABLE mart.report_{k} AS
SELECT day, total AS amount FROM mart.seg_{seg} UNION ALL SELECT day, amount FROM staging.bookings_{k};
"""

REBUILD = """CREATE TABLE dw.first_{k} AS SELECT id, total, 7 AS "1st" FROM raw.ledger;
CREATE TABLE dw.second_{k} AS SELECT id, total AS grand FROM dw.first_{k};
INSERT INTO dw.first_{k} SELECT id, grand AS total FROM dw.second_{k};
CREATE TABLE dw.odd$name_{k} AS SELECT id, total FROM dw.first_{k} f JOIN dw.second_{k} s USING (id);
"""

QUOTED = """CREATE TABLE "Lab"."Sample Runs {k}" AS
WITH "Raw Reads" AS (SELECT r."Probe Id", r.level AS "Level, mV", 'a "b" from x.y' AS note FROM "Lab"."Reads" r),
clean AS (SELECT "Probe Id", "Level, mV" * 2 AS doubled FROM "Raw Reads" JOIN lab.probes USING ("Probe Id"))
SELECT "Probe Id", MAX(doubled) AS "Top Level" FROM clean GROUP BY "Probe Id";
INSERT INTO lab."Select From" ("Probe Id", top) SELECT "Probe Id", "Top Level" AS top FROM "Lab"."Sample Runs {k}";
INSERT INTO old."Select From" ("Probe Id", top) SELECT "Probe Id", "Top Level" AS top FROM "Lab"."Sample Runs {k}";
CREATE TABLE lab.board AS SELECT "Probe Id", top FROM "Select From" JOIN raw.board USING ("Probe Id");
CREATE TABLE lab.wall AS SELECT "Probe Id" FROM board;
"""

TEMPLATES = (
    CHAIN, DIAMOND, CTES, UNION, WINDOWS, PROCEDURE, LITERALS, CYCLE, VALUES, SHAPES, NESTED, REMARK, MART, REBUILD,
    QUOTED,
)

# Pairs of successive versions of one script.
VERSIONS = (
    ("SELECT id, amount, day FROM raw.a_{k}", "SELECT id, amount, day FROM raw.a_{k}"),
    ("SELECT id, amount, day FROM raw.a_{k}", "SELECT id, day FROM raw.a_{k}"),
    ("SELECT id, day FROM raw.a_{k}", "SELECT id, amount, note, day FROM raw.a_{k}"),
    ("SELECT id, amount FROM raw.a_{k}", "SELECT id, amount AS total_amount FROM raw.a_{k}"),
    ("SELECT id, CAST(x AS INTEGER) AS amount FROM raw.a_{k}", "SELECT id, CAST(x AS VARCHAR) AS amount FROM raw.a_{k}"),
    (
        "CREATE TABLE m.t_{k} AS WITH p AS (SELECT id, a, b FROM raw.a_{k}) SELECT id, a, b, CAST(c AS DECIMAL(8, 2)) AS c"
        " FROM p; -- CAST(c AS INT) AS c\nSELECT z FROM raw.z",
        "CREATE TABLE m.t_{k} AS WITH p AS (SELECT id FROM raw.a_{k}) SELECT id, CAST(c AS DECIMAL(9, 2)) AS c, e, f FROM p;",
    ),
    ("SELECT * FROM raw.a_{k}", "SELECT id, (SELECT MAX(v) FROM raw.m) AS top FROM raw.a_{k}"),
)

DBT_MODELS = (
    (
        "raw_events_{k}",
        "{{ config(materialized='table') }}\nSELECT id, at, '{seg}' AS seg FROM {{ source('app', 'events') }}"
        " JOIN {{ source( \"app\", \"users\" ) }} USING (id) JOIN {{ source('app', 'events') }} e2 USING (id)",
    ),
    (
        "stg_events_{k}",
        "{{ config(tags=['x'], materialized = \"Ephemeral\", schema='s') }}\nSELECT * FROM {{ ref('raw_events_{k}') }}"
        " JOIN {{ref(\"dim_{seg}\")}} USING (seg) JOIN {{ ref('raw_events_{k}') }} b USING (id) JOIN {{ ref('missing') }} m",
    ),
    (
        "fct_events_{k}",
        "{{ config(materialized='incremental') }}\nSELECT * FROM {{ ref('stg_events_{k}') }}\n"
        "{%- if is_incremental() -%}\nWHERE at > (SELECT MAX(at) FROM {{ this }})\n{% endif %}",
    ),
    ("bad-name {k}", "SELECT 1 FROM {{ ref('raw_events_{k}') }}"),
    ("loop_a_{k}", "SELECT id FROM {{ ref('loop_b_{k}') }}"),
    ("loop_b_{k}", "SELECT id FROM {{ ref('loop_a_{k}') }}"),
)
DBT_DIM = ("dim_{seg}", "SELECT seg FROM {{ source('app', 'segments') }}")


def _fill(text: Column) -> Column:
    text = F.replace(text, F.lit("{k}"), F.col("script_id").cast("string"))
    return F.replace(text, F.lit("{seg}"), F.lower("segment"))


def _pick(texts: tuple[str, ...]) -> Column:
    number = (F.col("script_id") % len(texts) + 1).cast("int")
    return _fill(F.element_at(F.array(*[F.lit(t) for t in texts]), number))


def _authors(spark: SparkSession, folder: str) -> DataFrame:
    """The customers spread by script id while they are still two short columns; the texts built from
    them keep that layout, so the jobs keyed by script need no shuffle of texts or tokens."""
    return by_script(
        table(spark, folder, "customer").select(
            F.col("c_custkey").alias("script_id"), F.col("c_mktsegment").alias("segment"), "c_nationkey"
        )
    )


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """``(script_id, sql_text)``, one row per customer."""
    return _authors(spark, folder).select("script_id", _pick(TEMPLATES).alias("sql_text"))


def script_versions(spark: SparkSession, folder: str) -> DataFrame:
    """``(script_id, v1, v2)``, one row per customer."""
    return _authors(spark, folder).select(
        "script_id",
        _pick(tuple(a for a, _ in VERSIONS)).alias("v1"),
        _pick(tuple(b for _, b in VERSIONS)).alias("v2"),
    )


def dbt_models(spark: SparkSession, folder: str) -> DataFrame:
    """``(project, name, sql_text)``: one project per nation, models per customer and per segment."""
    customer = _authors(spark, folder)
    project = F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("project")
    each = customer.select(
        project,
        F.explode(
            F.array(*[F.struct(_fill(F.lit(n)).alias("name"), _fill(F.lit(t)).alias("sql_text")) for n, t in DBT_MODELS])
        ).alias("model"),
    )
    per_segment = customer.select(
        project, _fill(F.lit(DBT_DIM[0])).alias("name"), _fill(F.lit(DBT_DIM[1])).alias("sql_text")
    ).distinct()
    return each.select("project", "model.name", "model.sql_text").unionByName(per_segment)
