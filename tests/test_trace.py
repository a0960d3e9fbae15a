"""The trace across statements against rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import catalog, models, trace

CHAIN = """CREATE TABLE hub.parcels AS SELECT route_id, MAX(weight) AS heaviest, SUM(fee) AS fees FROM raw.parcels GROUP BY route_id;
CREATE TABLE mart.route_load AS SELECT r.city, p.route_id, p.heaviest, p.fees FROM raw.routes r JOIN hub.parcels p ON p.route_id = r.route_id;
INSERT INTO mart.seg SELECT city, fees * 2 AS doubled, heaviest FROM route_load WHERE heaviest > 5"""
CTES = """CREATE TABLE mart.sensor AS WITH readings AS (SELECT device_id, reading FROM raw.telemetry),
hourly AS (SELECT s.zone, r.reading AS degrees FROM raw.sites s JOIN readings AS r ON r.site = s.site),
spread AS (SELECT zone, MIN(degrees) AS coldest, AVG(degrees) AS typical FROM hourly GROUP BY zone)
SELECT zone, typical - coldest AS gap FROM spread; INSERT INTO mart.seg SELECT zone AS area, gap FROM mart.sensor"""
#: Both tables have an id, and each side is named; the first table is rebuilt after it was read.
SIDES = """CREATE TABLE a AS SELECT id, x AS v FROM raw.one; CREATE TABLE b AS SELECT id, y AS v FROM raw.two;
CREATE TABLE c AS SELECT a.v AS left_v, q.v AS right_v FROM a JOIN b q ON a.id = q.id;
CREATE TABLE a AS SELECT z AS v FROM raw.three; CREATE TABLE d AS SELECT v FROM a"""


def traced(scripts, text, column):
    parsed = models.models(catalog.statements(scripts(text)))
    asked = parsed.select("script_id").distinct().withColumn("column", F.lit(column))
    rows = trace.trace_across(parsed, asked).orderBy("hop").collect()
    assert [r.hop for r in rows] == list(range(1, len(rows) + 1))
    return [(r.stmt_no, r.model_name, r.output_col, r.transformation) for r in rows]


@pytest.mark.parametrize(
    "text, column, want",
    [
        (CHAIN, "fee", [(0, "parcels", "fees", "aggregate:SUM"), (1, "route_load", "fees", "passthrough"), (2, "seg", "doubled", "rename")]),
        (CHAIN, "WEIGHT", [(0, "parcels", "heaviest", "aggregate:MAX"), (1, "route_load", "heaviest", "passthrough"), (2, "seg", "heaviest", "passthrough")]),
        (CHAIN, "city", [(1, "route_load", "city", "passthrough"), (2, "seg", "city", "passthrough")]),
        (CTES, "reading", [
            (0, "readings", "reading", "passthrough"), (0, "hourly", "degrees", "rename"), (0, "spread", "coldest", "aggregate:MIN"),
            (0, "spread", "typical", "aggregate:AVG"), (0, "sensor", "gap", "rename"), (1, "seg", "gap", "passthrough"),
        ]),
        (CTES, "zone", [(0, "hourly", "zone", "passthrough"), (0, "spread", "zone", "passthrough"), (0, "sensor", "zone", "passthrough"), (1, "seg", "area", "rename")]),
        (SIDES, "x", [(0, "a", "v", "rename"), (2, "c", "left_v", "rename")]),
        (SIDES, "y", [(1, "b", "v", "rename"), (2, "c", "right_v", "rename")]),
        (SIDES, "z", [(3, "a", "v", "rename"), (4, "d", "v", "passthrough")]),
        (SIDES, "nowhere", []),
        ("CREATE TABLE t AS SELECT a AS b FROM t; INSERT INTO t SELECT b AS c FROM t; INSERT INTO u SELECT c FROM t", "a",
         [(0, "t", "b", "rename"), (1, "t", "c", "rename"), (2, "u", "c", "passthrough")]),
    ],
)
def test_trace_across_statements(scripts, text, column, want):
    assert traced(scripts, text, column) == want


def test_scopes_know_aliases_from_clauses(scripts):
    text = "SELECT 1 FROM a, b JOIN s.c AS d ON 1 = 1 LEFT JOIN e USING (x) JOIN (SELECT 1 FROM f WHERE y) g ON 1 = 1 JOIN \"H h\" i WHERE z"
    got = {(r.ref, r.called) for r in trace.scopes(models.models(catalog.statements(scripts(text)))).collect()}
    assert got == {("a", "a"), ("s.c", "d"), ("e", "e"), ("f", "f"), ('"h h"', "i")}


def test_a_long_line_of_statements_is_followed_to_its_end(scripts):
    text = ";".join(f"CREATE TABLE t{k + 1} AS SELECT c{k} AS c{k + 1} FROM t{k}" for k in range(40))
    assert [s for s, *_ in traced(scripts, text, "c0")] == list(range(40))
