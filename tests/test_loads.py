import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import loads
from millrace.operators.staging import new_path, shared_dir, stage
from millrace.operators.upsert import merge, upsert
from millrace.plans.flow import compose
from millrace.sources import tables

T = "k int, a string, b string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_updates_only_the_listed_columns(spark):
    old = spark.createDataFrame([(1, "a1", "b1"), (2, "a2", "b2")], T)
    new = spark.createDataFrame([(2, "x", "y"), (3, "p", "q")], T)
    once = upsert(old, new, ["k"], ["b"])
    assert rows(once) == [(1, "a1", "b1"), (2, "a2", "y"), (3, "p", "q")]
    assert rows(upsert(once, new, ["k"], ["b"])) == rows(once)


def test_upsert_sets_null_from_the_source(spark):
    old = spark.createDataFrame([(1, "a1", "b1")], T)
    new = spark.createDataFrame([(1, None, None)], T)
    assert rows(upsert(old, new, ["k"], ["a", "b"])) == [(1, None, None)]


def test_null_keys_never_match(spark):
    old = spark.createDataFrame([(None, "a", "b")], T)
    new = spark.createDataFrame([(None, "x", "y")], T)
    got = upsert(old, new, ["k"], ["a", "b"]).collect()
    assert sorted((r.a, r.b) for r in got) == [("a", "b"), ("x", "y")]


def test_merge_branches(spark):
    old = spark.createDataFrame([(1, "a1", "b1"), (2, "a2", "b2")], T)
    new = spark.createDataFrame([(2, "x", "y"), (3, "p", "q")], T)
    only_update = merge(old, new, ["k"], {"a": F.concat("t.a", "s.a")}, None)
    assert rows(only_update) == [(1, "a1", "b1"), (2, "a2x", "b2")]
    only_insert = merge(old, new, ["k"], None, {"k": F.col("s.k")})
    assert rows(only_insert.where("k = 3")) == [(3, None, None)]
    assert rows(only_insert.where("k < 3")) == rows(old)


def test_two_source_rows_for_one_key_fail(spark):
    old = spark.createDataFrame([(1, "a", "b")], T)
    new = spark.createDataFrame([(1, "x", "y"), (1, "p", "q")], T)
    with pytest.raises(Exception, match="two source rows"):
        upsert(old, new, ["k"], ["a"]).collect()


def test_incremental_slices_equal_a_full_load(spark):
    day = [(i, dt.datetime(2024, 1, 1 + i)) for i in range(6)]
    full = spark.createDataFrame(day, "id int, ts timestamp_ntz")
    first = loads.incremental(None, full.where("id < 3"), "ts")
    assert rows(loads.incremental(first, full, "ts")) == rows(full)
    assert rows(loads.incremental(full.limit(0), full, "ts")) == rows(full)
    assert rows(loads.incremental(full, full, "ts")) == rows(full)


def test_incremental_filter_reaches_the_scan(spark):
    path = new_path(spark, "t")
    spark.range(10).withColumn("ts", F.col("id")).write.parquet(path)
    table = spark.read.parquet(path)
    plan = loads.newer_than(table, table.where("id < 5"), "ts")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts,ScalarSubquery" in plan


def test_row_count_gate(spark):
    full, empty = spark.range(3), spark.range(0)
    got = {r.table: (r.row_count, r.ok) for r in loads.row_counts({"a": full, "b": empty}).collect()}
    assert got == {"a": (3, True), "b": (0, False)}
    with pytest.raises(Exception, match="row count validation failed for b"):
        loads.require_rows({"a": full, "b": empty}).collect()


def test_materialisation_policies(spark):
    df = spark.range(4).withColumn("ts", F.col("id"))
    path = new_path(spark, "model")
    assert loads.materialize(spark, "m_view", lambda: df).count() == 4
    assert spark.table("m_view").count() == 4
    loads.materialize(spark, "m_inc", lambda: df.where("id < 2"), "incremental", "ts", path)
    assert loads.materialize(spark, "m_inc", lambda: df, "incremental", "ts", path).count() == 4
    assert loads.materialize(spark, "m_inc", lambda: df, "incremental", "ts", path).count() == 4
    assert loads.materialize(spark, "m_tab", lambda: df.where("id < 1"), "table", path=path).count() == 1
    assert loads.materialize(spark, "m_odd", lambda: df, "no such policy").count() == 4
    loads.materialize(spark, "m_eph", lambda: df, "ephemeral")
    assert not spark.catalog.tableExists("m_eph")
    with pytest.raises(ValueError):
        loads.materialize(spark, "m_bad", lambda: df, "table")
    assert loads.materialization_rule(True, False) == loads.materialization_rule(False, True) == "table"
    assert loads.materialization_rule(False, False) == "view"


def test_create_append_replace_and_partition_refresh(spark):
    path = new_path(spark, "t")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, p string")
    tables.create_table_as(df, path)
    with pytest.raises(Exception):
        tables.create_table_as(df, path)
    tables.append(df, path)
    assert spark.read.parquet(path).count() == 4
    tables.create_table_as(df, path, replace=True)
    assert spark.read.parquet(path).count() == 2
    parts = new_path(spark, "p")
    tables.truncate_load(df, parts, ["p"])
    tables.replace_partitions(spark.createDataFrame([(9, "y")], df.schema), parts, ["p"])
    assert rows(spark.read.parquet(parts).select("id", "p")) == [(1, "x"), (9, "y")]
    tables.truncate_load(df, path)
    assert spark.read.parquet(path).count() == 2


def test_insert_values(spark):
    target = spark.createDataFrame([(1, "a")], "id int, n string")
    assert rows(tables.insert_values(target, [(2, "b"), (3, None)]).where("n IS NOT NULL")) == [(1, "a"), (2, "b")]
    assert tables.insert_values(target, [(2, "b"), (3, None)]).schema == target.schema


def test_script_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("SELECT 1;\nSELECT 2")
    (tmp_path / "sub" / "b.sql").write_text("SELECT 3")
    (tmp_path / "c.txt").write_text("no")
    got = {r.name: r.sql_text for r in tables.scripts_from_directory(spark, str(tmp_path)).collect()}
    assert got == {"a": "SELECT 1;\nSELECT 2", "b": "SELECT 3"}


ODD = {
    "a b/x %20#é.sql": b"SELECT 1", "_hid/y.sql": b"1", ".hid/y.sql": b"1", "_y.sql": b"1", ".y.sql": b"1", "_p=1/z.sql": b"z", "k=v/_q=1.sql": b"q",
    "n/bad.sql": b"\xff\xfeSELECT\x00 \xc3", "n/bom.sql": b"\xef\xbb\xbfS\r\n", "n/empty.sql": b"", "n/UP.SQL": b"u", "n/.sql": b"d",
    "n/t.sql._COPYING_": b"c", "n/v.sql/w.sql": b"dir", "n/_metadata.sql": b"m", "_metadata/m.sql": b"m", "n/c._COPYING_/o.sql": b"c", "1/2/3/4/x %20#é.sql": b"e",
}


def odd_files(top):
    for name, content in ODD.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    (top / "link.sql").symlink_to(top / "n" / "bom.sql")
    (top / "linked").symlink_to(top / "a b")
    (top / "broken.sql").symlink_to(top / "nothing")


def test_scripts_read_by_tasks_are_those_that_spark_reads(spark, tmp_path):
    odd_files(tmp_path)

    def read(how, folder):
        return sorted(map(tuple, how(spark, folder).select("name", "path", F.col("sql_text").cast("binary")).collect()))

    for folder in (str(tmp_path), f"file:{tmp_path}/n/", f"{tmp_path}/_hid", f"{tmp_path}/n/bom.sql", f"{tmp_path}/n/b*", f"{tmp_path}/_p=1"):
        got = read(tables.scripts_from_directory, folder)
        assert got and got == read(tables._read_by_spark, folder)
    (tmp_path / "none").mkdir()
    assert read(tables.scripts_from_directory, f"{tmp_path}/none") == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.scripts_from_directory(spark, f"{tmp_path}/missing")


def test_a_store_is_listed_as_a_local_folder_is(tmp_path):
    import pyarrow as pa
    from pyarrow import fs

    odd_files(tmp_path)
    local = fs.LocalFileSystem()
    listed = []
    for store, root in ((local, str(tmp_path)), (fs.SubTreeFileSystem("/", local), str(tmp_path))):
        found, folders = [], [root]
        while folders:
            batch = pa.RecordBatch.from_pydict({"path": folders})
            rows = [r for out in tables._lister(store)(iter([batch])) for r in out.to_pylist()]
            folders = [r["path"] for r in rows if r["folder"]]
            found += [r["path"].removeprefix("/") for r in rows if not r["folder"]]
        listed.append(sorted(found))
    assert listed[0] == listed[1] and len(listed[0]) > 8


def test_the_driver_holds_no_list_of_the_scripts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BATCH_ROWS", 7, raising=False)
    monkeypatch.setattr(tables, "TASK_FILES", 60, raising=False)
    for i in range(400):
        (tmp_path / f"g{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"g{i % 3}" / f"s{i}.sql").write_text(f"SELECT {i}")
    files = tables.scripts_from_directory(spark, str(tmp_path))
    assert not [f for f in files.inputFiles() if f.endswith(".sql")] and "FileScan text" not in files._jdf.queryExecution().toString()
    assert files.rdd.getNumPartitions() == 7
    assert {(r.name, r.sql_text) for r in files.collect()} == {(f"s{i}", f"SELECT {i}") for i in range(400)} and files.count() == 400


def test_graph_json(spark, tmp_path):
    nodes = spark.createDataFrame([("n", "N")], "id string, label string")
    edges = spark.createDataFrame([("n", "m")], "source string, target string")
    tables.write_graph_json(nodes, edges, str(tmp_path / "g"))
    assert rows(spark.read.json(str(tmp_path / "g" / "edges")).select("source", "target")) == [("n", "m")]
    assert tables.jsonl(nodes).first().json == '{"id":"n","label":"N"}'


def test_flow_orders_steps_and_refuses_cycles(spark):
    base = spark.range(3)
    out = compose({"raw": base}, {"c": (["b"], lambda d: d.where("id > 1")), "b": (["raw"], lambda d: d.where("id > 0"))})
    assert rows(out["c"]) == [(2,)]
    with pytest.raises(Exception, match="cycle"):
        compose({}, {"a": (["b"], lambda d: d), "b": (["a"], lambda d: d)})


def test_staged_table_is_a_plain_read(spark):
    df = stage(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 5
    assert shared_dir(spark) in df.inputFiles()[0]


def test_source_rows_without_a_key_never_match(spark):
    target = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    source = spark.createDataFrame([(1, "c"), (None, "d"), (None, "e")], target.schema)
    got = upsert(target, source, ["k"], ["v"])
    assert sorted(((r.k or 0), r.v) for r in got.collect()) == [(0, "b"), (0, "d"), (0, "e"), (1, "c")]


def test_full_refresh_leaves_nothing_behind(spark):
    path = f"{new_path(spark, 'refresh')}/t"
    tables.truncate_load(spark.createDataFrame([(1, "x"), (2, "y")], "v int, p string"), path, ["p"])
    tables.truncate_load(spark.createDataFrame([(9, "y")], "v int, p string"), path, ["p"])
    assert [(r.v, r.p) for r in spark.read.parquet(path).collect()] == [(9, "y")]


class TestPartitionedTable:
    SCHEMA = "day date, v int, note string"

    def table(self, spark):
        from pyspark.sql.types import StructType

        from millrace.sources.partitioned import PartitionedTable

        month = F.year("day") * 100 + F.month("day")
        return PartitionedTable(spark, new_path(spark, "months"), StructType.fromDDL(self.SCHEMA), ["day"], month)

    def days(self, spark, *made):
        return spark.createDataFrame([(d and dt.date(*d), v, n) for d, v, n in made], self.SCHEMA)

    def test_a_change_reads_and_writes_its_partitions_only(self, spark):
        mart = self.table(spark)
        mart.create(self.days(spark, ((2024, 1, 1), 1, "a"), ((2024, 1, 2), 2, "b"), ((2024, 2, 1), 3, "c"), ((2024, 3, 9), 4, "d")))
        before = {r.part: r.folder for r in mart.manifest().collect()}
        one_day = self.days(spark, ((2024, 1, 2), 9, "x"))
        read = mart.read(parts=[202401])
        assert read.inputFiles() and all("__part=202401" in f for f in read.inputFiles())
        assert mart.upsert(one_day, ["v"]) == 2
        after = {r.part: (r.folder, r.since) for r in mart.manifest().collect()}
        assert {p: f for p, (f, _) in after.items() if p != 202401} == {p: f for p, f in before.items() if p != 202401}
        assert {p: s for p, (_, s) in after.items()} == {202401: 2, 202402: 1, 202403: 1}
        assert rows(mart.read().select("v", "note")) == [(1, "a"), (3, "c"), (4, "d"), (9, "b")]
        assert rows(mart.read(version=1).select("v")) == [(1,), (2,), (3,), (4,)]

    def test_the_merge_plan_scans_touched_partitions_only(self, spark, monkeypatch):
        from millrace.operators import upsert as operators

        mart = self.table(spark)
        mart.create(self.days(spark, ((2024, 1, 1), 1, "a"), ((2024, 2, 1), 3, "c")))
        seen, merge = [], operators.merge
        monkeypatch.setattr(operators, "merge", lambda *a: seen.append(merge(*a)) or seen[-1])
        mart.upsert(stage(self.days(spark, ((2024, 2, 1), 7, "z"), ((2024, 4, 1), 8, "n")), "change"), ["v", "note"])
        stored = [f for f in seen[0].inputFiles() if "months" in f]
        assert stored and all("__part=202402" in f for f in stored)
        assert {r.part: r.since for r in mart.manifest().collect()} == {202401: 1, 202402: 2, 202404: 2}
        assert rows(mart.read().select("v", "note")) == [(1, "a"), (7, "z"), (8, "n")]

    def test_merge_branches_and_an_empty_source(self, spark):
        mart = self.table(spark)
        mart.create(self.days(spark, ((2024, 1, 1), 1, "a"), (None, 5, "no day")))
        mart.merge(self.days(spark, ((2024, 1, 1), 4, "q"), ((2024, 1, 5), 6, "r"), (None, 6, "s")), {"v": F.col("t.v") + F.col("s.v")}, None)
        assert rows(mart.read().select("v", "note")) == [(5, "a"), (5, "no day")]
        mart.merge(self.days(spark), {"v": F.lit(0)}, None)
        assert rows(mart.read().select("v")) == [(5,), (5,)] and mart.versions() == [1, 2, 3]

    def test_of_two_changes_on_one_version_the_later_fails(self, spark):
        from millrace.sources.partitioned import VersionConflict

        mart = self.table(spark)
        mart.create(self.days(spark, ((2024, 1, 1), 1, "a")))
        mart.upsert(self.days(spark, ((2024, 1, 1), 2, "b")), ["v"])
        with pytest.raises(VersionConflict):
            mart._commit(2, self.days(spark, ((2024, 1, 1), 3, "c")), 1, [202401])
        assert rows(mart.read().select("v")) == [(2,)]
        with pytest.raises(VersionConflict):
            mart.create(self.days(spark, ((2024, 1, 1), 1, "a")))

    def test_two_source_rows_for_a_key_leave_no_version(self, spark):
        mart = self.table(spark)
        mart.create(self.days(spark, ((2024, 1, 1), 1, "a")))
        with pytest.raises(Exception, match="two source rows"):
            mart.upsert(self.days(spark, ((2024, 1, 1), 2, "b"), ((2024, 1, 1), 3, "c")), ["v"])
        assert mart.versions() == [1] and rows(mart.read().select("v")) == [(1,)]
