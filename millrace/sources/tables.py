"""Table reads and the write forms of a load script."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.recursion import recursive_union

#: What a task lists or reads before it hands rows on, and how many files it reads.
BATCH_ROWS, BATCH_BYTES, TASK_FILES = 10_000, 8 << 20, 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath))


def create_table_as(df: DataFrame, path: str, replace: bool = False, partition_by: Sequence[str] = ()) -> None:
    """``CREATE [OR REPLACE] TABLE path AS df``; without ``replace`` an existing table is an error."""
    df.write.mode("overwrite" if replace else "errorifexists").partitionBy(*partition_by).parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """``INSERT INTO path SELECT``: columns are matched by name by the reader."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def insert_values(target: DataFrame, rows: Sequence[Sequence]) -> DataFrame:
    """The table after ``INSERT INTO target VALUES rows``; the rows are literals of the plan."""
    fields = target.schema.fields
    records = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return target.unionByName(target.sparkSession.range(1).select(F.inline(F.array(*records))))


def truncate_load(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """``TRUNCATE`` + ``INSERT``: nothing of the old table stays, whatever its partitions."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions that occur in ``df``; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a node table and an edge table as JSON lines under ``path``."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_script_files(scripts: DataFrame, folder: str) -> None:
    """One file ``folder/<place>/<name>.sql`` per row of ``scripts`` (place, name, sql_text); a repeated task rewrites its files."""

    def save(rows) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        made = set()
        for r in rows:
            if r.place not in made:
                store.create_dir(f"{root}/{r.place}", recursive=True)
                made.add(r.place)
            with store.open_output_stream(f"{root}/{r.place}/{r.name}.sql") as out:
                out.write((r.sql_text or "").encode())

    scripts.select("place", "name", "sql_text").foreachPartition(save)


def scripts_from_directory(spark: SparkSession, folder: str) -> DataFrame:
    """One ``(name, path, sql_text)`` row per ``*.sql`` file below ``folder``; name = file stem.

    As Spark's own reader does, it goes by hidden files and folders and empty files, and ``path`` and ``name`` are
    parts of a URI. That reader keeps all files in the driver and makes a task of every few; here tasks list the folders
    of one depth after the other into tables, and others read what these name. It still reads what only it can: a
    pattern, a single file, or a store that pyarrow does not know.
    """
    known = _store(spark, folder)
    if known is None:
        return _read_by_spark(spark, folder)
    store, root, prefix = known
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    walk = _lister(store)
    top = spark.range(1).select(F.lit(root).alias("path"), F.lit(True).alias("folder"))
    found = recursive_union(
        top, lambda last: last.where("folder").repartition(parts, "path").mapInArrow(walk, "path string, folder boolean")
    )
    files = found.where("NOT folder").select("path")
    # A fixed count keeps AQE from merging the partitions by their size, which is that of the names only.
    spread = files.repartition(max(parts, -(-files.count() // TASK_FILES)), "path")
    read = spread.mapInArrow(_reader(store, prefix), "name string, path string, content binary")
    return read.select("name", "path", F.col("content").cast("string").alias("sql_text"))


def _read_by_spark(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql")
    return files.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.sql$", "").alias("name"),
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("sql_text"),
    )


def _store(spark: SparkSession, folder: str) -> tuple[fs.FileSystem, str, str] | None:
    """pyarrow's file system of a folder, the folder's path in it, and what comes before such paths in a URI; None for all else."""
    if any(c in "{}[]*?\\" for c in folder):
        return None
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toUri()
    scheme, host, path = uri.getScheme(), uri.getAuthority(), uri.getPath()
    try:
        store, root = (fs.LocalFileSystem(), path) if scheme == "file" else fs.FileSystem.from_uri(uri.toString())
        if store.get_file_info(root).type != fs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError):
        return None
    if not path.endswith(root):  # a bucket is part of its paths
        return store, root, f"{scheme}://"
    return store, root, f"{scheme}:" + (f"//{host}" if host else "") + path.removesuffix(root)


def _in_batches(schema: pa.Schema):
    """A function that makes record batches of bounded size from rows and their numbers of bytes."""
    most, enough = BATCH_ROWS, BATCH_BYTES

    def batches(rows):
        out, size = [], 0
        for row, length in rows:
            out.append(row)
            size += length
            if len(out) >= most or size >= enough:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return batches


def _lister(store: fs.FileSystem):
    """A function over batches of folders that yields the folders and scripts in them as (path, folder)."""
    local, emit = isinstance(store, fs.LocalFileSystem), _in_batches(pa.schema({"path": pa.string(), "folder": pa.bool_()}))

    def entries(top):
        if not local:
            for e in store.get_file_info(fs.FileSelector(top)):
                yield e.path, e.base_name, e.type == fs.FileType.Directory, e.size or 0
            return
        with os.scandir(top) as found:  # entry by entry, as a folder can hold millions
            for e in found:
                if e.is_dir():
                    yield e.path, e.name, True, 0
                elif e.name.endswith(".sql") and e.is_file():
                    yield e.path, e.name, False, e.stat().st_size

    def shown(name, folder):
        if name.startswith("_") and "=" not in name:
            return folder and name.startswith(("_metadata", "_common_metadata"))
        return not name.startswith(".") and not (folder and name.endswith("._COPYING_"))

    def found(batches):
        for batch in batches:
            for top in batch.column("path").to_pylist():
                for path, name, folder, size in entries(top):
                    if shown(name, folder) and (folder or name.endswith(".sql") and size > 0):
                        yield (path, folder), len(path)

    return lambda batches: emit(found(batches))


def _reader(store: fs.FileSystem, prefix: str):
    """A function over batches of paths that yields the files as (name, path, content)."""
    emit = _in_batches(pa.schema({"name": pa.string(), "path": pa.string(), "content": pa.binary()}))

    def kept(c):
        return ord(c) > 127 and unicodedata.category(c) not in ("Cc", "Zs", "Zl", "Zp")

    def contents(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as file:
                    content = file.read()
                # As java.net.URI writes a path.
                place = "".join(c if kept(c) else quote(c, safe="/_-!.~'()*,;:$&+=@") for c in path)
                yield (place.rpartition("/")[2].removesuffix(".sql"), prefix + place, content), len(content)

    return lambda batches: emit(contents(batches))


def jsonl(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))
