"""Intermediate tables in the cluster's shared folder.

A staged table cuts the lineage with an ordinary write, so the result survives the loss of any
executor, and every later reader sees the same rows in the same layout.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SHARED_DIR_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one is set only where none is named."""
    folder = spark.conf.get(SHARED_DIR_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_DIR_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the application's own folder, which goes when the application ends."""
    root = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The numbered tables of one loop, all of one schema.

    Each round is one write; how many of its rows matter to the loop is counted by that same write.
    After a number of rounds the tables so far are merged, so that a deep loop does not list ever more
    folders.
    """

    MERGE_AFTER = 32

    def __init__(self, spark: SparkSession, tag: str):
        self._spark, self._base = spark, new_path(spark, tag)
        self._schema, self._latest, self._parts = None, None, []
        self.count = 0

    def add(self, df: DataFrame, counted: Column | None = None) -> int:
        """Write the next round and return the number of its rows, or of those where ``counted`` holds."""
        self._schema = df.schema
        if len(self._parts) >= self.MERGE_AFTER:
            merged = f"{self._base}/to{self.count}"
            self.all().write.parquet(merged)
            self._parts = [merged]
        seen = Observation()
        rows = F.count(F.lit(1)) if counted is None else F.count(F.when(counted, 1))
        self._latest = f"{self._base}/r{self.count}"
        df.observe(seen, rows.alias("rows")).write.parquet(self._latest)
        self._parts.append(self._latest)
        self.count += 1
        return seen.get["rows"]

    def last(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self._latest)

    def all(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(*self._parts)
