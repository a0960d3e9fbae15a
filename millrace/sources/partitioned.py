"""Upsert and MERGE on a stored table that is cut into numbered partitions by its key.

A change reads and rewrites only the partitions that its keys fall into. What it writes goes to a folder of its
own; a manifest, one small table per version, says which folder holds each partition. A version counts from the
moment its manifest gets its name, which happens at once and fails if that version exists already. So readers
see whole versions, a run that dies leaves nothing that counts, and of two changes that began on the same version
the later one fails instead of undoing the first.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import upsert as operators

MANIFEST = "part long, folder string, since long"
#: Rows without a key match nothing; they lie together.
NO_KEY = -1
_PART = "__part"


class VersionConflict(RuntimeError):
    """Another change was committed after this one began."""


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, none where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def publish(spark: SparkSession, draft: str, final: str) -> None:
    """Give a written folder its name; of several drafts for one name only the first gets it."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(final)
    target.getFileSystem(conf).mkdirs(target.getParent())
    never_overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(hadoop.Path(draft), target, never_overwrite)
    except Exception as refused:
        if "FileAlreadyExists" in str(refused):
            raise VersionConflict(f"{final} was committed by another change") from refused
        raise


class PartitionedTable:
    """``keys`` name the key columns; ``part`` is a whole number worked out from them alone.

    A date may give its month, any key a bucket of its hash. Rows of one key then lie in one partition.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], part: Column):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.part = F.coalesce(part.cast("long"), F.lit(NO_KEY))

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in listed(self.spark, f"{self.path}/manifest"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """``(part, folder, since)``: where each partition lies and which version wrote it."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{self._known(version)}")

    def read(self, version: int | None = None, parts: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of some partitions only, where these are given."""
        found = self.manifest(version)
        if parts is not None:
            found = found.where(F.col("part").isin([int(p) for p in parts]))
        folders = [r.folder for r in found.select("folder").collect()]  # one for each partition
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def create(self, df: DataFrame) -> int:
        """The first version."""
        return self._commit(1, df, None, [])

    def upsert(self, source: DataFrame, update: Sequence[str]) -> int:
        """``INSERT … ON CONFLICT (keys) DO UPDATE SET c = EXCLUDED.c`` for ``update``; returns the new version."""
        return self.merge(source, {c: F.col(f"s.{c}") for c in update}, {c: F.col(f"s.{c}") for c in self.schema.names})

    def merge(self, source: DataFrame, matched: Mapping[str, Column] | None, not_matched: Mapping[str, Column] | None) -> int:
        """``MERGE INTO table USING source ON keys``, as ``operators.upsert.merge`` has it; returns the new version.

        A source without rows makes a version that differs in nothing. The source is read twice, first for its
        partitions, so it should be a stored table.
        """
        base = self._known(None)
        touched = [r[0] for r in source.select(self.part).distinct().collect()]  # partitions, not rows
        after = operators.merge(self.read(base, touched), source, self.keys, matched, not_matched)
        return self._commit(base + 1, after, base, touched)

    def _known(self, version: int | None) -> int:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"{self.path} has no version {version or 'yet'}")
        return known[-1] if version is None else version

    def _commit(self, version: int, rows: DataFrame, base: int | None, touched: Sequence[int]) -> int:
        """Write ``rows``, which replace the partitions ``touched`` of version ``base``, and name the new manifest."""
        run = f"{self.path}/data/{uuid.uuid4().hex}"
        # Adaptive execution splits a partition that holds most rows into several files.
        rows.select(*self.schema.names).withColumn(_PART, self.part).hint("rebalance", _PART).write.partitionBy(_PART).parquet(run)
        written = [n for n in listed(self.spark, run) if n.startswith(f"{_PART}=")]
        fresh = self.spark.createDataFrame([(int(n.split("=")[1]), f"{run}/{n}", version) for n in written], MANIFEST)
        if base is not None:
            fresh = self.manifest(base).where(~F.col("part").isin([int(p) for p in touched])).unionByName(fresh)
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        fresh.coalesce(1).write.parquet(draft)
        publish(self.spark, draft, f"{self.path}/manifest/v{version}")
        return version
