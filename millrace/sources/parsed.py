"""Parse results of scripts kept by their content: a text that was parsed once is not parsed again.

Statements and edges depend on a script's text alone, so they are stored under its checksum. A run parses the
texts that no earlier run knows and publishes its tables at once; corpora are joined with them by checksum.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.staging import stage
from millrace.plans import catalog, statement_graph
from millrace.sources.partitioned import listed, publish

TABLES = ("texts", "statements", "edges")


class ParsedScripts:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self) -> list[int]:
        return sorted(int(n[1:]) for n in listed(self.spark, f"{self.path}/runs"))

    def _table(self, name: str) -> DataFrame | None:
        """All runs' rows of a table, with the number of their ``run``."""
        found = None
        for run in self.runs():
            part = self.spark.read.parquet(f"{self.path}/runs/r{run}/{name}").withColumn("run", F.lit(run).cast("bigint"))
            found = part if found is None else found.unionByName(part)
        return found

    def refresh(self, scripts: DataFrame) -> int:
        """Parse the texts of ``scripts`` (script_id, sql_text) that are new here; returns how many these are."""
        run = (self.runs() or [0])[-1] + 1
        texts = scripts.where("sql_text IS NOT NULL").select(F.sha2("sql_text", 256).alias("checksum"), "sql_text")
        if known := self._table("texts"):
            texts = texts.join(known.select("checksum"), "checksum", "left_anti")
        new = stage(texts.groupBy("checksum").agg(F.any_value("sql_text").alias("sql_text")), "texts")
        statements = stage(catalog.statements(new.withColumnRenamed("checksum", "script_id")), "statements")
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        edges = statement_graph.edges(statements)
        for name, table in zip(TABLES, (new.select("checksum"), statements, edges), strict=True):
            table.withColumnRenamed("script_id", "checksum").write.parquet(f"{draft}/{name}")
        publish(self.spark, draft, f"{self.path}/runs/r{run}")
        return self.spark.read.parquet(f"{self.path}/runs/r{run}/texts").count()

    def _of(self, name: str, scripts: DataFrame) -> DataFrame:
        """A stored table for a corpus that has been refreshed; only checksums of the corpus are shuffled."""
        stored = self._table(name)
        return catalog.checksums(scripts).join(stored, "checksum").drop("checksum")

    def statements(self, scripts: DataFrame) -> DataFrame:
        """``catalog.statements`` of ``scripts`` and the ``run`` that parsed each."""
        return self._of("statements", scripts)

    def edges(self, scripts: DataFrame) -> DataFrame:
        return self._of("edges", scripts)

    def edge_changes(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """The edges that ``new`` adds to and removes from ``old``; scripts whose text is the same take no part."""
        changed = catalog.snapshot_changes(old, new)
        columns = ["script_id", "src", "dst", "via_table"]

        def of(side: str) -> DataFrame:
            sums = changed.where(f"{side}_checksum IS NOT NULL").select("script_id", F.col(f"{side}_checksum").alias("checksum"))
            return sums.join(self._table("edges"), "checksum").select(*columns)

        before, after = stage(of("old"), "before"), stage(of("new"), "after")
        added = after.join(before, columns, "left_anti").withColumn("change", F.lit("added"))
        return added.unionByName(before.join(after, columns, "left_anti").withColumn("change", F.lit("removed")))
