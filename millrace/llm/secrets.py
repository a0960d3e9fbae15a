"""Secret scans over an incremental ledger of blobs, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, for each
blob and version of a rule, what that rule found there. A scan works only on pairs of blob and rule
version that the ledger lacks, each once however many paths share the blob, and then joins the
ledger's findings back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stage
from millrace.operators.staging import new_path
from millrace.sources.partitioned import listed, publish

FINDING = "array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` without groups that split would care for; ``holds`` says which matches count."""

    kind: str
    version: int
    pattern: str
    value: str = ""
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


#: The base rules.
BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
         r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "^(.+)", 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", "^(.+)", 32),
)
#: Further rules: credentials whose prefix gives them away.
FURTHER = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + FURTHER


def spans(text: Column, rule: Rule) -> Column:
    """Matches of ``rule`` from left to right, without overlap, as (rule, start, end) in code points.

    The text between the matches comes from splitting at the same pattern, so that running lengths of
    both give each match its place.
    """
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    between = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(found, between, lambda m, s: F.struct(m.alias("m"), F.length(s).alias("before")))
    # A match at the very start makes an empty first part, so there is one part before each match.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FINDING).alias("found"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + x["before"]
        end = begin + F.length(x["m"])
        one = F.array(F.struct(F.lit(rule.key).alias("rule"), begin.alias("start"), end.alias("end")))
        counts = F.length(F.regexp_extract(x["m"], rule.value, 1)) >= rule.least if rule.value else F.lit(True)
        return F.struct(end.alias("at"), F.when(counts, F.concat(done["found"], one)).otherwise(done["found"]).alias("found"))

    parts = F.filter(lengths, lambda x: x["m"].isNotNull())
    none = F.array().cast(FINDING)
    return F.when(F.rlike(text, F.lit(rule.pattern)), F.aggregate(parts, start, step, lambda done: done["found"])).otherwise(none)


class Ledger:
    """What was found in each blob by which rules, in Parquet files below ``path``.

    An entry has the ``blob``, the ``rules`` that were applied in one scan and all their ``spans``. Scans
    only ever add entries. A scan's entries count from the moment their folder gets its name, so a scan that
    died leaves none, and a ledger that is opened again in another session goes on from all that were
    entered. Without a path it is one of this session, in the shared folder.
    """

    SCHEMA = f"blob string, rules array<string>, spans {FINDING}"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self._spark, self.path = spark, (path or new_path(spark, "ledger")).rstrip("/")

    def parts(self) -> list[str]:
        return sorted(listed(self._spark, f"{self.path}/scans"))

    def entries(self) -> DataFrame:
        parts = [f"{self.path}/scans/{p}" for p in self.parts()]
        if not parts:
            return self._spark.createDataFrame([], self.SCHEMA)
        return self._spark.read.schema(self.SCHEMA).parquet(*parts)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen in ``versions`` (path, text), enter it and return the new entries.

        Of two scans that began on the same entries the later one fails, and may be run again.
        """
        number = int((self.parts() or ["-1"])[-1]) + 1
        keys = F.array(*[F.lit(r.key) for r in rules])
        addressed = versions.select("path", "text", blob("text").alias("blob"))
        # One path of each blob is read, whichever paths and versions share it.
        first = addressed.groupBy("blob").agg(F.min("path").alias("path"))
        known = self.entries().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        left = F.array_except(keys, F.coalesce("known", F.array().cast("array<string>")))
        todo = stage(first.join(known, "blob", "left").select("blob", "path", left.alias("rules")).where(F.size("rules") > 0), "todo")
        same = (addressed["blob"] == todo["blob"]) & addressed["path"].eqNullSafe(todo["path"])
        read = addressed.join(todo, same).select(todo["blob"], "rules", "text")
        none = F.array().cast(FINDING)
        found = [F.when(F.array_contains("rules", r.key), spans(F.col("text"), r)).otherwise(none) for r in rules]
        # Repeated versions of one path were read alike, so any of their entries will do.
        entries = read.select("blob", "rules", F.concat(*found).alias("spans")).dropDuplicates(["blob"])
        draft, part = f"{self.path}/drafts/{uuid.uuid4().hex}", f"{self.path}/scans/{number:09d}"
        entries.write.parquet(draft)
        publish(self._spark, draft, part)
        return self._spark.read.schema(self.SCHEMA).parquet(part)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``blob`` and all ``spans`` found by ``rules``, in order of start, then of rule; staged."""
        listed = F.array(*[F.lit(r.key) for r in rules])
        # Spans of another version of a rule are not among them.
        found = self.entries().select("blob", F.explode("spans").alias("s")).where(F.array_contains(listed, F.col("s.rule")))
        place = F.array_position(listed, F.col("s.rule"))
        kind = F.get(F.array(*[F.lit(r.kind) for r in rules]), place.cast("int") - 1)
        ordered = F.array_sort(F.collect_set(F.struct("s.start", place.alias("place"), "s.end", kind.alias("kind"))))
        return stage(found.groupBy("blob").agg(ordered.alias("spans")), "findings")


def blob(text: str) -> Column:
    """Address of a content; NULL counts as empty."""
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its ``blob`` and ``spans`` (start, place, end, kind).

    A row is a version of the path doc_id. NULL and empty texts are one blob without findings. Equal
    rows stay equal rows, NULL doc_ids are a path like any other, and further columns are left out.
    """
    versions = docs.select(
        F.col("doc_id").cast("long").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(versions, rules)
    paths = versions.select(F.col("path").alias("doc_id"), blob("text").alias("blob"))
    kind = "array<struct<start:int,place:bigint,end:int,kind:string>>"
    return paths.join(ledger.findings(rules), "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", F.array().cast(kind)).alias("spans")
    )
