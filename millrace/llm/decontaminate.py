"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window of an item (10 consecutive words, or the whole of a shorter item) is a list of shingles of
three words. As a window must be contained whole, one shingle is a sufficient prefix: the one that
is rarest in the corpus. Documents meet windows at that shingle; its place in the window gives the
place the window would take, which must lie within the document (positional and length bounds), and
the words there are compared with the window's.

What is broadcast is a block of at most ``BLOCK_ROWS`` windows. A larger benchmark is taken in several
blocks, each against all rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns_of, stage

WINDOW = 10
SHINGLE = 3
#: Fixed value: characters that part words, after A-Z are lower-cased.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_ROWS = 100_000


def words(text: Column) -> Column:
    """Words of a text; none for NULL."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.array_remove(F.split(lower, PARTING), ""), F.array().cast("array<string>"))


def _key(of: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from position ``at`` (from 0); NULL beyond the end."""
    parts = [F.get(of, at + k) for k in range(size)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(size), *parts))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Different windows of all items: ``words``, ``n``, and the sorted ``items`` that have them.

    Items without words have no window. Rows without an item_id have windows, but name no item.
    """
    items = benchmark.select(*columns_of(benchmark, item_id="string"), words(F.col("text").cast("string")).alias("w"))
    last = F.greatest(F.size("w") - window, F.lit(0))
    starts = items.where(F.size("w") > 0).select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cut = starts.select("item_id", F.slice("w", F.col("at") + 1, window).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _positions(texts: DataFrame, sizes: list[int], last: Column) -> DataFrame:
    """A row for each word position up to ``last``, with the keys of the shingles that begin there."""
    at = texts.select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    if len(sizes) == 1:
        return at.withColumn("key", _key(F.col("w"), F.col("at"), sizes[0]))
    return at.withColumn("key", F.explode(F.array(*[_key(F.col("w"), F.col("at"), s) for s in sizes])))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Every row of ``docs`` with what it shares with the benchmark; other columns are kept.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``item_ids`` (sorted as
    strings) and ``spans`` (sorted ranges of words that equal a window, end exclusive). A NULL or empty
    text has none. Equal rows are counted each for itself. The text itself is left out, and so are columns of
    ``docs`` that bear the name of an added one.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_words", "n_hit", "item_ids", "spans")]
    found = stage(windows(benchmark, window), "windows")
    blocks = max(1, math.ceil(found.count() / BLOCK_ROWS))
    sizes = [r.s for r in found.select(F.least(F.size("words"), F.lit(shingle)).alias("s")).distinct().orderBy("s").collect()]
    if not sizes:
        sizes = [shingle]

    # Shingles of each window, and how often each occurs in the corpus.
    size = F.least(F.size("words"), F.lit(shingle))
    places = found.select("words", "items", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("place"))
    keyed = reduce(
        lambda column, s: F.when(size == s, _key(F.col("words"), F.col("place"), s)).otherwise(column), sizes, F.lit(None)
    )
    shingles = places.withColumn("key", keyed.cast("long"))
    texts = docs.select(words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    seen = _positions(texts, sizes, F.size("w") - 1).select("key").where(F.col("key").isNotNull())
    wanted = stage(shingles.select("key").distinct(), "shingles")
    met = reduce(DataFrame.unionByName, [seen.join(F.broadcast(b), "key") for b in _blocks(wanted, "key", blocks)])
    counts = stage(met.groupBy("key").agg(F.count(F.lit(1)).alias("seen")), "rarity")
    # The rarest shingle of each window is its prefix; a window with a shingle that never occurs is out.
    rated = shingles.join(counts, "key", "left").groupBy("words").agg(
        F.min_by(F.struct("key", "place", "items"), F.struct(F.coalesce("seen", F.lit(0)), F.col("place"))).alias("p"),
        F.min(F.coalesce("seen", F.lit(0))).alias("least"),
    )
    prefixes = stage(
        rated.where("least > 0").select("p.key", "p.place", F.col("words").alias("window"), "p.items"), "prefixes"
    )

    # Each document has one more position, with a key of its own, so that it is there without any hit.
    own = -1
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in kept]).alias("doc"),
        F.monotonically_increasing_id().alias("row"),
        words(F.col("text").cast("string")).alias("w"),
    )
    marker = prefixes.sparkSession.range(1).select(
        F.lit(own).cast("long").alias("key"), F.lit(None).cast("int").alias("place"),
        F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"),
    )
    at = rows.select("doc", "row", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    key = [F.when(F.col("at") < 0, F.lit(own).cast("long")).otherwise(_key(F.col("w"), F.col("at"), sizes[0]))]
    key += [F.when(F.col("at") >= 0, _key(F.col("w"), F.col("at"), s)) for s in sizes[1:]]
    at = at.withColumn("key", key[0] if len(key) == 1 else F.explode(F.array(*key)))
    begin = F.col("at") - F.col("place")
    inside = (begin >= 0) & (begin + F.size("window") <= F.size("w"))
    exact = F.slice("w", F.greatest(begin, F.lit(0)) + 1, F.size("window")) == F.col("window")
    tables = _blocks(prefixes, "window", blocks)
    tables[0] = tables[0].unionByName(marker)
    met = reduce(DataFrame.unionByName, [at.join(F.broadcast(t), "key") for t in tables])
    joined = met.where(F.col("window").isNull() | (inside & exact))
    per_doc = joined.select(
        "row",
        F.when(F.col("at") < 0, F.struct("doc", F.size("w").alias("n_words"))).alias("head"),
        F.when(F.col("window").isNotNull(), F.struct(begin.alias("a"), (begin + F.size("window")).alias("b"))).alias("hit"),
        "items",
    ).groupBy("row").agg(
        F.first("head", ignorenulls=True).alias("head"), F.array_sort(F.collect_set("hit")).alias("hit"), F.collect_set("items").alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "hit",
        start,
        lambda done, s: F.struct(
            (done["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], done["end"]))).alias("n"),
            F.greatest(done["end"], s["b"]).alias("end"),
        ),
        lambda done: done["n"],
    )
    return per_doc.select(
        "head.doc.*",
        F.col("head.n_words").cast("long").alias("n_words"),
        covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("item_ids"),
        F.col("hit").alias("spans"),
    )


def _blocks(df: DataFrame, by: str, n: int) -> list[DataFrame]:
    """``df`` in ``n`` parts of about equal size."""
    return [df.where(F.pmod(F.xxhash64(by), F.lit(n)) == k) for k in range(n)] if n > 1 else [df]
