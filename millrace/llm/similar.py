"""Near duplicates by the Jaccard similarity of their word shingles, for the pipeline.

SimHash proposes first: fingerprints over five-word shingles that link within its radius. At a similarity
of 0.8 fingerprints differ in some ten of 64 bits, which no block buckets reach, so MinHash bands say which
texts can have a partner at all: 32 bands of 4 minima pass over a pair of similarity 0.8 with a chance of
5e-8, and over closer pairs with less. Every proposed pair is compared exactly before it links.

Large groups are tied to few of their texts first: in each round the texts of a bucket that are not of its largest group
meet one text of that group and one of a group drawn anew. The largest group asks nobody, so that what stays outside does
not meet each of its texts. Texts whose buckets still hold several groups then go through an exact prefix-filtered
join: their shingles are ordered by rarity, the ``n - ceil(0.8 n) + 1`` rarest of each text are its prefix, and only texts
of different groups that share a prefix shingle, within the length and positional bounds, are compared. Passages that
many texts have are in no prefix, so pairs follow true neighbours.

Before any comparison stands a bound that cannot miss a pair: a text's sketch holds, for each of 512 bits, whether an
odd number of its shingles fall on that bit. Sketches differ in no more bits than their sets differ in shingles, and sets
of n and m shingles at a similarity of 0.8 differ in at most (n + m) / 9. In a crowd of texts that are a little less alike
than 0.8 hardly a pair passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import stage
from millrace.llm.components import components

SHINGLE = 5
#: Least similarity as a fraction.
SHARE = (4, 5)
BANDS, MINIMA = 32, 4
#: Words of 64 bits in a sketch.
SKETCH = 8
#: Rounds end when they link no more than one in so many texts; the exact join finds the rest.
LEAST_GAIN = 200
_FACTORS, _ADDENDS = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * MINIMA), np.uint64)
_FACTORS |= np.uint64(1)


SKETCHES = "row long, digest binary, fp long, bands array<long>, n long, sketch array<long>"


def shingle_set(text: str | None) -> np.ndarray:
    """The different hashes of the runs of five words, or of all words of a shorter text; none without words."""
    return np.unique(np.array(simhash.shingle_hashes(text, SHINGLE), "<u8"))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed key for each band of minima."""
    if not len(hashes):
        return []
    least = np.full(BANDS * MINIMA, -1, "<i8").view("<u8")
    for at in range(0, len(hashes), 1 << 10):
        mixed = hashes[at : at + (1 << 10), None] * _FACTORS + _ADDENDS
        least = np.minimum(least, mixed.min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[k : k + MINIMA].tobytes(), k) for k in range(0, len(least), MINIMA)]
    return np.array(keys, "<u8").view("<i8").tolist()


def sketch(hashes: np.ndarray) -> list[int]:
    """For each bit whether an odd number of ``hashes`` fall on it, as signed words."""
    odd = np.bincount((hashes % (64 * SKETCH)).astype("<i8"), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype("u1")).view("<i8").tolist()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row, text in zip(batch["row"], batch["text"], strict=True):
            hashes = simhash.shingle_hashes(text, SHINGLE)
            fp = int(np.array([simhash.majority(hashes)], "<u8").view("<i8")[0])
            different = np.unique(np.array(hashes, "<u8"))
            digest = xxhash.xxh3_128_digest(different.tobytes())
            rows.append((row, digest, fp, bands(different), len(different), sketch(different)))
        yield pd.DataFrame(rows, columns=["row", "digest", "fp", "bands", "n", "sketch"])


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(text).view("<i8") for text in batch["text"]]
        yield pd.DataFrame({"node": batch["row"], "n": [len(x) for x in sets], "shingles": sets})


def _pairs(pairs: DataFrame, known: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Pairs (a < b), each once and staged, without those of ``known`` and those that ``marks`` rule out."""
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    if marks is not None:
        first, second = (marks.select([F.col(c).alias(f"{c}_{x}") for c in marks.columns]) for x in "ab")
        one = one.join(first, F.col("a") == F.col("node_a")).join(second, F.col("b") == F.col("node_b")).where(_may_be_near())
    one = one.select("a", "b")
    return stage(one if known is None else one.join(known, ["a", "b"], "left_anti"), "pairs")


def _words(of: str) -> list[Column]:
    """The words of a sketch as columns."""
    return [F.get(of, k).alias(f"s{k}") for k in range(SKETCH)]


def _may_be_near() -> Column:
    """The bounds by lengths and sketches on columns named n_a, s0_a, … and n_b, s0_b, …"""
    least, of = SHARE
    differ = [F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(SKETCH)]
    apart = reduce(Column.__add__, differ)
    return _near(F.col("n_a"), F.col("n_b")) & ((least + of) * apart <= (of - least) * (F.col("n_a") + F.col("n_b")))


def _near(a: Column, b: Column) -> Column:
    """The length bound: the smaller set is large enough to be similar to the larger."""
    least, of = SHARE
    return of * F.least(a, b) >= least * F.greatest(a, b)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` that are similar enough; staged."""
    least, of = SHARE
    first = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("of_a")).hint("merge")
    second = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("of_b")).hint("merge")
    both = pairs.join(second, "b").join(first, "a").where(_near(F.col("n_a"), F.col("n_b")))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return stage(both.where((least + of) * common >= least * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "similar")


def prefix_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``texts`` (node, root, n, shingles) with different roots that can be similar enough.

    No pair is missed: two sets with enough in common share one of the prefixes' shingles, whatever the order.
    For each shingle the rows of the root with most of them are not paired among each other, nor looked at
    where no other root has the shingle.
    """
    least, of = SHARE

    @F.pandas_udf("array<long>")
    def sketched(shingles: pd.Series) -> pd.Series:
        return pd.Series([sketch(np.asarray(x, "<i8").view("<u8")) for x in shingles], dtype=object)

    rows = texts.select("node", "root", "n", F.explode("shingles").alias("key"))
    rarity = rows.groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    ordered = Window.partitionBy("node").orderBy("seen", "key")
    ranked = rows.join(rarity, "key").withColumn("at", F.row_number().over(ordered) - 1)
    longest = F.col("n") - F.ceil(F.col("n") * least / of) + 1
    prefix = stage(ranked.where(F.col("at") < longest).select("key", "node", "root", "n", "at"), "prefixes")
    by_root = prefix.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    keys = by_root.groupBy("key").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    mixed = stage(keys.where("roots > 1").select("key", "main"), "mixed")
    marks = stage(texts.select("node", sketched("shingles").alias("sketch")).select("node", *_words("sketch")), "marks")
    # Keys first: most are in one text only.
    met = stage(prefix.join(mixed, "key"), "postings")
    posted = stage(met.join(marks, "node"), "marked")
    names = ("node", "root", "n", "at", *[f"s{k}" for k in range(SKETCH)])
    one = posted.where("root <> main").select("key", "main", *[F.col(c).alias(f"{c}_a") for c in names])
    two = posted.select("key", *[F.col(c).alias(f"{c}_b") for c in names])
    met = one.join(two, "key").where("root_a <> root_b AND (root_b = main OR node_a < node_b)")
    # What lies before the shared shingle, it and what follows bound the overlap.
    most = F.least("at_a", "at_b") + 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
    enough = (least + of) * most >= least * (F.col("n_a") + F.col("n_b"))
    return met.where(_may_be_near() & enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def groups(docs: DataFrame) -> DataFrame:
    """``row`` and ``group`` of every row of ``docs`` (row: different numbers; text).

    Rows share a group where pairs of a similarity of at least 0.8 connect them. Texts with the same shingles
    are one; texts without words are one group and similar to nothing else.
    """
    read = stage(docs.select("row", "text").mapInPandas(_read, SKETCHES), "sketches")
    firsts = [F.first(c).alias(c) for c in ("fp", "bands", "n", "sketch")]
    nodes = stage(read.groupBy("digest").agg(F.min("row").alias("node"), *firsts), "nodes")
    marks = nodes.select("node", "n", *_words("sketch"))
    # Buckets with more than one text.
    filed = stage(nodes.select("node", F.explode("bands").alias("bucket")), "filed")
    shared = stage(filed.groupBy("bucket").count().where("count > 1").select("bucket"), "buckets")
    filed = stage(filed.join(shared, "bucket"), "shared")
    # What SimHash proposes: a text with the first of its fingerprint, and firsts of linked fingerprints.
    firsts = stage(nodes.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    close = simhash.links(firsts.select("fp"))
    near = close.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("__a")), "a")
    near = near.join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("__b")), "b")
    equal = nodes.select("node", "fp").join(firsts, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    pairs = _pairs(equal.union(near.select("__a", "__b")), marks=marks)
    wanted = filed.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = stage(wanted.withColumnRenamed("node", "row"), "wanted").hint("merge")
    texts = docs.select("row", "text").join(wanted, "row", "left_semi")
    sets = stage(texts.mapInPandas(_sets, "node long, n long, shingles array<long>"), "sets", compression="zstd")
    known, found = pairs, _compared(pairs, sets)
    n_texts, n_round, gained = sets.count(), 0, None
    while True:
        linked = components(found)
        placed = filed.join(linked, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        placed = stage(placed, "placed")
        # A bucket's group with most texts and one that is drawn, by one text each; every round draws others.
        of_root, of_node = (F.xxhash64(c, F.lit(n_round)) for c in ("root", "node"))
        by_root = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("rows"), F.min_by("node", of_node).alias("node"))
        one = F.struct("node", "root")
        most, drawn = F.max_by(one, F.struct("rows", of_root)).alias("main"), F.min_by(one, of_root).alias("drawn")
        ends = by_root.groupBy("bucket").agg(most, drawn, F.count(F.lit(1)).alias("roots"))
        mixed = placed.join(stage(ends.where("roots > 1").drop("roots"), "mixed"), "bucket")
        if gained is not None and LEAST_GAIN * gained <= n_texts:
            break
        offered = F.explode(F.array_distinct(F.array("main", "drawn"))).alias("other")
        asking = mixed.where("root <> main.root").select("node", "root", offered).where("root <> other.root")
        pairs = _pairs(asking.select(F.col("node").alias("a"), F.col("other.node").alias("b")), known, marks)
        more = _compared(pairs, sets)
        known, found, gained, n_round = known.union(pairs), found.union(more), more.count(), n_round + 1
    left = stage(mixed.select("node", "root").distinct(), "left").hint("merge")
    rest = _pairs(prefix_pairs(sets.join(left, "node")), known)
    found = found.union(_compared(rest, sets))
    named = nodes.select("digest", "node").join(components(found), "node", "left")
    named = stage(named.select("digest", F.coalesce("root", "node").alias("group")), "named")
    return read.select("row", "digest").join(named, "digest").select("row", "group")
