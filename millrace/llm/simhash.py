"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most 3 of 64 bits agree in at least two of five blocks of bits, so they
meet in one of ten buckets. In a bucket the fingerprints are stored as 64 bit planes, one bit per
fingerprint; comparing each with its k-th right neighbour is an exclusive-or of every plane with itself
shifted by k, and carry-save counters (ones, twos, more) add up all distances at once. A comparison
ends as soon as no lane is within the radius any more.

Equal fingerprints are one node. A bucket with more than ``MOST`` different fingerprints is split by
its remaining bits into four parts, one of which agrees again, until it is small enough or so few
bits remain that it must be. Buckets yield a spanning star per group, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns_of, stage
from millrace.llm.components import components

RADIUS = 3
SHINGLE = 3
#: Different fingerprints in a bucket that are compared in one go; larger buckets are split.
MOST = 2048
#: Bits of the five blocks: first bit and width.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SPLITS = RADIUS + 1
#: So few bits leave at most 4096 different fingerprints, which are compared whatever their number.
LEAST_BITS = 12


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """The hash of every run of ``shingle`` words, or of all words of a shorter text; none without words."""
    parts = words(text)
    if not parts:
        return []
    joined, last, ends = b" ".join(parts), -1, []
    for word in parts:
        last += len(word) + 1
        ends.append(last)
    begins = [0, *[e + 1 for e in ends[:-1]]]
    of = xxhash.xxh64_intdigest
    if len(parts) < shingle:
        return [of(joined, 42)]
    return [of(joined[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :], strict=False)]


def majority(hashes: list[int]) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: a bit is set where over half of the shingles' hashes have it."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and signed 64-bit ``fp`` of every row of ``docs`` (doc_id, text); not staged."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], "<u8").view("<i8")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps})

    # doc_id travels as text, as pandas would turn numbers beside NULLs into floats.
    read = docs.select(*columns_of(docs, doc_id="string", text="string"))
    return read.mapInPandas(rows, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def planes_of(fps: np.ndarray) -> list[int]:
    """Bit planes of unsigned 64-bit numbers: bit j of plane k is bit k of the j-th number."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def _as_int(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def near_neighbours(planes: list[int], shift: int, comparable: int) -> int:
    """The lanes j of ``comparable`` that are within the radius of lane j + ``shift``, as bits."""
    ones = twos = 0
    over = ~comparable
    for plane in planes:
        differs = plane ^ (plane >> shift)
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if over == -1:
            return 0
    return ~over


def groups_in(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """For lanes sorted by bucket key: the first lane of each lane's group within its bucket."""
    n = len(fps)
    parent, planes = np.arange(n), planes_of(fps)
    for shift in range(1, n):
        same = keys[shift:] == keys[:-shift]
        if not same.any():
            break
        near = near_neighbours(planes, shift, _as_int(same))
        if not near:
            continue
        raw = np.frombuffer(near.to_bytes(n // 8 + 1, "little"), np.uint8)
        left = np.flatnonzero(np.unpackbits(raw, bitorder="little"))
        left = left[parent[left] != parent[left + shift]]
        if len(left):
            for a, b in zip(left.tolist(), (left + shift).tolist(), strict=True):
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
            while (parent != (up := parent[parent])).any():
                parent = up
    return parent


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) between fingerprints of rows that come sorted by bucket."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.repeat(np.diff(np.r_[starts, len(keys)]), np.diff(np.r_[starts, len(keys)]))
        low = 2
        for high in (8, 64, 512, len(keys)):  # buckets of like size share the shifts
            some = (sizes >= low) & (sizes <= high)
            k, f = keys[some], fps[some]
            low = high + 1
            if len(f):
                first = groups_in(k, f)
                linked = first != np.arange(len(f))
                signed = f.view("<i8")
                yield pd.DataFrame({"a": signed[linked], "b": signed[first[linked]]})

    keys, fps = np.empty(0, "<i8"), np.empty(0, "<u8")
    for batch in batches:
        keys = np.concatenate([keys, batch["bucket"].to_numpy("<i8")])
        fps = np.concatenate([fps, batch["fp"].to_numpy("<i8").view("<u8")])
        whole = np.searchsorted(keys == keys[-1], True) if len(keys) else 0  # the last bucket may go on
        yield from links(keys[:whole], fps[:whole])
        keys, fps = keys[whole:], fps[whole:]
    yield from links(keys, fps)


def links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect all of ``nodes`` (different values of ``fp``) within the radius; staged.

    Every group within a bucket comes as a star, so there are fewer links than bucket rows.
    """
    ways = []
    for i, x in enumerate(BLOCKS):
        for y in BLOCKS[i + 1 :]:
            fixed = _mask(range(x[0], sum(x))) | _mask(range(y[0], sum(y)))
            ways.append(F.struct(_long(fixed).alias("fixed"), F.col("fp").bitwiseAND(_long(fixed)).alias("value")))
    rows = nodes.select("fp", F.explode(F.array(*ways)).alias("b")).select(
        "fp", F.xxhash64("b.fixed", "b.value").alias("bucket"), F.bitwise_not("b.fixed").alias("free")
    )
    free_bits, found = 64 - min(BLOCKS[i][1] + BLOCKS[j][1] for i in range(5) for j in range(i)), None
    while True:
        splittable = free_bits > LEAST_BITS
        if splittable:
            sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
            crowded = stage(sizes.where(F.col("n") > most).select("bucket"), "crowded")
            splittable = not crowded.isEmpty()
        small = rows.join(crowded, "bucket", "left_anti") if splittable else rows
        sorted_rows = small.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket", "fp")
        part = sorted_rows.mapInPandas(_compare, "a long, b long")
        found = part if found is None else found.unionByName(part)
        if not splittable:
            return stage(found.where("a <> b").distinct(), "links")
        split = rows.join(crowded, "bucket", "left_semi").mapInPandas(_split, "fp long, bucket long, part long, free long")
        rows = stage(split.select("fp", F.xxhash64("bucket", "part").alias("bucket"), "free"), "split")
        free_bits -= free_bits // SPLITS


def _mask(bits: Iterable[int]) -> int:
    return sum(1 << bit for bit in bits)


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every bucket row in four buckets, one for each quarter of the free bits."""
    for batch in batches:
        for free, same in batch.groupby("free"):
            bits = [bit for bit in range(64) if free >> bit & 1]
            cuts = [len(bits) * k // SPLITS for k in range(SPLITS + 1)]
            for k in range(SPLITS):
                mask = np.uint64(_mask(bits[cuts[k] : cuts[k + 1]]))
                part = (same["fp"].to_numpy("<i8").view("<u8") & mask).view("<i8")
                rest = np.uint64(free & (1 << 64) - 1) & ~mask
                yield pd.DataFrame(
                    {"fp": same["fp"], "bucket": same["bucket"] + k, "part": part, "free": rest.view("<i8")}
                )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Group the rows of ``docs`` (doc_id, text) whose fingerprints link, directly or through others.

    Returns one row per row: ``doc_id``, ``fp`` (signed) and ``component_id``, the smallest doc_id of
    the group. NULL and empty texts have fingerprint zero, which links like any other. NULL doc_ids
    belong to groups but never name one, so a group of NULL doc_ids alone has a NULL name. Equal rows
    stay equal rows. Other columns are left out.
    """
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    groups = components(links(nodes.select("fp")))  # node, root: of linked fingerprints only
    linked = nodes.join(groups, nodes["fp"] == groups["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    linked = stage(linked, "linked")
    names = stage(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "names")
    named = stage(linked.join(names, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
