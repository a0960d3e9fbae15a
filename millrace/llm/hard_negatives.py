"""Hard negatives by a secondary sort of pair scores.

Anchors are a stated query set that meets all rows, in blocks: a block is broadcast (its size is bounded by
``BLOCK_NUMBERS``), each task scores its rows against it and keeps, per anchor, the few best it has seen.
Scores travel in keys of (anchor, descending score, kind, id) through repartitionAndSortWithinPartitions; a
streaming iterator reads each anchor's keys in that order, opens a window at a positive, hands the negatives
that follow to the open windows, and forgets the rest. No anchor's rows are ever held together.

A block takes two such shuffles: the first finds the positives, and their scores then tell the tasks which
negatives can still be among the first of a window. What is left out is exactly what later steps would
drop, so results are those of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage
from millrace.llm.vectors import by_length
from millrace.operators.staging import new_path

#: Numbers in the vectors of one broadcast block of anchors.
BLOCK_NUMBERS = 1 << 21
TILE = 1024
#: Scores beyond a long count as its limits.
LONG = (1 << 63) - 1
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Kinds of keys: at equal scores a positive comes first, as its window takes in negatives of its own score.
POSITIVE, NEGATIVE = 0, 1


@dataclass
class Block:
    """Anchors of one block; ``parts`` holds their places and vectors by length."""

    ids: np.ndarray
    labels: np.ndarray
    parts: dict[int, tuple[np.ndarray, np.ndarray]]
    #: Score of each anchor's positives, not a number where it has fewer.
    windows: np.ndarray | None = None


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, as floats where these are exact a hundredfold, else as Python integers."""
    reach = rows.shape[1] * int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0))
    if 100 * reach < 1 << 53:
        return rows.astype(float) @ anchors.T.astype(float)
    return np.clip(rows.astype(object) @ anchors.T.astype(object), -LONG, LONG)


class _Best:
    """The first ``k`` (score, id) of each key, by falling score and rising id."""

    def __init__(self, keys: int, k: int):
        self.k, self.floor = k, np.full(keys, -np.inf)
        self.keys = self.scores = self.ids = np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((keys, scores.astype(np.int64), ids))
        if sum(len(w[0]) for w in self.waiting) > TILE * 64:
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.scores, self.ids), *self.waiting]
        keys, scores, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, -scores, keys))
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
        rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
        some = rank < self.k
        self.keys, self.scores, self.ids, self.waiting = keys[some], scores[order][some], ids[order][some], []
        full = rank[some] == self.k - 1
        self.floor[self.keys[full]] = np.nextafter(self.scores[full].astype(float), -np.inf)


def _batch_best(batches: Iterator[pa.RecordBatch], block: Block, k: int, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """The best rows of a partition: positives of each anchor, or negatives of each of its windows."""
    width = 1 if block.windows is None else block.windows.shape[1]
    best = _Best(len(block.ids) * width, k)
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at, x in by_length(batch.column(2)):
            places, anchors = block.parts.get(x.shape[1], (None, None))
            if places is None:
                continue
            for r in range(0, len(x), TILE):
                rows = at[r : r + TILE]
                for c in range(0, len(places), TILE):
                    of = places[c : c + TILE]
                    scores = _scores(x[r : r + TILE], anchors[c : c + TILE])
                    same = labels[rows][:, None] == block.labels[of][None, :]
                    if block.windows is None:
                        fits = [(of, same & (ids[rows][:, None] != block.ids[of][None, :]))]
                    else:
                        tops = [block.windows[of, j] for j in range(width)]
                        fits = [(of * width + j, ~same & (100 * scores >= least * t) & (100 * scores <= most * t)) for j, t in enumerate(tops)]
                    for keys, fit in fits:
                        i, j = np.nonzero(fit & (scores >= best.floor[keys]))
                        if len(i):
                            best.add(keys[j], scores[i, j], ids[rows][i])
    best.settle()
    found = np.unique(np.c_[best.keys // width, best.scores, best.ids], axis=0) if width > 1 else np.c_[best.keys, best.scores, best.ids]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found.T], ["anchor", "score", "id"])


def _first(keys: Iterable, k: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, score, id) of the first ``k`` keys of each anchor."""
    anchor, taken = None, 0
    for (a, minus, _, i), _ in keys:
        anchor, taken = a, taken + 1 if a == anchor else 1
        if taken <= k:
            yield a, -minus, i


def _windows(keys: Iterable, k: int, least: int, most: int) -> Iterator[tuple]:
    """Rows (anchor, positive, rank, negative, scores) from keys in order; holds the open windows only."""
    anchor, windows = None, []
    for (a, minus, kind, i), _ in keys:
        score = -minus
        if a != anchor:
            anchor, windows = a, []
        if kind == POSITIVE:
            windows.append([i, score, 0])
            continue
        windows = [w for w in windows if w[2] < k and 100 * score >= least * w[1]]
        for w in windows:
            if 100 * score <= most * w[1]:
                w[2] += 1
                yield a, w[0], w[2], i, w[1], score


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, numbers: int = BLOCK_NUMBERS
) -> DataFrame:
    """Hard negatives of every row of ``rows`` (vec_id, label, x: whole numbers) where ``anchors`` holds.

    An anchor's positives are the first rows of its label, its negatives those of other labels whose score
    is between ``least`` and ``most`` (not above 100) percent of a positive's; first means by falling inner
    product, then by rising vec_id. Rows with a NULL in vec_id, label or x take no part. Vectors of different
    lengths have no score. A row is no partner of one with its own vec_id. Repeated rows rank each for itself
    as partners; a repeated anchor is one anchor. Without anchors or partners there are no rows. Other
    columns are left out.
    """
    if most > 100:
        raise ValueError("a window cannot reach above its positive")
    spark = rows.sparkSession
    kinds = {"vec_id": "long", "label": "long", "x": "array<long>"}
    marked = rows.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()], anchors.alias("anchor"))
    marked = marked.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    chosen = stage(marked.where("anchor").select("vec_id", "label", "x").distinct(), "anchors")
    size = chosen.agg(F.sum(F.greatest(F.size("x"), F.lit(1)).cast("long")).alias("s")).first().s or 0
    blocks = max(1, math.ceil(size / numbers))
    place = F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks)).alias("block")
    chosen = stage(chosen.select("*", place).repartition("block").sortWithinPartitions("block"), "blocks")
    partners, path = marked.select("vec_id", "label", "x"), new_path(spark, "negatives")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(found: DataFrame, kind: int):
        return found.rdd.map(lambda r: ((r[0], -r[1], kind, r[2]), None))

    def dealt(keys):
        return keys.repartitionAndSortWithinPartitions(parts, lambda key: key[0])

    def found_in(shared, k: int) -> DataFrame:
        return partners.mapInArrow(lambda b: _batch_best(b, shared.value, k, least, most), "anchor long, score long, id long")

    for b in range(blocks):
        block = _block(chosen.where(F.col("block") == b).select("vec_id", "label", "x").toArrow())
        names, shared = block.ids.tolist(), spark.sparkContext.broadcast(block)
        tops = dealt(keyed(found_in(shared, positives), POSITIVE)).mapPartitions(lambda keys: _first(keys, positives)).collect()
        kind = object if any(abs(s) >= 1 << 46 for _, s, _ in tops) else float  # floats are exact a hundredfold below
        block.windows, taken = np.full((len(names), positives), np.nan, kind), [0] * len(names)
        for a, score, _ in sorted(tops, key=lambda t: (t[0], -t[1], t[2])):
            block.windows[a, taken[a]], taken[a] = score, taken[a] + 1
        windows = spark.sparkContext.broadcast(block)
        opening = spark.sparkContext.parallelize([((a, -s, POSITIVE, i), None) for a, s, i in tops])
        keys = dealt(opening.union(keyed(found_in(windows, negatives), NEGATIVE)))
        ids = spark.sparkContext.broadcast(names)
        out = keys.mapPartitions(lambda keys: ((ids.value[r[0]], *r[1:]) for r in _windows(keys, negatives, least, most)))
        spark.createDataFrame(out, OUT, verifySchema=False).write.mode("append").parquet(path)
        for used in (shared, windows, ids):
            used.unpersist()
    return spark.read.schema(OUT).parquet(path)


def _block(anchors: pa.Table) -> Block:
    """The anchors of one block, whose size is bounded."""
    table = anchors.combine_chunks()
    vectors = pa.concat_arrays(table.column("x").chunks) if table.num_rows else pa.array([], pa.list_(pa.int64()))
    parts = {x.shape[1]: (rows, x) for rows, x in by_length(vectors)}
    return Block(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), parts)
