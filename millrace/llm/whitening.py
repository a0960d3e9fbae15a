"""Whitening of embeddings: centred covariance over all vectors, leading components, broadcast projection.

Partitions sum up whole numbers first (count and sums by dimension, exactly), then products of centred
vectors; only sums by dimension or by pair of dimensions leave a partition. The driver sees one matrix as
large as a vector's dimension squared, never the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import eigen
from millrace.llm.common import stage
from millrace.llm.vectors import LIMIT, by_length, finite, lists, whole

LONG = (1 << 63) - 1
#: Directions with less than this share of the largest variance are no components.
LEAST_SHARE = 1e-12
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


@dataclass(frozen=True)
class Model:
    """``n`` vectors with ``sums`` and range by dimension; components as columns, with their variances."""

    n: int
    sums: tuple[int, ...]
    low: int
    high: int
    variances: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``: the centred vectors times ``n``, exactly."""
        wide = self.n * max(abs(self.low), abs(self.high)) >= 1 << 62
        kind = object if wide else np.int64
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of squares of ``n * x - sums``; None beyond a long."""
        t = self.centred(x)
        if x.shape[1] * (self.n * (self.high - self.low)) ** 2 <= LONG:
            return (t * t).sum(axis=1).tolist()
        exact = (t.astype(object) ** 2).sum(axis=1).tolist() if x.shape[1] else [0] * len(x)
        return [v if v <= LONG else None for v in exact]

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x).astype(float) / self.n @ (self.components / np.sqrt(self.variances))


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` (whole numbers) of the rows whose vector is there and finite."""
    kept = rows.where(finite(F.col(f"`{vector}`")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col(f"`{vector}`"), 1024, 100_000).alias("x"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By vector length and dimension: vectors, sum (as text), least and greatest."""
    totals: dict[int, list] = {}
    for batch in batches:
        for rows, x in by_length(batch.column(0)):
            known = totals.setdefault(x.shape[1], [0, [0] * x.shape[1], LIMIT * 2, -LIMIT * 2])
            added = x.astype(object) if x.size and np.abs(x).max() >= 1 << 44 else x
            known[0] += len(rows)
            known[1] = [a + int(b) for a, b in zip(known[1], added.sum(axis=0), strict=True)]
            if x.size:
                known[2:] = min(known[2], int(x.min())), max(known[3], int(x.max()))
    out = [(d, at, n, str(s), lo, hi) for d, (n, sums, lo, hi) in totals.items() for at, s in enumerate(sums)]
    if out:
        names = ["length", "at", "n", "total", "low", "high"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)


def _products(batches: Iterator[pa.RecordBatch], of, width: int) -> Iterator[pa.RecordBatch]:
    """Sums of products of the vectors that ``of`` gives for each matrix of this length."""
    total = None
    for batch in batches:
        for _, x in by_length(batch.column(0)):
            if x.shape[1] == width:
                for at in range(0, len(x), 1024):
                    z = of(x[at : at + 1024])
                    total = z.T @ z + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), lists(total, pa.float64())], ["i", "v"])


def _covariance(x: DataFrame, of, width: int, n: int, size: int) -> np.ndarray:
    """The matrix of mean products; summed by cell, so no task holds more than one row of a partition's matrix."""
    parts = x.mapInArrow(lambda batches: _products(batches, of, width), "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in cells.collect():  # as many rows as the matrix has cells
        out[r.i, r.j] = r.v / n
    return (out + out.T) / 2


def fit(rows: DataFrame, count: int = 8) -> Model | None:
    """Fit to all ``rows`` (x: whole numbers). None without vectors.

    Vectors of another length than most have (of the shortest such length, if several) take no part.
    """
    x = rows.select("x")
    parts = x.mapInArrow(_sums, "length long, at long, n long, total string, low long, high long")
    summed = parts.groupBy("length", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    summed = stage(summed, "sums")  # one row for each dimension
    main = summed.groupBy("length").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "length").first()
    if main is None:
        return None
    dims = summed.where(F.col("length") == main.length).orderBy("at").collect()
    n, sums = main.n, tuple(int(r.total) for r in dims)
    bare = Model(n, sums, min(r.low for r in dims), max(r.high for r in dims), np.ones(1), np.zeros((len(sums), 1)), 0.0)
    cov = _covariance(x, lambda m: bare.centred(m).astype(float) / n, len(sums), n, len(sums))
    values, vectors = eigen.leading(cov, count)
    real = values > LEAST_SHARE * max(float(values[0]), 0.0)
    return Model(n, sums, bare.low, bare.high, values[real], vectors[:, real], float(np.trace(cov)))


def identity_error(rows: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all ``rows``."""
    size = len(model.variances)
    if not size:
        return 0.0
    cov = _covariance(rows.select("x"), model.project, len(model.sums), model.n, size)
    return float(np.abs(cov - np.eye(size)).max())


def whitened(rows: DataFrame, model: Model | None) -> DataFrame:
    """One row per vector of ``rows`` (vec_id, x) and component, numbered from 1 by falling variance.

    Repeated rows and NULL ids are rows like others. There are fewer components where the vectors have fewer
    dimensions or directions with variance, and no rows without any. ``deviation`` is NULL beyond a long.
    """
    if model is None:
        return rows.sparkSession.createDataFrame([], OUT)
    shares, count, shared = model.variances / model.trace if model.trace else model.variances, len(model.variances), model

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column(1)):
                if x.shape[1] != len(shared.sums) or not count:
                    continue
                ids = batch.column(0).take(pa.array(np.repeat(at, count)))
                deviations = pa.array(shared.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), count)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                        pa.array(np.full(len(x) * count, shared.n), pa.int64()),
                        deviations,
                        pa.array(shared.project(x).ravel(), pa.float64()),
                        pa.array(np.tile(shares, len(x)), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return rows.select("vec_id", "x").mapInArrow(project, OUT)
