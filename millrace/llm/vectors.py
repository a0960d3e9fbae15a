"""Vectors in Arrow batches, for the operators over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers beyond this are clamped.
LIMIT = 1 << 52


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; true of one without components."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def whole(vector: Column, factor: int, offset: int = 0) -> Column:
    """``floor(factor * c) + offset`` of every component as a long; clamped where it is beyond 2^52."""
    return F.transform(
        vector.cast("array<double>"),
        lambda c: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(c * factor).cast("double"))).cast("long") + offset,
    )


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length; the column holds no NULLs."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, values[starts[rows][:, None] + np.arange(length)]


def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    n, width = matrix.shape
    offsets = pa.array(np.arange(n + 1) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel(), kind))
