"""What vector search and vector joins share: valid rows and batches of equal width."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, one not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def doubles(column: Column) -> Column:
    return column.cast("array<double>")


def tamed(vector: Column) -> Column:
    """``vector``, or, where its squares would leave the range of doubles, the vector divided by its
    largest component, which has the same direction."""
    largest = F.array_max(F.transform(vector, lambda c: F.abs(c)))
    return F.when((largest > 0) & ((largest < 1e-100) | (largest > 1e100)), F.transform(vector, lambda c: c / largest)).otherwise(vector)


def width(rows: DataFrame, vector: str) -> int:
    """Length of the longest vector (0 without rows); shorter ones count as padded with zeros."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array, padded with zeros to ``dim``."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, int)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
