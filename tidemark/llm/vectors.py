"""Embeddings as vectors of integers, cleaned by Spark expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SCALE = 256


def usable(vector: Column, reach: float) -> Column:
    """Whether a vector is there, without null, NaN or a component of `reach` or more in size."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= F.lit(reach)))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("int"))


def reach_of(dims: int) -> float:
    """Components below this keep every sum, gap and squared distance inside 64 bits."""
    return float((2**30 // max(dims, 1)) / SCALE)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equally long integer vectors as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
