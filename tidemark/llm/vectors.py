"""Packed vectors: what the two embedding operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """True for vectors that are not null, not empty, not zero and hold finite components only."""
    values = vec.cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(values) > 0) & fine & F.exists(values, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of one length as doubles, each scaled by a power of two so that no square overflows."""
    x = np.asarray(column.flatten().cast(pa.float64())).reshape(-1, dim)
    _, exponent = np.frexp(np.abs(x).max(axis=1)) if len(x) else (None, np.zeros(0, int))
    return np.ldexp(x, -exponent[:, None])

