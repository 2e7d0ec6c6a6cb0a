"""Vectors in Arrow batches: which take part, and their matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def usable(vector: Column, zero: bool = True) -> Column:
    """Not null, not empty, without null or non-finite components, and if not ``zero``, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.coalesce(fine & (F.size(vector) > 0), F.lit(False))
    return ok if zero else ok & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length together: their places and their matrix in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[starts[rows][:, None] + np.arange(size)]))
    return out
