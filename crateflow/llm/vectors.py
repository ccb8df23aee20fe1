"""Embedding columns as numpy blocks, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, dim: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(positions, float64 rows) of the valid vectors: exactly ``dim`` numbers, no NaN or null, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    none = np.zeros(0, np.int64), np.zeros((0, dim))
    if len(column) == 0:
        return none
    offsets = np.asarray(column.offsets, np.int64)
    fits = np.diff(offsets) == dim
    if column.null_count:
        fits &= ~np.asarray(column.is_null())
    at = np.flatnonzero(fits)
    if not len(at):
        return none
    values = column.values
    flat = values.to_numpy(zero_copy_only=False) if values.null_count else np.asarray(values)
    rows = flat[offsets[at][:, None] + np.arange(dim)].astype(np.float64)
    good = ~np.isnan(rows).any(axis=1) & (rows != 0).any(axis=1)
    return at[good], rows[good]
