"""Arrow column <-> numpy helpers used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """List column of equal-length numeric lists -> (rows, dim) float64.

    With ``dim`` given, lists of another length (or NULL) are refused.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = len(column)
    if rows == 0:
        return np.empty((0, dim or 0))
    if dim is not None:
        sizes = column.value_lengths()
        if column.null_count or sizes.to_numpy().min() != dim or sizes.to_numpy().max() != dim:
            raise ValueError(f"dimension mismatch: vectors differ from the expected length {dim}")
    return flat.reshape(rows, -1)


def vector(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def list_column(values: np.ndarray, value_type=pa.float64()) -> pa.Array:
    """(rows, dim) -> Arrow list column."""
    rows, dim = values.shape
    offsets = pa.array(np.arange(0, (rows + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(rows + 1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).reshape(-1), type=value_type))


