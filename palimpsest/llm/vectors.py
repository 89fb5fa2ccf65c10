"""Vectors of Arrow list columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> np.ndarray:
    """Which rows hold a vector: not null, not empty, without null or non-finite components."""
    ok = np.asarray(column.is_valid())
    sizes = np.diff(np.asarray(column.offsets))
    ok &= sizes > 0
    values = column.values
    good = np.asarray(values.is_valid()) & np.isfinite(np.nan_to_num(values.to_numpy(zero_copy_only=False).astype(float), nan=np.nan, posinf=np.inf, neginf=-np.inf))
    bad = np.append(0, np.cumsum(~good))
    offsets = np.asarray(column.offsets)
    return ok & (bad[offsets[1:]] == bad[offsets[:-1]])


def by_dimension(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as float64 rows) of the usable rows, for each length."""
    ok, offsets = usable(column), np.asarray(column.offsets)
    sizes = np.diff(offsets)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = []
    for d in np.unique(sizes[ok]):
        rows = np.flatnonzero(ok & (sizes == d))
        out.append((rows, values[offsets[rows][:, None] + np.arange(d)]))
    return out
