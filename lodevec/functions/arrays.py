"""Vectors of Arrow batches as matrices, by the policy of :mod:`lodevec.functions.vector`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodevec.functions.vector import DIGITS, DIM


def usable_rows(b: pa.RecordBatch, dim: int = DIM, column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """``(rows, matrix)``: the rows with a usable vector, and their vectors. Anything else in the column is skipped."""
    c = b.column(column)
    off = np.asarray(c.offsets)
    fit = np.diff(off) == dim
    if c.null_count:
        fit &= np.asarray(c.is_valid())
    v = c.values
    numbers = (v.fill_null(float("nan")) if v.null_count else v).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fit)
    if len(rows) == len(fit) and len(rows):
        x = numbers[off[0] : off[-1]].reshape(-1, dim)
    else:
        x = numbers[(off[rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return (rows, x) if fine.all() else (rows[fine], x[fine])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in doubles; zero rows stay zero."""
    x = x.astype(np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n > 0, n, 1)[:, None]


def scores(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Rounded cosines of the rows to one query of length one."""
    x = x.astype(np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return np.round((x @ query) / np.where(n > 0, n, 1), DIGITS) + 0.0
