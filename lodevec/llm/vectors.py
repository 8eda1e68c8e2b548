"""Vectors on the wire: usable rows of a vector table as packed half or single floats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIM = 64


def usable(batch: pa.RecordBatch, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float32 rows of the usable vectors: exactly ``dim`` numbers, all finite, not all zero.

    Rows with a null id take no part.
    """
    ids, lists = batch.column("global_id"), batch.column("embedding")
    n = np.asarray(lists.value_lengths().fill_null(-1))
    ok = (n == dim) & ~np.asarray(ids.is_null())
    at = np.flatnonzero(ok)
    part = lists.take(pa.array(at))
    flat = part.flatten()
    vals = np.asarray(flat.cast(pa.float32()).fill_null(np.nan) if flat.null_count else flat.cast(pa.float32()))
    v = vals.reshape(len(at), dim)
    good = np.isfinite(v).all(1) & (v != 0).any(1)
    gid = ids.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
    return gid[good], np.ascontiguousarray(v[good])


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, float32; scaled first, so that no square over- or underflows."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    return v.astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of matching rows in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a /= np.abs(a).max(1, keepdims=True)
    b /= np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def halves(v: np.ndarray) -> np.ndarray:
    """Which rows survive half precision unchanged."""
    with np.errstate(over="ignore"):
        return (v.astype(np.float16).astype(np.float32) == v).all(1)


def pack(v: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
    """Rows as bytes without loss: half floats where every number survives, else single floats.

    Returns the half rows, the single rows and the mask of half rows (rows keep their order in each).
    """
    h = halves(v)
    return v[h].astype(np.float16).tobytes(), v[~h].tobytes(), h


def unpack(half: bytes, single: bytes, h: np.ndarray, dim: int = DIM) -> np.ndarray:
    out = np.empty((len(h), dim), np.float32)
    out[h] = np.frombuffer(half, np.float16).reshape(-1, dim)
    out[~h] = np.frombuffer(single, np.float32).reshape(-1, dim)
    return out
