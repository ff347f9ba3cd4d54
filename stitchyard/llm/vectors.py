"""Columns of vectors as matrices of whole numbers, and statistics of them that merge by pairs.

The sums of squares here are sums of whole numbers. They are taken in 64 bits with wrap-around, which is exact
for every true value under 2**63; larger ones are told by an estimate in doubles, and count as 2**63 - 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST = 2**63 - 1


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values as doubles (NaN for null entries), offsets by row, and which rows are vectors: not null, and every entry finite."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    values = pc.fill_null(col.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)  # flatten leaves out null rows
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    return values, offsets, col.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), held to what 64 bits hold."""
    return np.clip(np.floor(values * scale), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def matrix(col: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the rows that are vectors of ``dim`` entries, and their entries as whole numbers."""
    values, offsets, good = lists(col)
    rows = np.flatnonzero(good & (np.diff(offsets) == dim))
    return rows, whole(values[offsets[rows][:, None] + np.arange(dim)], scale)


def whole_matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` whole numbers, none null, as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def squares(x: np.ndarray, scale: int, less: np.ndarray) -> np.ndarray:
    """Sums of (scale * x - less)**2 by row; ``less`` is one row or as many as ``x``."""
    with np.errstate(over="ignore"):
        part = x * np.int64(scale) - less
        out = (part * part).sum(1)
    far = float(scale) * float(np.abs(x).max(initial=0)) + float(np.abs(less.astype(float)).max(initial=0))
    if x.shape[1] * far * far >= 2.0**62:
        guess = ((x.astype(float) * scale - less.astype(float)) ** 2).sum(1)
        out = np.where(guess >= 2.0**63, MOST, out)
    return out


class Moments:
    """Count, mean and centred scatter of rows, merged by Chan's pairwise formula, so that no sum of raw squares is ever formed."""

    def __init__(self, n: int, mean: np.ndarray, scatter: np.ndarray):
        self.n, self.mean, self.scatter = n, mean, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(0)
        centred = x - mean
        slip = centred.mean(0)  # what rounding of the mean left
        return cls(len(x), mean + slip, centred.T @ centred - len(x) * np.outer(slip, slip))

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        step = other.mean - self.mean
        return Moments(n, self.mean + step * (other.n / n), self.scatter + other.scatter + np.outer(step, step) * (self.n * other.n / n))

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n
