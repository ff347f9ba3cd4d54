"""Whitening of embeddings: moments merged by Chan's formula, eigenvectors of the covariance, and a second pass that verifies.

Entries become whole numbers. The fit list, each distinct vector once, is a distributed distinct, written once. Each
partition makes count, local mean and centred scatter; ``treeReduce`` merges them by pairs on the executors, and the
driver gets one count, mean and scatter (8 * dim**2 bytes) and solves for the eigenvectors. The second pass projects
the fit list and takes the moments of what it gives, by the same merging: their covariance less the identity is the
error that every row carries. Rows are projected in place; no vector is shuffled but for the distinct.

Defined results: a null vector, or one with an entry that is null or not finite, is left out; so is one of another
length than most distinct vectors have (of equally frequent lengths the longer counts), and one of no length.
Components whose variance is under 1e-12 of the trace are none, so that fewer than asked for may come, and none where
all vectors are equal; then no row comes. Entries whose whole number is beyond 64 bits count as the nearest within;
deviations of 2**63 or more count as 2**63 - 1. Repeated rows and null ids are rows of their own; further columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import drop_table, materialize

SCALE, COMPONENTS = 256, 4
#: Share of the trace under which a component has no variance of its own.
FLAT = 1e-12
MOMENTS = "n long, mean binary, scatter binary, total array<string>"


class Model(NamedTuple):
    n: int
    total: list[int]  # by dimension, exact
    explained: np.ndarray  # share of the trace, by component
    project: np.ndarray  # dim x components: eigenvectors over the roots of their eigenvalues
    error: float


def fit_list(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(v): each distinct vector of whole numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets, good = V.lists(b.column(0))
            x, size = V.whole(np.where(np.isfinite(values), values, 0), scale), np.diff(offsets)
            rows = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([rows.filter(pa.array(good & (size > 0)))], names=["v"])

    return embeddings.select("embedding").mapInArrow(read, "v array<bigint>").distinct()


def moments(vectors: DataFrame, dim: int, project: np.ndarray | None = None, centre: tuple[int, list[int]] | None = None) -> tuple[V.Moments, list[int]]:
    """Moments of all vectors, or of what they are projected to, and the exact sums of the vectors."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, total = None, [0] * dim
        for b in batches:
            x = V.whole_matrix(b.column(0), dim)
            if not len(x):
                continue
            exact = x.astype(object) if float(np.abs(x).max()) * len(x) >= 2.0**62 else x
            total = [a + int(z) for a, z in zip(total, exact.sum(0), strict=True)]
            part = V.Moments.of(x.astype(float) if project is None else centred(x, *centre) @ project)
            all_ = part if all_ is None else all_.merge(part)
        if all_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([all_.n]), pa.array([all_.mean.tobytes()], pa.binary()), pa.array([all_.scatter.tobytes()], pa.binary()), pa.array([[str(z) for z in total]])], names=["n", "mean", "scatter", "total"])

    def read(row) -> tuple[V.Moments, list[int]]:
        mean = np.frombuffer(bytes(row.mean))
        return V.Moments(row.n, mean, np.frombuffer(bytes(row.scatter)).reshape(len(mean), len(mean))), [int(z) for z in row.total]

    def merge(a: tuple, b: tuple) -> tuple:
        return a[0].merge(b[0]), [p + q for p, q in zip(a[1], b[1], strict=True)]

    return vectors.mapInArrow(local, MOMENTS).rdd.map(read).treeReduce(merge)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S / n, with one rounding where n * x fits into 53 bits."""
    if float(np.abs(x).max(initial=0)) * n < 2.0**53:
        return (x.astype(float) * n - np.array(total, float)) / n
    whole_, rest = zip(*[divmod(t, n) for t in total], strict=True)
    return (x - np.array([int(np.clip(t, -(2**62), 2**62)) for t in whole_])).astype(float) - np.array(rest, float) / n


def fitted(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Model:
    """The model of a fit list of ``dim`` entries; the largest entry of each eigenvector is positive."""
    all_, total = moments(vectors, dim)
    values, found = np.linalg.eigh(all_.covariance())
    trace = float(np.trace(all_.covariance()))
    best = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > FLAT * trace]
    turned = found[:, best] * np.sign(found[np.abs(found[:, best]).argmax(0), best]) if best else found[:, :0]
    project = turned / np.sqrt(values[best])
    if not best:
        return Model(all_.n, total, np.zeros(0), project, 0.0)
    seen, _ = moments(vectors, dim, project, (all_.n, total))
    error = float(np.abs(seen.covariance() - np.eye(len(best))).max())
    return Model(all_.n, total, values[best] / trace, project, error)


def whitened(embeddings: DataFrame, model: Model, scale: int = SCALE) -> DataFrame:
    """A row for each vector and component."""
    dim, k = model.project.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less = np.array([(t + 2**63) % 2**64 - 2**63 for t in model.total], np.int64)
        for b in batches:
            rows, x = V.matrix(b.column(1), dim, scale)
            spread = V.squares(x, model.n, less) if max(map(abs, model.total)) <= V.MOST else np.full(len(x), V.MOST)
            each = np.repeat(np.arange(len(x)), k)
            one = lambda v: pa.array(np.full(len(each), v))
            columns = [b.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), one(model.n), pa.array(spread[each]), pa.array((centred(x, model.n, model.total) @ model.project).ravel()), pa.array(np.tile(model.explained, len(x))), one(model.error)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, schema)


def query(embeddings: DataFrame) -> DataFrame:
    vectors = materialize(fit_list(embeddings), "whitening-fit")
    sizes = vectors.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return whitened(embeddings.limit(0), Model(1, [0], np.zeros(0), np.zeros((1, 0)), 0.0))
    dim = sizes[0]["size"]
    model = fitted(vectors.filter(F.size("v") == dim), dim)
    drop_table(vectors)
    return whitened(embeddings, model)
