"""Centroid clustering by annulus search, in whole numbers throughout.

A vector's norm and the norm of a centroid differ by no more than their distance. So a centroid at most as far as a
known one lies, by its norm, in an annulus around the vector's norm as wide as that known distance. The centroids
are sorted by norm; for each vector two binary searches give the annulus, and the centroids in it, both edges
included, are compared exactly; of equal distances the smaller number wins. The known distance is that to the
centroid of the vector's last assignment, or at first to the centroid next in norm.

Vectors are read once, turned into whole numbers, assigned to the starts and written; every further round reads that
table, without a shuffle of vectors. A task sends the sums of each centroid's vectors, one row a centroid; the
driver gets one sum for each centroid and component. Centroids are the model and are held by every task.
``clusters`` also says how many centroids each vector was compared with in its last assignment.

Defined results: a null vector, one of another length, or one with an entry that is null or not finite is left out;
entries whose whole number is beyond 64 bits count as the nearest one within; distances of 2**63 or more count as
2**63 - 1, as do sums of them; repeated rows are rows of their own; a null vec_id is clustered but starts no
centroid; fewer vectors than starts make fewer centroids, none make no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import drop_table, materialize

DIM, SCALE, STARTS, ROUNDS, SALT = 64, 64, 16, 3, "1:"


class Annulus:
    """Centroids by norm, to be searched for the nearest."""

    def __init__(self, centroids: list[list[int]]):
        square = [sum(x * x for x in c) for c in centroids]
        order = sorted(range(len(centroids)), key=lambda i: (square[i], i))
        self.number = np.array(order)
        self.place = np.argsort(self.number)
        self.at = np.array([centroids[i] for i in order], np.int64)
        self.norm = np.sqrt(np.array([float(square[i]) for i in order]))

    def nearest(self, x: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the nearest centroid's number, the squared distance, and how many centroids were compared."""
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        if known is None:
            right = np.searchsorted(self.norm, norm).clip(0, len(self.norm) - 1)
            left = (right - 1).clip(0)
            at = np.where(np.abs(self.norm[left] - norm) < np.abs(self.norm[right] - norm), left, right)
        else:
            at = self.place[known]
        best, number = V.squares(x, 1, self.at[at]), self.number[at]
        bound = np.sqrt(np.where(best == V.MOST, np.inf, best.astype(float)))
        wide = bound + 1e-9 * (bound + norm + self.norm[-1])  # doubles can't lose a centroid on the edge
        lo, hi = np.searchsorted(self.norm, norm - wide, "left"), np.searchsorted(self.norm, norm + wide, "right")
        for k in range(int(lo.min(initial=len(self.norm))), int(hi.max(initial=0))):
            rows = np.flatnonzero((lo <= k) & (k < hi))
            d = V.squares(x[rows], 1, self.at[k])
            better = (d < best[rows]) | ((d == best[rows]) & (self.number[k] < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], self.number[k]
        return number, best, hi - lo


def starts(embeddings: DataFrame, k: int, dim: int = DIM, scale: int = SCALE, salt: str = SALT) -> list[list[int]]:
    """The vectors of the ``k`` least hashes of salt and vec_id (equal ones: the smaller vector), as whole numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = V.matrix(b.column(1), dim, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), V.as_lists(x)], names=["hash", "v"])

    hashed = embeddings.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash"), "embedding")
    return [list(r.v) for r in hashed.mapInArrow(read, "hash string, v array<bigint>").orderBy("hash", "v").limit(k).collect()]


def assigned(embeddings: DataFrame, centroids: list[list[int]], dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, cluster): the vectors as whole numbers and the nearest of ``centroids`` for each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for b in batches:
            rows, x = V.matrix(b.column(1), dim, scale)
            number = search.nearest(x)[0]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), V.as_lists(x), pa.array(number.astype(np.int32))], names=["vec_id", "v", "cluster"])

    return embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(read, "vec_id long, v array<bigint>, cluster int")


def moved(vectors: DataFrame, centroids: list[list[int]], search: bool = True) -> list[list[int]]:
    """The centroids' new places: the floors of their vectors' means. ``search``: vectors are assigned anew first."""
    k, dim = len(centroids), len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, total, count = Annulus(centroids), [[0] * dim for _ in range(k)], [0] * k
        for b in batches:
            x, cluster = V.whole_matrix(b.column(0), dim), b.column(1).to_numpy()
            if search:
                cluster = near.nearest(x, cluster)[0]
            if float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62:
                x = x.astype(object)
            for c in np.unique(cluster):
                own = x[cluster == c]
                count[c] += len(own)
                total[c] = [a + int(z) for a, z in zip(total[c], own.sum(0), strict=True)]
        used = [c for c in range(k) if count[c]]
        sums = pa.array([[Decimal(z) for z in total[c]] for c in used], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([count[c] for c in used], pa.int64()), sums], names=["cluster", "n", "total"])

    tasks = vectors.select("v", "cluster").mapInArrow(add, "cluster int, n long, total array<decimal(38,0)>")
    sums = tasks.select("cluster", "n", F.posexplode("total").alias("i", "part")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))
    new = [list(c) for c in centroids]
    for r in sums.collect():
        new[r.cluster][r.i] = int(r.part) // r.n
    return new


def clusters(embeddings: DataFrame, k: int = STARTS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, compared) of every vector after ``rounds`` rounds, and the centroids."""
    spark = embeddings.sparkSession
    kind = "vec_id long, cluster int, distance long, compared int"
    centroids = starts(embeddings, k, dim, scale)
    if not centroids:  # no vector but those without an id, if any
        return spark.createDataFrame([], kind), []
    vectors = materialize(assigned(embeddings, centroids, dim, scale), "centroid-vectors")
    for turn in range(rounds):
        centroids = moved(vectors, centroids, search=turn > 0)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annulus(centroids)
        for b in batches:
            number, distance, compared = near.nearest(V.whole_matrix(b.column(1), dim), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number.astype(np.int32)), pa.array(distance), pa.array(compared.astype(np.int32))], names=["vec_id", "cluster", "distance", "compared"])

    out = materialize(vectors.mapInArrow(last, kind), "centroid-clusters")
    drop_table(vectors)
    return out, centroids


def query(embeddings: DataFrame) -> DataFrame:
    out, centroids = clusters(embeddings)
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    named = embeddings.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    most = F.lit(V.MOST).cast("decimal(38,0)")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("part"))
    total = sums.agg(F.sum("part").alias("whole"))
    cut = lambda c, name: F.least(F.col(c).cast("decimal(38,0)"), most).cast("long").alias(name)
    facts = sums.crossJoin(F.broadcast(total)).join(named, "cluster").select("cluster", cut("part", "cluster_inertia"), cut("whole", "inertia"), "centroid_sha256")
    # one row for each centroid, as many as the model has
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    """SQL: assignment to the centroids c{i}, and the next ones."""
    return f"""d{i} AS (SELECT vec_id, n, sum((x-c)*(x-c)) AS d FROM x JOIN c{i} USING (i) GROUP BY ALL), a{i} AS (SELECT vec_id, arg_min(n, {{'d': d, 'n': n}}) AS n, CAST(min(d) AS BIGINT) AS d FROM d{i} GROUP BY 1),
 s{i} AS (SELECT n, i, sum(x) AS s, count(*) AS m FROM a{i} JOIN x USING (vec_id) GROUP BY ALL), c{i + 1} AS (SELECT c{i}.n, c{i}.i, CAST(coalesce((s - ((s % m) + m) % m) // m, c) AS BIGINT) AS c FROM c{i} LEFT JOIN s{i} USING (n, i))"""


ORACLE = f"""WITH k AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE}*CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}),
 x AS (SELECT vec_id, unnest(range({DIM})) AS i, unnest(v) AS x FROM k), f AS (SELECT v, row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1 AS n FROM k QUALIFY n < {STARTS}), c0 AS (SELECT n, unnest(range({DIM})) AS i, unnest(v) AS c FROM f),
 {', '.join(map(_round, range(ROUNDS + 1)))}, h AS (SELECT n, sha256(string_agg(c, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY n)
 SELECT vec_id, CAST(n AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN h USING (n)"""
