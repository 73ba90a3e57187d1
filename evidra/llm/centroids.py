"""Clusters around centroids in whole numbers: nearest by a tournament of bisector tests, exact and the same on any cluster.

Components become floor(scale * x).  For two centroids a < b a vector x is
nearer to b exactly if 2 x (b - a) > |b|^2 - |a|^2: the sign of a linear form
against a threshold, both whole numbers that are computed once a round for all
pairs.  A vector's tournament starts with centroid 0 as the winner; each further
centroid is tested against the winner so far, so k - 1 tests leave one, and a
tie (zero) stays with the smaller number.  Rows of one winner are tested
together by one matrix product.  The distance to the winner is computed last.

The kept vectors are staged once as 32-bit integers.  A round is one job: every
task adds up its vectors by cluster, the sums of the tasks (k rows each) meet by
cluster, and k rows reach the driver, however many vectors there are; k and the
number of components are parameters, so what is broadcast has a fixed size.
Lost tasks read the staged table again.  One cluster may hold all rows: it still
sends one row a task.

A vector is kept if it has exactly ``dims`` components, none null or not finite;
nulls, other lengths and empty arrays are left out.  A null id is carried (and
counts as an empty string in the choice of the first centroids).  Ties in that
choice (repeated ids) go to the vector that comes first by its integers.
Repeated rows count as often as they occur.  With fewer than k kept vectors
there are as many centroids as vectors; an empty table gives no rows.  Extra
columns are not read.  Components beyond 2^27 once scaled raise an error, as squared
distances then exceed 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows whose products are held at once: 64 components of 8 bytes for each.
_ROWS = 4096
LIMIT = 1 << 27


class Bisectors:
    """Normals and thresholds of all pairs of centroids (whole numbers, k x dims)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squares = (centroids * centroids).sum(1)
        self.normals = 2 * (centroids[None] - centroids[:, None])  # [a, b]: towards b
        self.thresholds = squares[None] - squares[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row."""
        best = np.zeros(len(x), np.int64)
        for b in range(1, len(self.centroids)):
            for a in np.unique(best):
                rows = np.flatnonzero(best == a)
                best[rows[x[rows] @ self.normals[a, b] > self.thresholds[a, b]]] = b
        gap = x - self.centroids[best]
        return best, (gap * gap).sum(1)


def whole_vectors(df: DataFrame, id_col: str, vector: str, dims: int, scale: int, scope: str = "") -> DataFrame:
    """(id, q): the kept vectors as little-endian 32-bit integers floor(scale * x); staged."""
    common.ship(df.sparkSession)
    x = F.col(vector)
    good = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = df.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x"))

    def run(batches):
        from evidra.llm import centroids as own

        for b in batches:
            col = b.column("x")
            q = np.floor(scale * col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dims))
            if (np.abs(q) > own.LIMIT).any():
                raise ValueError(f"components beyond {own.LIMIT} after scaling have no squared distance of 64 bits")
            raw = q.astype("<i4").tobytes()
            off = np.arange(len(col) + 1, dtype=np.int32) * 4 * dims
            yield pa.record_batch([b.column("id"), pa.BinaryArray.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(off), pa.py_buffer(raw)])], names=["id", "q"])

    return common.staged(kept.mapInArrow(run, "id long, q binary"), "vectors", scope)


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    _, off, data = col.buffers()
    start = np.frombuffer(off, np.int32)[col.offset] if len(col) else 0
    return np.frombuffer(data, "<i4", len(col) * dims, start).reshape(-1, dims).astype(np.int64) if len(col) else np.zeros((0, dims), np.int64)


def first_centroids(vectors: DataFrame, k: int, dims: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``salt`` and their id, in that order."""
    sha = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = sorted(vectors.orderBy(sha, "q").limit(k).select(sha.alias("sha"), "q").collect(), key=lambda r: (r.sha, bytes(r.q)))
    return np.array([np.frombuffer(r.q, "<i4") for r in rows], np.int64).reshape(-1, dims)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, distance, total): number, summed distance and componentwise sums by cluster; k rows at most."""
    k, dims = centroids.shape

    def run(batches):
        from evidra.llm import centroids as own

        b, n, far, total = own.Bisectors(centroids), np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for batch in own.common.slices(batches, own._ROWS):
            x = own._matrix(batch.column("q"), dims)
            best, d = b.nearest(x)
            n += np.bincount(best, minlength=k)
            for c in np.unique(best).tolist():
                total[c] += x[best == c].sum(0)
                far[c] += sum(d[best == c].tolist())
        c = np.flatnonzero(n)
        cols = [pa.array(c), pa.array(n[c]), pa.array([far[i] for i in c], pa.int64()), *(pa.array(total[c, i]) for i in range(dims))]
        yield pa.record_batch(cols, names=["cluster", "n", "distance", *(f"s{i}" for i in range(dims))])

    names = ["n", "distance", *(f"s{i}" for i in range(dims))]
    part = vectors.select("q").mapInArrow(run, "cluster long, " + ", ".join(f"{x} long" for x in names))
    return part.groupBy("cluster").agg(*[F.sum(x).alias(x) for x in names]).collect()


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:", scope: str = "") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): every kept vector with its final centroid (array of long)."""
    vectors = whole_vectors(df, id_col, vector, dims, scale, scope)
    centroids = first_centroids(vectors, k, dims, salt)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for r in _sums(vectors, centroids):
            moved[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
        if (moved == centroids).all():
            break  # later rounds change nothing
        centroids = moved
    far = {r.cluster: r.distance for r in _sums(vectors, centroids)} if len(centroids) else {}
    total = sum(far.values())

    def run(batches):
        from evidra.llm import centroids as own

        b = own.Bisectors(centroids)
        inertia = np.array([far.get(c, 0) for c in range(len(centroids))], np.int64)
        flat = pa.array(centroids.ravel())
        whole = pa.ListArray.from_arrays(pa.array(np.arange(len(centroids) + 1, dtype=np.int32) * dims), flat)
        for batch in own.common.slices(batches, own._ROWS):
            best, d = b.nearest(own._matrix(batch.column("q"), dims))
            yield pa.record_batch([batch.column("id"), pa.array(best.astype(np.int32)), pa.array(d), pa.array(inertia[best]), pa.array(np.full(len(best), total, np.int64)), whole.take(pa.array(best))], names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return vectors.mapInArrow(run, "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>").withColumnRenamed("id", id_col)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))
