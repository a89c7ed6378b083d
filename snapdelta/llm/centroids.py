"""Operator 13: k-means over integer vectors, each assigned by a tournament of bisectors.

For two centroids a < b of integers, b is strictly nearer to x where 2x.(b - a) > |b|^2 - |a|^2: the sign of one linear
form. Normals 2(b - a) and thresholds of all pairs are worked out once a round; a vector then meets the centroids in
their order, k - 1 tests in which one of two drops out, and zero keeps the smaller number. Everything is exact, so
neither the order of rows nor their partitions change a result. Only the winner's distance is worked out.

The vectors are written once, as integers. Each round is one pass over them that returns k x d sums a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .token_sets import tidied

#: Integers up to this keep a squared distance of 64 components within 63 bits.
LARGEST = 1 << 27


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals (k, k, d) and thresholds (k, k): x is nearer to b than to a where x.normal[a, b] > threshold[a, b]."""
    square = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), square[None, :] - square[:, None]


def tournament(x: np.ndarray, normal: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the smaller number of equally near ones."""
    best = np.zeros(len(x), np.int64)
    for b in range(1, len(threshold)):
        ahead = np.einsum("ij,ij->i", x, normal[best, b]) > threshold[best, b]
        best[ahead] = b
    return best


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            flat = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield part.column("vec_id"), flat.reshape(part.num_rows, -1)


def _sums(centroids: np.ndarray):
    """Sums and sizes of the clusters of a task's vectors, as (cluster, dim, total, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = bisectors(centroids)
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, x in _rows(batches):
            best = tournament(x, *pairs)
            n += np.bincount(best, minlength=len(n))
            for c in np.unique(best):
                total[c] += x[best == c].sum(axis=0)
        cluster, dim = np.indices(centroids.shape)
        used = n[cluster] > 0
        cols = [cluster[used], dim[used], total[used], n[cluster][used]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["cluster", "dim", "total", "n"])

    return tidied(run)


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = bisectors(centroids)
        for ids, x in _rows(batches):
            best = tournament(x, *pairs)
            off = x - centroids[best]
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array((off * off).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return tidied(run)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x) of the vectors of ``dims`` finite components, as integers floor(scale * component)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c))  # NaN is above infinity
    kept = vectors.where(F.coalesce((F.size(v) == dims) & finite, F.lit(False)))
    whole = lambda c: F.floor(c.cast("double") * scale)
    fits = F.forall(v, lambda c: F.abs(c.cast("double") * scale) <= LARGEST)
    error = F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}: squared distances would not fit 63 bits")).cast("array<int>")
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, F.transform(v, lambda c: whole(c).cast("int"))).otherwise(error).alias("x"))


def clusters(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of ``dims`` finite components.

    Components become floor(scale * x). The first centroids are the ``k`` vectors of the smallest sha256 of
    ``seed:id``; each of ``rounds`` rounds assigns all vectors to their nearest centroid (squared Euclidean distance,
    ties to the smaller number) and moves each centroid that has vectors to the floor of their mean; then they are
    assigned once more. Rounds end early only where no centroid moves, which changes nothing.

    Vectors that are null, of another length, or hold null or non-finite components have no row. Rows of a null id take
    part but are no first centroids unless ids run out. Repeated rows count one by one; rows of one id start in the order
    of their components. With fewer than k vectors there are as many centroids as vectors; an empty table gives an empty
    result. A component beyond 2^27 / scale is an error, since distances would not fit a long. Other columns are
    ignored. k * k * dims numbers are held by each task, k * dims sums come to the driver each round."""
    spark = vectors.sparkSession
    kept = materialise(integer_vectors(vectors, id_col, vector_col, dims, scale), "vectors")
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(by.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    centers = np.array([r.x for r in first], np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        found = kept.mapInArrow(_sums(centers), "cluster long, dim long, total long, n long").groupBy("cluster", "dim")
        moved = centers.copy()
        for r in found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            moved[r.cluster, r.dim] = int(r.total) // r.n
        if (moved == centers).all():
            break
        centers = moved
    out = materialise(kept.mapInArrow(_assigned(centers), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    rows = [(c, s, sum(sums.values()), hashes[c]) for c, s in sums.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
