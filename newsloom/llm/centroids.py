"""Centroid clustering of integer vectors, screened by segment norms.

Vectors become integers and are written once, compressed, with the norms of
their segments. By Cauchy and Schwarz a segment's inner product is at most the
product of the norms, so the squared distance of vector and centroid is at
least the squared distance of their two lists of norms: a product of small
matrices for a whole batch. Only centroids whose bound doesn't exceed the
distance already found get an exact integer distance. A round sends sums by
cluster and component, combined on the map side; the driver holds nothing but
``k`` centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.storage import cut, written

SCALE, SEGMENT = 256, 4
#: Integers beyond this have squared distances that a long can't hold.
LIMIT = 1 << 27
#: Pairs of vector and centroid whose exact distance is worked out at once.
PAIRS = 1 << 14


def segment_norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms of each row's segments of ``SEGMENT`` components, the last one maybe shorter."""
    squares = np.asarray(x, np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, np.arange(0, x.shape[1], SEGMENT), axis=1))


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), PAIRS):
        gap = x[at : at + PAIRS].astype(np.int64) - c[at : at + PAIRS]
        out[at : at + PAIRS] = np.einsum("ij,ij->i", gap, gap)
    return out


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller number), its squared distance, and how many exact distances it took."""
    own = segment_norms(centroids)
    size = (norms * norms).sum(1)[:, None] + (own * own).sum(1)[None]
    bound = size - 2 * (norms @ own.T) - 1e-9 * size - 1e-6  # never above the true bound, rounding included
    guess = bound.argmin(1)
    distance = np.full(bound.shape, np.iinfo(np.int64).max)
    each = np.arange(len(x))
    first = exact(x, centroids[guess])
    distance[each, guess] = first
    open_ = bound <= first[:, None]
    open_[each, guess] = False
    rows, columns = np.nonzero(open_)
    for at in range(0, len(rows), PAIRS):
        r, c = rows[at : at + PAIRS], columns[at : at + PAIRS]
        distance[r, c] = exact(x[r], centroids[c])
    best = distance.argmin(1)
    return best, distance[each, best], len(x) + len(rows)


def _compress(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(SCALE * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            fits = (np.abs(x) < LIMIT).all(1)
            x = x[fits].astype("<i4")
            norms = segment_norms(x).astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(fits)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in norms], pa.binary())],
                names=["key", "x", "norms"],
            )

    return run


def _arrays(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    x, norms = (np.frombuffer(b"".join(batch.column(n).to_pylist()), kind) for n, kind in (("x", "<i4"), ("norms", "<f8")))
    return x.reshape(-1, dims), norms.reshape(-1, -(-dims // SEGMENT))


def _sums(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, norms = _arrays(batch, dims)
            cluster, _, _ = nearest(x, norms, centroids)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(0, dtype=np.int64)
            n += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(some, dims), pa.int32()), "dim": pa.array(np.tile(np.arange(dims), len(some)), pa.int32()),
            "total": pa.array(total[some].ravel(), pa.int64()), "n": pa.array(np.repeat(n[some], dims), pa.int64()),
        })

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norms = _arrays(batch, centroids.shape[1])
            cluster, distance, _ = nearest(x, norms, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["key", "cluster", "distance"])

    return run


def centroid_clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector with ``dims`` finite components.

    Components become floor(256 x). The first centroids are the ``k`` vectors
    with the smallest sha256 of ``salt`` and key; each round replaces every
    centroid that has vectors by the floor of their exact mean. Defined results:
    vectors that are null, of another length, or with a null or non-finite
    component are left out, and so are those with a component of 524,288 or more,
    whose distances don't fit a long; a null key hashes as empty; repeated rows
    count and are returned each, and as first centroids are ordered by their
    integers; with fewer than ``k`` vectors each is a first centroid; no vectors
    give no rows; other columns, whatever their names, are left out.
    """
    whole = F.col(vector).cast("array<double>")
    fit = vectors.select(F.col(key).cast("bigint").alias("key"), whole.alias("v")).where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    kept, drop = written(fit.mapInArrow(_compress(dims), "key bigint, x binary, norms binary"))
    rank = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = kept.select(rank.alias("rank"), "x").orderBy("rank", "x").limit(k).collect()  # k rows
    if not first:
        drop()
        return vectors.sparkSession.createDataFrame([], "key bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string").withColumnRenamed("key", key)
    centroids = np.stack([np.frombuffer(r["x"], "<i4") for r in first]).astype(np.int64)
    for _ in range(rounds):
        sums = kept.mapInArrow(_sums(centroids), "cluster int, dim int, total bigint, n bigint").groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():  # k x dims rows at most
            centroids[r["cluster"], r["dim"]] = r["total"] // r["n"]
    placed = cut(kept.mapInArrow(_assign(centroids), "key bigint, cluster int, distance bigint"))
    drop()
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    own = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    all_ = own.agg(F.sum("cluster_inertia").alias("inertia"))
    few = own.join(names, "cluster").crossJoin(F.broadcast(all_))  # k rows and one
    return placed.join(F.broadcast(few), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
