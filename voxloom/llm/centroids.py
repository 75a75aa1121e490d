"""Centroid clustering in exact integers, with partial distances.

Components become integers, floor(scale * x).  A round sends the few centroids
to all tasks; each task assigns its vectors and returns one sum a cluster, so
a round moves as many rows as there are tasks and clusters, whatever the
clusters' sizes.  Distances build up over the dimensions of largest variance
first: one centroid, the nearest so far, is finished to give a bound, and
another is given up once its partial distance is strictly above the bound.
What is never above it is finished over all dimensions, so the nearest
centroid is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored, tidy

#: Integers of at least this size are refused: squared distances would not fit a long.
LIMIT = 1 << 27
#: Vectors compared at once, and dimensions between two looks at the bound.
ROWS, STEP = 8192, 8


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; of equal ones the smaller number.

    ``order`` lists the dimensions in which distances build up.
    """
    x, c = x[:, order].astype(np.int64), centroids[:, order].astype(np.int64)
    n, k = len(x), len(c)
    partial = np.zeros((n, k), np.int64)
    for d in range(min(STEP, x.shape[1])):
        partial += (x[:, d, None] - c[None, :, d]) ** 2
    first, every = partial.argmin(1), np.arange(n)
    bound = partial[every, first] + ((x[:, STEP:] - c[first, STEP:]) ** 2).sum(1)
    row, number = np.nonzero((partial <= bound[:, None]) & (np.arange(k) != first[:, None]))
    far = partial[row, number]
    for at in range(STEP, x.shape[1], STEP):
        far = far + ((x[row, at : at + STEP] - c[number, at : at + STEP]) ** 2).sum(1)
        alive = far <= bound[row]
        row, number, far = row[alive], number[alive], far[alive]
    best, distance = first.copy(), bound.copy()
    np.minimum.at(distance, row, far)
    best[distance < bound] = k
    tied = far == distance[row]
    np.minimum.at(best, row[tied], number[tied])
    return best, distance


def _integers(dims: int, scale: int):
    """Kept vectors as integers; rows of other vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            ends = column.offsets.to_numpy()
            fits = (np.diff(ends) == dims) & column.is_valid().to_numpy(zero_copy_only=False)
            # A null component reads as NaN.
            values = column.values.to_numpy(zero_copy_only=False)
            x = values[(ends[:-1][fits][:, None] + np.arange(dims)).ravel()].reshape(-1, dims)
            finite = np.isfinite(x).all(1)
            fits[fits] = finite
            with np.errstate(over="ignore"):
                x = np.floor(scale * x[finite])
            if len(x) and np.abs(x).max() >= LIMIT:
                raise ValueError(f"a component times {scale} reaches {LIMIT}: its distances would not fit a long")
            raw = [v.tobytes() for v in x.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(fits)), pa.array(raw, pa.binary())], names=["vec_id", "x"])

    return run


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, np.frombuffer(b"".join(part.column("x").to_pylist()), np.int32).reshape(-1, dims)


def _moments(dims: int):
    """One row a dimension and task: count, sum and sum of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, dims))
        for _, x in _matrices(batches, dims):
            x = x.astype(float)
            total += np.stack([np.full(dims, len(x)), x.sum(0), (x**2).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), *[pa.array(t) for t in total]], names=["dim", "n", "s", "ss"])

    return run


def _sums(centroids: np.ndarray, order: np.ndarray):
    """One row a cluster and task: its vectors' count and componentwise sum."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _matrices(batches, dims):
            near, _ = nearest(x, centroids, order)
            counts += np.bincount(near, minlength=k)
            np.add.at(sums, near, x)
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(counts[on]), pa.array(list(sums[on]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, centroids.shape[1]):
            near, distance = nearest(x, centroids, order)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


@dataclass
class Clusters:
    centroids: np.ndarray
    #: vec_id, cluster, distance
    rows: DataFrame


def fit(kept: DataFrame, clusters: int, rounds: int, seed: int, dims: int) -> Clusters:
    """Lloyd's rounds over the stored table ``kept`` (vec_id, x)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    # As many rows as clusters, one variance a dimension, and a sum for each cluster and dimension reach the driver.
    firsts = kept.orderBy(name, "x").limit(clusters).select("x").collect()
    centroids = np.array([np.frombuffer(r["x"], np.int32) for r in firsts], np.int64).reshape(-1, dims)
    order = np.arange(dims)
    if len(firsts):
        moments = kept.mapInArrow(_moments(dims), "dim int, n double, s double, ss double").groupBy("dim").agg(*[F.sum(k).alias(k) for k in ("n", "s", "ss")])
        spread = {r["dim"]: r["ss"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in moments.collect()}
        order = np.array(sorted(spread, key=lambda d: (-spread[d], d)))
        for _ in range(rounds):
            sums = kept.mapInArrow(_sums(centroids, order), "cluster int, n long, sums array<long>")
            each = sums.select("cluster", "n", F.posexplode("sums").alias("dim", "sum"))
            for r in each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect():
                centroids[r["cluster"], r["dim"]] = r["sum"] // r["n"]
    rows = kept.mapInArrow(_assigned(centroids, order), "vec_id long, cluster int, distance long")
    return Clusters(centroids, stored(rows, "assigned"))


@tidy
def cluster_vectors(vectors: DataFrame, clusters: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept row of ``vectors`` (vec_id, embedding).

    Kept are vectors of exactly ``dims`` components, none of them null or not
    finite; others have no row.  Centroids start as the kept vectors with the
    smallest SHA-256 of ``seed:vec_id`` (a null id is empty text; rows of one
    id go by their integers' bytes), fewer where fewer are kept.  A round
    assigns all vectors, then moves each centroid that has any to the floor of
    their mean; after the last one vectors are assigned once more.  Repeated
    rows count each; other columns are ignored; an empty table, or one of
    which nothing is kept, gives an empty result.  A component that times
    ``scale`` reaches 2^27 stops the run: its distances would not fit a long.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = stored(rows.mapInArrow(_integers(dims, scale), "vec_id long, x binary"), "integers")
    found = fit(kept, clusters, rounds, seed, dims)
    # One row a cluster.
    sums = found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    whole = sum(r["s"] for r in sums)
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    table = [(r["cluster"], r["s"], whole, names[r["cluster"]]) for r in sums]
    totals = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
