"""Centroid clustering against plain loops over Python integers."""

import math
from hashlib import sha256

import numpy as np
import pytest

from voxloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, x string, cluster string, distance string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "c", "d") for i, v in rows], SCHEMA)


def plain(rows, k=16, rounds=3):
    kept = [(i, tuple(math.floor(64 * c) for c in v)) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda i: sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cents = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], np.int32).tobytes()))[:k]]
    assign = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        near = [assign(x)[1] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), a in zip(kept, near, strict=True) if a == j]
            if mine:
                cents[j] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    found = [assign(x) for _, x in kept]
    inertia = [sum(d for d, j in found if j == n) for n in range(len(cents))]
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, inertia[j], sum(inertia), names[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=repr)


def vectors(seed, n):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(7, 64)) * r.uniform(0, 1, 64)
    return [[float(c) for c in middle[r.integers(7)] + 0.1 * r.normal(size=64)] for _ in range(n)]


def test_clusters_equal_plain_loops(spark):
    made = vectors(2, 600)
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None, *[1.0] * 63], [float("nan"), *[1.0] * 63], [float("-inf"), *[1.0] * 63], [0.0] * 64, [-0.001] * 64]
    rows = list(enumerate(made)) + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, made[5]), (None, made[6]), (4, made[4]), (4, made[8])] + [(5000 + i, made[0]) for i in range(200)]
    found = centroids.cluster_vectors(table(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, n):
    rows = list(enumerate(vectors(3, n)))
    assert sorted(map(tuple, centroids.cluster_vectors(table(spark, rows)).collect()), key=repr) == plain(rows)


def test_equal_starts_and_far_components(spark):
    rows = [(i, [1.5] * 64) for i in range(40)] + [(100 + i, [float(i % 3), -1e6, *[0.0] * 62]) for i in range(9)]
    assert sorted(map(tuple, centroids.cluster_vectors(table(spark, rows)).collect()), key=repr) == plain(rows)
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster_vectors(table(spark, [(1, [1e300] * 64)]))


@pytest.mark.parametrize("dims", [3, 8, 64])
def test_partial_distances_find_the_nearest(dims):
    r = np.random.default_rng(dims)
    x, c = r.integers(-4, 5, (3000, dims)), r.integers(-4, 5, (16, dims))
    c[5] = c[2]
    far = ((x[:, None] - c[None]) ** 2).sum(2)
    best, distance = centroids.nearest(x.astype(np.int32), c, np.argsort(-x.var(0)))
    assert (best == far.argmin(1)).all() and (distance == far.min(1)).all()
