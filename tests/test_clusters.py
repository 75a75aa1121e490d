"""Clustering by density of crowds: exact, and without a table of all pairs."""

import numpy as np
import pytest
from test_more import plain_dbscan

from voxloom.operators import clustering

SCHEMA = "id long, x double, y double, z double, w double"


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that clustering writes."""
    rows, cut = [], clustering.cut

    def counted(df):
        table = cut(df)
        rows.append(table.count())
        return table

    monkeypatch.setattr(clustering, "cut", counted)
    return rows


@pytest.mark.parametrize("weight", [0.0, 0.5])
def test_crowds_write_no_pairs(spark, written, weight):
    r = np.random.default_rng(5)
    crowd = np.round(np.concatenate([r.normal(0, 4, (1200, 4)), r.normal(0, 60, (60, 4))]))
    points = [(i, *map(float, p)) for i, p in enumerate(np.concatenate([crowd, crowd[:100]]))]
    got = {q.id: q.cluster for q in clustering.dbscan(spark.createDataFrame(points, SCHEMA), 30.0, 6, weight).collect()}
    assert got == plain_dbscan(points, 30.0, 6, weight)
    # All pairs in reach are more than 1,200 squared.
    assert max(written) < 40 * len(points)


@pytest.mark.parametrize("weight", [0.0, 0.5])
@pytest.mark.parametrize(("gap", "clusters"), [(10, 2), (9, 1)])
def test_crowds_just_in_and_out_of_reach(spark, weight, gap, clusters):
    """Two cubes of samples whose nearest ones are ``gap`` apart, of which 2 * 0.5 by intensity where that counts."""
    cube = [(x, y, z) for x in range(5) for y in range(5) for z in range(5)]
    move = 4 + gap - (1 if weight else 0)
    places = [(*p, 7) for p in cube] + [(x + move, y, z, 9) for x, y, z in cube]
    points = [(i, *map(float, p)) for i, p in enumerate(places)]
    got = {q.id: q.cluster for q in clustering.dbscan(spark.createDataFrame(points, SCHEMA), 10.0, 6, weight).collect()}
    assert got == plain_dbscan(points, 10.0, 6, weight)
    assert len(set(got.values())) == clusters


def test_points_without_a_place_are_noise(spark):
    points = [(i, float(i), 0.0, 0.0, 1.0) for i in range(4)] + [(i, v, 0.0, 0.0, 1.0) for i, v in enumerate([float("nan"), float("inf"), None] * 4, 4)]
    for weight in (0.0, 0.5):
        got = {q.id: q.cluster for q in clustering.dbscan(spark.createDataFrame(points, SCHEMA), 1.5, 3, weight).collect()}
        assert got == {i: 1 if i < 4 else None for i in range(16)}


def test_noise_alone_looks_around(spark, written):
    r = np.random.default_rng(6)
    spots = np.concatenate([r.normal(0, 3, (300, 3)), r.normal(40, 3, (300, 3)), r.random((30, 3)) * 80 - 20])
    points = spark.createDataFrame([(i, *map(float, p), 1.0) for i, p in enumerate(spots)], SCHEMA)
    clusters = {i: 0 if i < 300 else 300 if i < 600 else None for i in range(len(spots))}
    named = spark.createDataFrame(list(clusters.items()), "id long, cluster long")
    got = {q.id: q.cluster for q in clustering.without_noise(points, named, 20.0).collect()}
    near = np.linalg.norm(spots[:, None] - spots[None], axis=2) < 20.0
    while True:
        votes = {i: [clusters[j] for j in np.flatnonzero(near[i]) if clusters[j] is not None] for i in clusters if clusters[i] is None}
        found = {i: min(v, key=lambda c: (-v.count(c), c)) for i, v in votes.items() if v}  # noqa: B023
        if not found:
            break
        clusters |= found
    assert got == clusters
    # All pairs in reach are 180,000.
    assert max(written) <= len(spots)
