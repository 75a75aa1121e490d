"""Operators of the third catalogue and the streams, against plain versions."""

import math
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.functions import geometry
from voxloom.operators import bricks, clustering, components, records, rulers, segmentation, stats, stencil, timeseries, tracking
from voxloom.streaming import frames

VOX = "t int, c int, z int, y int, x int, v int, mask int, label long"


def volume(spark, a, labels=None):
    rows = [(0, 0, *map(int, p), int(a[p]), 255, int(labels[p]) if labels is not None else 0) for p in np.ndindex(a.shape) if a[p]]
    return spark.createDataFrame(rows, VOX)


def plain_runs(on):
    """Label of each true place: one more than the scan place of its run's first place."""
    out = {}
    for p in sorted(map(tuple, np.argwhere(on))):
        if p in out:
            continue
        name, todo = (int(p[0]) << 40 | int(p[1]) << 20 | int(p[2])) + 1, deque([p])
        out[p] = name
        while todo:
            q = todo.popleft()
            for d in np.ndindex(3, 3, 3):
                n = tuple(int(a + b - 1) for a, b in zip(q, d, strict=True))
                if all(0 <= k < s for k, s in zip(n, on.shape, strict=True)) and on[n] and n not in out:
                    out[n] = name
                    todo.append(n)
    return {tuple(map(int, k)): v for k, v in out.items()}


@pytest.mark.parametrize("side", [4, 32])
def test_growth_over_bricks_matches_a_flood(spark, monkeypatch, side):
    monkeypatch.setattr(segmentation, "SIDE", side)
    import pyspark.cloudpickle as pickle

    a = (np.random.default_rng(side).random((9, 14, 17)) < 0.09) * 200
    pickle.register_pickle_by_value(segmentation)
    try:
        got = {(r.z, r.y, r.x): r.label for r in segmentation.grow(volume(spark, a), 100).collect()}
    finally:
        pickle.unregister_pickle_by_value(segmentation)
    assert got == plain_runs(a > 100)


def test_stop_function_falls_off():
    a = np.full((5, 5, 5), 0.5)
    run = stencil.stop(0.6, 0.02, 0.05)
    assert run(a, 1)[1, 1, 1] == pytest.approx(math.exp(-0.01 / 0.02))
    assert stencil.stop(0.6, 0.0, 0.0)(a, 1).max() == 0 and stencil.stop(0.4, 0.0, 0.0)(a, 1).min() == 1
    a[:, :, 3:] = 1.0
    assert run(a, 1)[1, 1, 1] == pytest.approx(math.exp(-0.0625 / 0.05) * math.exp(-0.01 / 0.02))
    a[:, :, 3:] = 5.0
    assert run(a, 1)[1, 1, 1] == 0


def plain_baseline(values, cut=0.001):
    left, least = list(values), max(1, len(values) // 10)
    while True:
        mean = sum(left) / len(left)
        var = sum((v - mean) ** 2 for v in left) / len(left)
        if var < cut:
            return mean
        for k in range(7):
            kept = [v for v in left if (v - mean) / var <= 2.0**-k]
            if len(kept) < len(left):
                break
        if len(kept) == len(left):
            return mean
        left = kept
        if len(left) <= least:
            return mean


def test_baselines_trim_outliers():
    r = np.random.default_rng(1)
    for _ in range(60):
        v = r.gamma(2.0, 0.3, int(r.integers(1, 60)))
        assert timeseries.constant_baseline(v) == pytest.approx(plain_baseline(v))
    line = 0.5 * np.arange(30) + 2
    assert timeseries.linear_baseline(line) == pytest.approx((0.5, 2.0))
    assert timeseries.linear_baseline(np.array([3.0])) == (0.0, 3.0) and timeseries.constant_baseline(np.array([])) == 0.0


def test_principal_lengths_are_eigenvalues(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(20):
        m = r.normal(size=(3, 3))
        m = m @ m.T if k else np.eye(3) * 2
        rows.append((k, 5, *[float(m[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))], m.tolist()))
    df = spark.createDataFrame([q[:8] for q in rows], "k int, n int, sxx double, sxy double, sxz double, syy double, syz double, szz double")
    for q in stats.principal_lengths(df).collect():
        assert [q.e1, q.e2, q.e3] == pytest.approx(np.linalg.eigvalsh(np.array(rows[q.k][8]))[::-1].tolist(), abs=1e-8)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_nearest_components_by_rings(spark, k):
    r = np.random.default_rng(k)
    places = np.concatenate([r.random((40, 3)), r.random((12, 3)) * 500])
    df = spark.createDataFrame([(0, i % 2, i, *map(float, p)) for i, p in enumerate(places)], "t int, c int, label long, cx double, cy double, cz double")
    got = {(q.a, q["rank"]): q.b for q in components.nearest_components(df, k).collect()}
    want = {}
    for i in range(len(places)):
        near = sorted((round(float(np.linalg.norm(places[i] - places[j])), 6), j) for j in range(len(places)) if j != i and j % 2 == i % 2)
        want |= {(i, n + 1): j for n, (_, j) in enumerate(near[:k])}
    assert got == want


def plain_dbscan(points, eps, least, weight=0.0):
    far = lambda p, q: math.dist(p[1:4], q[1:4]) + weight * abs(p[4] - q[4])
    near = {p[0]: [q[0] for q in points if far(p, q) < eps] for p in points}
    core = {i for i, n in near.items() if len(n) >= least}
    root = {}
    for i in sorted(core):
        todo = [] if i in root else [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += [k for k in near[j] if k in core]
    return {i: root.get(i, min((root[k] for k in n if k in core), default=None)) for i, n in near.items()}


@pytest.mark.parametrize(("eps", "least", "weight"), [(1.0, 4, 0.0), (2.5, 3, 0.0), (0.7, 6, 0.0), (1.5, 4, 0.4)])
def test_dbscan_matches_brute_force(spark, eps, least, weight):
    r = np.random.default_rng(int(eps * 10))
    spots = np.concatenate([r.normal(0, 0.6, (60, 3)), r.normal(3, 0.5, (60, 3)), r.random((40, 3)) * 8 - 2])
    points = [(i, *map(float, p), float(r.random() * 2)) for i, p in enumerate(spots)]
    df = spark.createDataFrame(points, "id long, x double, y double, z double, w double")
    got = {q.id: q.cluster for q in clustering.dbscan(df, eps, least, weight).collect()}
    assert got == plain_dbscan(points, eps, least, weight)


@pytest.mark.parametrize("method", ["dbscan", "kmeans", "mixture"])
def test_clusters_become_labels(spark, method):
    a = np.zeros((3, 12, 12), int)
    a[:, 0:3, 0:3], a[:, 8:11, 8:11] = 100, 200
    labels = np.where(a == 100, 1, 2)
    got = clustering.cluster_labels(volume(spark, a, labels), 0, 0, method, 2, 1.8, 4, 1, 1).collect()
    groups = {v: {q.label for q in got if q.v == v} for v in (100, 200)}
    assert len(got) == 54 and all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values()) - {1, 2}) == 2


def test_linked_parts_take_the_roots_colour(spark):
    cells = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 1, 7), (0, 0, 1, 258), (0, 0, 1, 9), (0, 0, 2, 511), (0, 0, 2, 8)], "t int, c int, brick int, label long")
    links = spark.createDataFrame([(0, 0, 0, 5, 0, 5), (0, 0, 1, 7, 0, 5), (0, 0, 1, 9, 0, 5), (0, 0, 2, 511, 0, 5)], "t int, c int, brick int, label long, root_brick int, root_label long")
    got = {(q.brick, q.label): q.new for q in bricks.consistent_labels(cells, links).collect()}
    # 258 is taken in brick 1; 511 has the colour of 5 already.
    assert got == {(1, 7): 5, (1, 9): 511}


def test_protractor_and_ellipse(spark):
    row = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0)], "ax double, ay double, az double, x double, y double, z double, bx double, by double, bz double")
    at = lambda n: tuple(F.col(n + k) for k in "xyz")
    assert row.select(geometry.protractor(at("a"), at(""), at("b"))).first()[0] == pytest.approx(90.0)
    assert row.select(geometry.protractor(at("a"), at("a"), at("b"))).first()[0] == 0.0
    p, q = geometry.ellipse_ends(at("a"), at(""), (0.0, 0.0, 1.0))
    got = sorted(tuple(round(v, 9) for v in row.select(*e).first()) for e in (p, q))
    assert got == [(0.5, -0.5, 0.0), (0.5, 0.5, 0.0)]


def test_parameters_are_set_and_read(spark):
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, {})], "id int, params map<string,double>")
    got = records.with_parameters(df, {"b": 5.0, "c": 7.0}).select("id", *[records.parameter(k, -1.0).alias(k) for k in "abcd"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 5.0, 7.0, -1.0), (2, -1.0, 5.0, 7.0, -1.0)]


def test_nearest_record_in_blocks(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.integers(0, 9, 4).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "rec_id long, hist array<long>")
    asked = df.where("rec_id % 5 = 0").select(F.col("rec_id").alias("q_id"), F.col("hist").alias("q_hist"))
    got = {q.q_id: (q.rec_id, q.dist) for q in records.nearest(df, asked, block=7).collect()}
    want = {}
    for i, h in rows[::5]:
        d, j = min((sum((a - b) ** 2 for a, b in zip(h, g, strict=True)), -j) for j, g in rows)
        want[i] = (-j, float(d))
    assert got == want


def test_frames_are_compared_with_the_one_before(spark, tmp_path):
    shown = [(0, {1: 5, 2: 5}), (1, {2: 5, 3: 5}), (2, {2: 6})]
    source = str(tmp_path / "in")
    for t, places in shown:
        rows = [(t, 0, 0, p, label) for p, label in places.items()]
        spark.createDataFrame(rows, "t int, c int, brick int, place long, label long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("t int, c int, brick int, place long, label long").parquet(source)
    run = frames.frame_changes(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("changes").collect())
    assert got == [(0, 0, 0, 2, 0, 0, 2), (1, 0, 0, 2, 1, 1, 1), (2, 0, 0, 1, 0, 1, 0)]


def test_results_grow_and_are_updated(spark, tmp_path):
    shape = "t int, c int, task string, obj string, value double, seq long"
    source, seen = str(tmp_path / "in"), {}
    for seq, (t, value) in enumerate([(0, 1.0), (1, 2.0), (0, 3.0)]):
        spark.createDataFrame([(t, 0, "mean", "a", value, seq)], shape).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)

    def sink(df, _):
        seen.update({(r.t, r.obj): (r.value, r.n) for r in df.collect()})

    frames.results_by_frame(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {(0, "a"): (3.0, 2), (1, "a"): (2.0, 1)}


def test_tasks_see_every_frame(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    volume(spark, np.full((1, 2, 2), 9)).write.parquet(source)
    stream = spark.readStream.schema(VOX).parquet(source)
    frames.per_frame(stream, [lambda df: df.groupBy("t").count()], lambda df, n: seen.extend(r["count"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == [4]


def test_vertices_keep_similar_links_and_adopt_orphans(spark):
    cell = "t int, c int, label long, n long, cx double, cy double, cz double, lo_x int, hi_x int, lo_y int, hi_y int, lo_z int, hi_z int"
    rows = [(t, 0, k, 10, 4.0 * k, 0.0, 0.0, 4 * k, 4 * k + 2, 0, 2, 0, 2) for t in (0, 1) for k in (1, 2, 3)]
    links = spark.createDataFrame([(0, 0, 1, 1, 9, 90, 0.0), (0, 0, 1, 2, 2, 20, 4.0)], "t int, c int, v1 long, v2 long, n long, total long, dist double")
    got = sorted((r.v1, r.v2, r.rule) for r in tracking.vertex_links(spark.createDataFrame(rows, cell), links, 0.2).collect())
    assert got == [(1, 1, "size"), (2, 3, "orphan"), (3, 3, "orphan")] or got == [(1, 1, "size"), (3, 3, "orphan")]
    pairs = spark.createDataFrame([(0, 0, 1, 2), (0, 0, 2, 5), (0, 0, 8, 9)], "t int, c int, a long, b long")
    assert {(r.label, r.bin) for r in tracking.contact_bins(pairs).collect()} == {(1, 1), (2, 1), (5, 1), (8, 8), (9, 8)}


def test_key_frames_ease_and_go_on(spark):
    keys = spark.createDataFrame([(1, 2, 0.0, 0.0, 0.0), (1, 6, 8.0, 4.0, 0.0), (2, 3, 5.0, 5.0, 5.0)], "ruler int, t int, x double, y double, z double")
    ask = spark.createDataFrame([(r, t) for r in (1, 2) for t in (0, 2, 3, 8)], "ruler int, t int")
    at = lambda mode, beyond: {(q.ruler, q.t): q.x for q in timeseries.at_frames(keys, ask, mode, beyond).collect()}
    assert at("linear", "extend") == {(1, 0): -4.0, (1, 2): 0.0, (1, 3): 2.0, (1, 8): 12.0, (2, 0): 5.0, (2, 2): 5.0, (2, 3): 5.0, (2, 8): 5.0}
    assert at("linear", "hold")[1, 0] == 0.0 and at("linear", "hold")[1, 8] == 8.0
    assert at("start", "hold")[1, 3] == pytest.approx(8 * (2 / 16 - 1 / 64)) and at("end", "hold")[1, 3] == pytest.approx(8 * (1 / 4 + 1 / 16 - 1 / 64))


def test_rulers_of_one_point_have_no_frame(spark):
    df = spark.createDataFrame(pd.DataFrame({"ruler": [1], "t": [0], "x": [0.0], "y": [0.0], "z": [0.0]}))
    with pytest.raises(ValueError):
        rulers.transformed(df, 1, 1.0)


def plain_kmeans(points, k):
    at = np.array([p[1:4] for p in points])
    w = np.array([p[4] for p in points])
    centres = [at[min(range(len(w)), key=lambda i: (-w[i], i))]]
    while len(centres) < k:
        d = ((at - centres[-1]) ** 2).sum(axis=1)
        centres.append(at[min(range(len(w)), key=lambda i: (-d[i], i))])
    centres = np.array(centres)
    while True:
        of = ((at[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([np.average(at[of == i], axis=0, weights=w[of == i]) if (of == i).any() else centres[i] for i in range(k)])
        if np.linalg.norm(new - centres, axis=1).max() <= 1e-6:
            return of
        centres = new


def blobs(spark):
    r = np.random.default_rng(4)
    spots = np.concatenate([r.normal(m, 1.0, (50, 3)) for m in (0, 9, 20)])
    points = [(i, *map(float, p), float(1 + r.random())) for i, p in enumerate(spots)]
    return points, spark.createDataFrame(points, "id long, x double, y double, z double, w double")


def test_kmeans_matches_a_plain_loop(spark):
    points, df = blobs(spark)
    found, settled = clustering.kmeans(df, 3)
    assert settled and [r.cluster for r in found.orderBy("id").collect()] == plain_kmeans(points, 3).tolist()


def test_mixture_settles_on_the_moments(spark):
    points, df = blobs(spark)
    parts = sorted(clustering.gaussian_mixture(df, 3, eps=1e-9), key=lambda p: p["mean"][0])
    at, w = np.array([p[1:4] for p in points]), np.array([p[4] for p in points])
    for k, part in enumerate(parts):
        mine = slice(50 * k, 50 * k + 50)
        assert part["settled"] and part["mean"] == pytest.approx(np.average(at[mine], axis=0, weights=w[mine]), abs=1e-3)
        assert part["tau"] == pytest.approx(w[mine].sum() / w.sum(), abs=1e-4)
    shares = clustering.memberships(df, parts)
    assert clustering.mixture_quality(shares) > 0.999
    assert {r.bin: r.n for r in clustering.share_histogram(shares, 3, 10).collect()} == {9: 150}


def test_noise_joins_the_commonest_cluster_in_reach(spark):
    rows = [(0, 0.0), (1, 0.5), (2, 1.4), (3, 2.3), (4, 10.0), (5, 10.5), (6, 30.0)]
    df = spark.createDataFrame([(i, x, 0.0, 0.0, 1.0) for i, x in rows], "id long, x double, y double, z double, w double")
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, None), (3, None), (4, 4), (5, 4), (6, None)], "id long, cluster long")
    got = {r.id: r.cluster for r in clustering.without_noise(df, clusters, 1.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: None}
