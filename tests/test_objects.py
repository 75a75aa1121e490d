"""Meshes, selections, growth, rulers, gait and clusters against brute force and analytic shapes."""

from collections import Counter
from math import pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import clustering, mesh, rulers, segmentation, selection, timeseries, tracking
from voxloom.sources import export

VOX = "t int, c int, z int, y int, x int, v int, mask int, label long"


def volume(spark, a, level=100):
    return spark.createDataFrame([(0, 0, *map(int, k), int(a[k]), 255, int(a[k] >= level)) for k in np.ndindex(a.shape)], VOX)


def ball(n, r):
    c = (n - 1) / 2
    d = np.sqrt(sum((q - c) ** 2 for q in np.mgrid[:n, :n, :n]))
    return np.clip(128 - 40 * (d - r), 0, 255)


def runs(on):
    """Brute-force components over 26 neighbours."""
    left, out = set(map(tuple, np.argwhere(on))), []
    while left:
        stack, run = [left.pop()], set()
        while stack:
            p = stack.pop()
            run.add(p)
            near = {tuple(np.add(p, d)) for d in np.ndindex(3, 3, 3) for d in [np.subtract(d, 1)]} & left
            left -= near
            stack += near
        out.append(run)
    return out


@pytest.mark.parametrize("case", range(256))
def test_cell_surface_separates_corners(case):
    edges = [p for t in mesh.cell_triangles(case) for p in t]
    assert all((case >> a & 1) != (case >> b & 1) for a, b in edges)
    crossing = {(a, b) for a in range(8) for b in range(8) if a < b and (a ^ b) in (1, 2, 4) and (case >> a & 1) != (case >> b & 1)}
    assert set(edges) == crossing


def test_sphere_is_closed_and_has_its_volume(spark):
    n, r = 17, 5.6
    tri = mesh.surface(volume(spark, ball(n, r)), 128).cache()
    m = mesh.measures(tri, ["t", "c"]).first()
    assert abs(m.volume / (4 / 3 * pi * r**3) - 1) < 0.05
    assert abs(m.area / (4 * pi * r**2) - 1) < 0.05
    sides = Counter()
    for row in tri.collect():
        p = [tuple(round(row[f"{k}{i}"], 6) for k in "xyz") for i in range(3)]
        for i in range(3):
            sides[p[i], p[(i + 1) % 3]] += 1
    assert all(k == 1 and sides[b, a] == 1 for (a, b), k in sides.items() if a != b)


def test_random_volume_is_closed(spark):
    a = np.random.default_rng(3).integers(0, 256, (5, 5, 5))
    a[[0, -1]] = a[:, [0, -1]] = a[:, :, [0, -1]] = 0
    sides = Counter()
    for row in mesh.surface(volume(spark, a), 127.5).collect():
        p = [tuple(round(row[f"{k}{i}"], 6) for k in "xyz") for i in range(3)]
        for i in range(3):
            sides[p[i], p[(i + 1) % 3]] += 1
    assert sides and all(sides[b, a] == k for (a, b), k in sides.items())


def test_weld_smooth_and_simplify(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 0.0, 0.0), (4, 1.0, 0.0005, 0.0), (5, 0.0, 0.0, 1.0)], "id long, x double, y double, z double")
    assert {r.id: r["first"] for r in mesh.welded(points, 1e-3).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1, 5: 5}
    tri = spark.createDataFrame([(0, 1, 2), (0, 1, 5)], "a long, b long, c long")
    moved = {r.id: (r.x, r.y, r.z) for r in mesh.smoothed(points, tri, 0.5, 10.0).collect()}
    assert np.allclose(moved[0], (1 / 6, 1 / 6, 1 / 6)) and moved[4] == (1.0, 0.0005, 0.0)
    capped = {r.id: (r.x, r.y, r.z) for r in mesh.smoothed(points, tri, 0.5, 0.01).collect()}
    assert np.isclose(np.linalg.norm(capped[0]), 0.01)
    assert mesh.simplified(points, tri, 0.0)[1].count() == 2
    flat = spark.createDataFrame([(1, 3, 2)], "a long, b long, c long")
    assert mesh.simplified(points, flat, 0.0)[1].count() == 0


def test_noise_and_diffusion_match_brute_force(spark):
    a = np.random.default_rng(5).integers(0, 256, (4, 6, 7))
    a[a < 150] = 50
    v = volume(spark, a)
    found = runs(a > 170)
    small = set().union(*[r for r in found if len(r) < 3], set())
    want = {k for k in np.ndindex(a.shape) if k not in small}
    assert {(r.z, r.y, r.x) for r in selection.without_noise(v, 170, 3).collect()} == want
    seeded = set().union(*[r for r in found if any(a[p] >= 240 for p in r)], set())
    assert {(r.z, r.y, r.x) for r in segmentation.diffused(v, 240, 170).collect()} == seeded


def test_replay_keeps_fixed_components(spark):
    a = np.zeros((1, 3, 12), int)
    a[0, 1, :5], a[0, 1, 5], a[0, 1, 6:8] = 250, 160, 250
    got = segmentation.replay(volume(spark, a), [{"type": "generate", "thresh": "0.9"}, {"type": "fixate", "size": "4"}, {"type": "generate", "thresh": "0.5"}])
    labels = {r.x: r.label for r in got.where("y = 1").collect()}
    assert len({labels[x] for x in range(5)}) == 1
    assert labels[5] == labels[6] == labels[7] != labels[0] and labels[9] == 0
    with pytest.raises(ValueError):
        segmentation.replay(volume(spark, a), [{"type": "other"}])


def test_projection_and_frame(spark):
    line = [(0.0, 0.0, 0.0), (10.0, 0.0, 0.0), (10.0, 10.0, 0.0)]
    rows = spark.createDataFrame([(4.0, 3.0, 0.0), (12.0, 6.0, 0.0)], "x double, y double, z double")
    assert [(round(r.along, 6), round(r.across, 6), r.segment) for r in rulers.projected(rows, line).collect()] == [(4.0, 3.0, 0), (16.0, 2.0, 1)]
    m = rulers.frame_of((1, 2, 3), (1, 2, 8), 10.0)
    assert np.allclose(m[:, :3].T @ m[:, :3], np.eye(3) * 4) or np.linalg.matrix_rank(m[:, :3]) < 3
    with pytest.raises(ValueError):
        rulers.frame_of((1, 2, 3), (1, 2, 3), 1.0)


def test_gait_finds_a_repeated_cycle(spark):
    wave = np.sin(np.arange(8) * 2 * pi / 8) + 0.1
    rows = [("s", d, f, float(wave[f % 8] * (d + 1))) for d in (0, 1) for f in range(40)]
    walk = spark.createDataFrame(rows, "series string, dim int, frame int, value double")
    cycle = [list(map(float, wave)), list(map(float, 2 * wave))]
    got = timeseries.gait_cycle(walk, cycle, 0, 5.0).toPandas().pivot(index="dim", columns="phase", values="value").to_numpy()
    assert np.corrcoef(got[0], wave)[0, 1] > 0.9 and np.allclose(got[1], 2 * got[0])
    assert timeseries.gait_variance(walk, cycle, 0).first().cycles >= 3
    assert timeseries.gait_aligned(walk, cycle, 0).groupBy("dim").count().select("count").distinct().count() == 1
    assert timeseries.gait_compared(walk, cycle, 0).where("score <= 0").count() == 0


def test_valley():
    assert tracking.valley([9, 20, 5, 2, 8, 15, 3]) == 3
    assert tracking.valley([20, 9, 5, 2, 1]) == 0
    assert tracking.valley([20, 12, 11, 13, 1]) == 0
    assert tracking.valley([]) == 0


def test_noise_points_join_the_commonest_cluster(spark):
    points = spark.createDataFrame([(i, float(x), 0.0, 0.0) for i, x in enumerate((0, 1, 2, 3, 10, 11))], "id long, x double, y double, z double")
    named = spark.createDataFrame([(0, 0), (1, 0), (2, None), (3, None), (4, 4), (5, 4)], "id long, cluster long")
    assert {r.id: r.cluster for r in clustering.without_noise(points, named).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}
    one = named.withColumn("cluster", F.when(F.col("id") < 2, 0).cast("long"))
    assert {r.id: r.cluster for r in clustering.without_noise(points, one).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


def test_report_fills_the_template(spark):
    rows = spark.createDataFrame([("7", 1, 2.5), ("7", 0, 1.5)], "obj string, t int, value double")
    page = export.report(rows, "<a>\n#begin data old #end\n</a>")
    assert page == "<a>\n#begin data\nID-7,0,1.5\\n\\\nID-7,1,2.5\\n\\\n#end\n</a>"
