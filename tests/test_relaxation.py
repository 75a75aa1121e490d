"""Ruler relaxation against a plain loop, and a ruler that bends onto a line of samples."""

import numpy as np
import pytest

from voxloom.operators import relaxation


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n > 0 else v * 0.0


def plain(points, locked, samples, rounds, reach=10.0):
    p = np.array(points, float)
    n = len(p)
    gaps = [np.linalg.norm(p[i + 1] - p[i]) for i in range(n - 1)]
    back, ahead = [0.0, *gaps], [*gaps, 0.0]
    for _ in range(rounds):
        new = p.copy()
        for i in range(n):
            if locked[i]:
                continue
            d = samples[:, :3] - p[i]
            far = np.linalg.norm(d, axis=1)
            on = far <= reach
            w = samples[on, 3]
            f1 = (d[on] * (w / np.maximum(far[on], 1.0) ** 2)[:, None]).sum(0) / w.sum() if on.any() else np.zeros(3)
            f2, f3 = np.zeros(3), np.zeros(3)
            for j, length, other in ((i - 1, back[i], ahead[i]), (i + 1, ahead[i], back[i])):
                if length > 0:
                    f2 += unit(p[j] - p[i]) * (np.linalg.norm(p[j] - p[i]) - length) * (0.2 if other == 0 else 1.0)
            if back[i] > 0 and ahead[i] > 0:
                a, b = unit(p[i - 1] - p[i]), unit(p[i + 1] - p[i])
                f3 = unit(a + b) * (a @ b + 1)
            norm = max(0.01, (back[i] + ahead[i]) / 100)
            new[i] = p[i] + norm * (unit(f1) + 4.0 * unit(2 * f2 + 3 * f3))
        p = new
    return p


def test_relaxation(spark):
    r = np.random.default_rng(2)
    samples = np.column_stack([r.uniform(0, 40, 400), r.normal(6, 0.5, 400), r.normal(3, 0.5, 400), r.uniform(0.2, 1, 400)])
    line = [(4.0 * k + 2, 3.0 + (k % 3) * 0.7, 3.0) for k in range(10)]
    locked = [k == 0 for k in range(10)]
    rows = [(1, k, *p, bool(q)) for k, (p, q) in enumerate(zip(line, locked, strict=True))]
    # A ruler far from all samples, one of one point, and two points in one place.
    rows += [(2, 0, 500.0, 0.0, 0.0, None), (2, 1, 504.0, 0.0, 0.0, None), (3, 5, 20.0, 3.0, 3.0, False), (4, 0, 900.0, 1.0, 1.0, False), (4, 1, 900.0, 1.0, 1.0, False)]
    points = spark.createDataFrame(rows, "ruler long, n int, x double, y double, z double, locked boolean")
    cloud = spark.createDataFrame([tuple(map(float, s)) for s in samples] + [(20.0, 50.0, 3.0, 0.0)], "x double, y double, z double, w double")
    got = {}
    for q in relaxation.relaxed(points, cloud, rounds=4).orderBy("ruler", "n").collect():
        got.setdefault(q["ruler"], []).append([q["x"], q["y"], q["z"]])
    assert np.abs(np.array(got[1]) - plain(line, locked, samples, 4)).max() < 1e-9
    assert got[2] == [[500.0, 0.0, 0.0], [504.0, 0.0, 0.0]] and got[4] == [[900.0, 1.0, 1.0]] * 2
    assert np.abs(np.array(got[3]) - plain([(20.0, 3.0, 3.0)], [False], samples, 4)).max() < 1e-9
    # The reference loop shows the ruler bending onto the line at y = 6; the operator equals it round by round.
    late = plain(line, locked, samples, 120)
    assert np.abs(late[2:, 1] - 6).mean() < 0.5 * np.abs(np.array(line)[2:, 1] - 6).mean()
    assert got[1][0] == list(line[0])


def test_empty(spark):
    none = spark.createDataFrame([], "ruler long, n int, x double, y double, z double")
    cloud = spark.createDataFrame([], "x double, y double, z double, w double")
    assert relaxation.relaxed(none, cloud, rounds=1).count() == 0
