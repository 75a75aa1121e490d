"""Two planted cameras: their pose, the points they saw, and parallels put right."""

import numpy as np
import pytest

from voxloom.operators import stereo

VIEW = "ruler long, n int, t int, x double, y double"


def camera(angles, move):
    a, b, c = angles
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]]) @ np.array([[1, 0, 0], [0, np.cos(c), -np.sin(c)], [0, np.sin(c), np.cos(c)]])
    return np.column_stack([r, np.array(move) / np.linalg.norm(move)])


def view(spark, p, points):
    rows = []
    for key, at in points.items():
        x, y, w = p @ np.append(at, 1.0)
        rows.append((*key, float(x / w), float(y / w)))
    return spark.createDataFrame(rows, VIEW)


@pytest.mark.parametrize("move", [(1.0, 0.2, 0.1), (-0.3, 0.1, 0.9)])
def test_planted_points_come_back(spark, move):
    r = np.random.default_rng(4)
    points = {(k, n, t): r.uniform((-3, -3, 4), (3, 3, 9)) for k in range(6) for n in range(3) for t in range(4)}
    second = camera((0.1, -0.2, 0.05), move)
    left, right = view(spark, stereo.FIRST, points), view(spark, second, points)
    extra = spark.createDataFrame([(99, 0, 0, 1.0, 1.0), (0, 9, 9, None, 2.0)], VIEW)
    pairs = stereo.paired(left.unionByName(extra), right.unionByName(extra.where("ruler = 0")))
    found = stereo.second_camera(pairs)
    assert np.abs(found - second).max() < 1e-8
    got = {tuple(q[:3]): np.array(q[3:]) for q in stereo.triangulated(pairs, stereo.FIRST, found).collect()}
    assert set(got) == set(points)
    assert max(np.abs(got[k] - points[k]).max() for k in points) < 1e-6


def test_too_few_points(spark):
    empty = spark.createDataFrame([], VIEW)
    with pytest.raises(ValueError, match="0 common points"):
        stereo.second_camera(stereo.paired(empty, empty))
    assert stereo.triangulated(stereo.paired(empty, empty), stereo.FIRST, camera((0, 0, 0), (1, 0, 0))).count() == 0


def test_image_places(spark):
    got = stereo.in_camera(spark.createDataFrame([(1, 0, 0, 640.0, 240.0)], VIEW), (320, 240), 800).first()
    assert (got["x"], got["y"]) == (0.4, 0.0)


def test_parallels_are_put_right(spark):
    r = np.random.default_rng(8)
    lines = {}
    for k, d in enumerate(np.eye(3)):
        for side in (0, 1):
            start = r.uniform((-2, -2, 5), (2, 2, 8))
            for n in (0, 1):
                lines[2 * k + side, n, 0] = start + n * (d + np.array([0.1, 0.2, 0.3]))
    first, second = stereo.FIRST, camera((0.1, -0.2, 0.05), (1.0, 0.2, 0.1))
    left, right = view(spark, first, lines), view(spark, second, lines)
    # Cameras known only up to a projection of space: parallels come out bent.
    bend = np.eye(4)
    bend[3] = [0.02, -0.03, 0.04, 1.0]
    off = [p @ np.linalg.inv(bend) for p in (first, second)]
    bent = stereo.triangulated(stereo.paired(left, right), *off)
    plane = stereo.affine_plane(left, right, list(range(6)), *off)

    def angles(df):
        at = {(q["ruler"], q["n"]): np.array([q["x"], q["y"], q["z"]]) for q in df.collect()}
        d = [(at[k, 1] - at[k, 0]) / np.linalg.norm(at[k, 1] - at[k, 0]) for k in range(6)]
        return [1 - abs(d[i] @ d[i + 1]) for i in (0, 2, 4)]

    assert max(angles(bent)) > 1e-4
    assert max(angles(stereo.rectified(bent, plane))) < 1e-9
    with pytest.raises(ValueError, match="missing"):
        stereo.affine_plane(left, right, [0, 1, 2, 3, 4, 77], *off)
