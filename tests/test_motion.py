"""Planted turns, shifts and moving masks."""

import numpy as np
import pytest

from voxloom.operators import rigid
from voxloom.operators.resample import turned

DIMS = (3, 40, 40)


def blobs(seed, n=40):
    r = np.random.default_rng(seed)
    held = {}
    for z, y, x in zip(r.integers(0, 3, n), r.integers(8, 32, n), r.integers(8, 32, n), strict=True):
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                held[int(z), int(y + dy), int(x + dx)] = int(200 - 30 * (abs(dy) + abs(dx)))
    return held


def table(spark, frames):
    rows = [(t, 0, *p, v, (labels or {}).get(p, 0)) for t, (held, labels) in enumerate(frames) for p, v in held.items()]
    return spark.createDataFrame(rows, "t int, c int, z int, y int, x int, v int, label long")


@pytest.mark.parametrize(("angle", "shift"), [(10.0, (0, 3, -2)), (-7.5, (0, -4, 1))])
def test_a_planted_turn_and_shift_is_found(spark, angle, shift):
    one = table(spark, [(blobs(1), None)])
    # What frame 1 holds at p lies in frame 0 at the inverse turn of p less the shift.
    back = rigid.rotation((-angle, 0.0, 0.0))
    offset = [-sum(back[i][k] * shift[k] for k in range(3)) for i in range(3)]
    nxt = turned(one, DIMS, back, tuple(offset)).selectExpr("1 AS t", "c", "z", "y", "x", "v", "0L AS label")
    found = rigid.register_rigid(one.unionByName(nxt), DIMS, reach=10.0).collect()
    assert len(found) == 1 and found[0]["settled"]
    r = found[0]
    assert abs(r["az"] - angle) <= 1.25 and all(abs(r[f"d{k}"] - s) <= 1 for k, s in zip("zyx", shift, strict=True))


def test_scores_equal_loops(spark):
    held, other = blobs(2, 12), blobs(3, 12)
    vox = table(spark, [(held, None), (other, None)])
    turns = [(0.0, 0.0, 0.0), (30.0, 10.0, -20.0)]
    moves = [(0, 0, m, dz, dy, 1) for m in (0, 1) for dz in (-1, 0) for dy in (-2, 40)]
    found = rigid.rigid_scores(vox, DIMS, turns, spark.createDataFrame(moves, "t int, c int, move int, dz int, dy int, dx int")).collect()
    for r in found:
        m, total = np.array(rigid.rotation(turns[r["move"]])), 0
        for p, v in held.items():
            at = m @ (np.array(p) + 0.5 - np.array(DIMS) / 2) + np.array(DIMS) / 2 + [r["dz"], r["dy"], r["dx"]]
            total += v * other.get(tuple(int(k) for k in np.floor(at + 1e-9)), 0)
        assert r["total"] == total
    assert len(found) == 8


def test_rotations_keep_lengths():
    m = np.array(rigid.rotation((20.0, -35.0, 70.0)))
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)


def test_masks_follow_a_planted_motion(spark):
    r = np.random.default_rng(6)
    stamps = {1: ((1, 10, 10), (1, -2)), 2: ((0, 25, 20), (-1, 2)), 3: ((2, 12, 30), (0, 0))}
    looks = {k: r.integers(60, 250, (4, 4)) for k in stamps}
    frames = []
    for t in range(5):
        held, labels = {}, {}
        for k, ((z, y, x), (my, mx)) in stamps.items():
            for i in range(4):
                for j in range(4):
                    p = (z, y + my * t + i, x + mx * t + j)
                    held[p] = int(looks[k][i, j])
                    if t == 0:
                        labels[p] = k
        frames.append((held, labels))
    vox = table(spark, frames)
    for follow in (True, False):
        found = rigid.track_stencils(vox, 0, 4, follow=follow).collect()
        assert len(found) == 5 * 3 * 16
        for row in found:
            assert row["t"] == 0 or (row["dz"], row["dy"], row["dx"]) == (0, *stamps[row["label"]][1])
        for t in range(5):
            for k, ((z, y, x), (my, mx)) in stamps.items():
                mine = {(q["z"], q["y"], q["x"]) for q in found if q["t"] == t and q["label"] == k}
                assert mine == {(z, y + my * t + i, x + mx * t + j) for i in range(4) for j in range(4)}


def test_masks_over_nothing_stay(spark):
    vox = table(spark, [({(0, 5, 5): 9}, {(0, 5, 5): 4}), ({(2, 30, 30): 7}, None)])
    found = [tuple(r) for r in rigid.track_stencils(vox, 0, 1).orderBy("t").collect()]
    assert found == [(0, 0, 4, 0, 5, 5, 0, 0, 0, 0), (1, 0, 4, 0, 5, 5, 0, 0, 0, 0)]
