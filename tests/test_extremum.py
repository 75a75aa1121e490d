"""Floods from local extrema against a plain walk."""

from itertools import product

import numpy as np
import pytest

from voxloom.operators import extremum


def plain(rows):
    """Each component's flood by a list of open samples."""
    held = {}
    for t, c, z, y, x, v, label in rows:
        if label and v > 0 and v >= held.get((t, c, z, y, x), (0, 0))[0]:
            held[t, c, z, y, x] = (v, label)
    out = set()
    for key in {(t, c, label) for (t, c, *_), (_, label) in held.items()}:
        mine = {p[2:]: v for p, (v, label) in held.items() if (*p[:2], label) == key}
        span = max(mine.values()) - min(mine.values())
        start = min(mine, key=lambda p: (-mine[p], p))
        seen, front = {start}, [start]
        while front:
            p = front.pop()
            for d in product((-1, 0, 1), repeat=3):
                q = tuple(a + b for a, b in zip(p, d, strict=True))
                if q in mine and q not in seen and 100 * (mine[q] - mine[p]) < span:
                    seen.add(q)
                    front.append(q)
        out |= {(*key, *p, mine[p]) for p in seen}
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    made = []
    for z, y, x in product(range(4), range(30), range(30)):
        if r.random() < 0.7:
            v = int(250 - 7 * abs(x - 14) - 5 * abs(y - 12) + r.integers(-6, 7))
            made.append((0, 0, z, y, x, max(1, v), 1 + (y > 20)))
    return made + [(1, 0, 0, 0, k, 9, 5) for k in range(40)] + [(1, 0, 3, 3, 3, 50, 0), (1, 1, 0, 0, 0, 7, 2)]


@pytest.mark.parametrize("brick", [32, 5])
def test_floods_equal_a_walk(spark, rows, brick):
    vox = spark.createDataFrame(rows, "t int, c int, z int, y int, x int, v int, label long")
    found = extremum.floods(vox, brick)
    assert {tuple(r) for r in found.select("t", "c", "label", "z", "y", "x", "v").collect()} == plain(rows)
    assert found.count() == len(plain(rows))


def test_moments_of_a_flood(spark):
    line = [(0, 0, 0, 0, x, v, 3) for x, v in enumerate([10, 40, 100, 40, 10, 90, 95])]
    vox = spark.createDataFrame([*line, (0, 0, 9, 9, 9, 4, 8)], "t int, c int, z int, y int, x int, v int, label long")
    a, b = extremum.local_extrema(vox).orderBy("label").collect()
    # The second hump rises by more than the tolerance and stays dry.
    assert (a["peak"], a["px"], a["n"], a["low"], a["mx"], a["my"]) == (100, 2, 5, 10, pytest.approx(2.0), pytest.approx(0.0))
    assert a["vx"] == pytest.approx((30 + 30) / 150)
    assert (b["peak"], b["n"], b["mx"]) == (4, 1, None)
    assert extremum.local_extrema(vox.limit(0)).collect() == []
