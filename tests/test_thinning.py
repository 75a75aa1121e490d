"""Template thinning against a loop over samples, with the templates written out."""

from itertools import product

import numpy as np
import pytest

from voxloom.operators import stencil, thinning

DIMS = (6, 9, 11)
# Numbers of neighbours (9 z + 3 y + x) that must be on and off, of some templates of each kind.
WRITTEN = [
    ([14], [0, 3, 6, 9, 12, 15, 18, 21, 24]),
    ([4], [18, 19, 20, 21, 22, 23, 24, 25, 26]),
    ([14, 22], [0, 1, 3, 4, 6, 7, 9, 12, 15]),
    ([4, 10, 14], [12, 15, 16, 21, 22, 24, 25]),
    ([5, 10, 16], [3, 4, 12, 14, 21, 22, 23]),
    ([17], [0, 1, 2, 3, 6, 9, 10, 11, 12, 14, 15, 16, 18, 19, 20, 21, 24]),
]


def test_templates_have_the_written_neighbours():
    near = thinning.mask(thinning.NEAR)
    made = {(on & near, off) for on, off, _ in thinning.templates()}
    assert len(thinning.templates()) == 6 + 12 + 8 + 12
    for on, off in WRITTEN:
        assert (sum(1 << k for k in on), sum(1 << k for k in off)) in made


def plain(held, level):
    """One pass by a dictionary of samples; the grid's faces repeat outward."""
    def on(p):
        return held.get(tuple(min(max(k, 0), n - 1) for k, n in zip(p, DIMS, strict=True)), 0) >= level

    left = {}
    for p, v in held.items():
        if v < level:
            continue
        at = {d: on(thinning.plus(p, d)) for d in thinning.BITS}
        count = sum(at[d] for d in thinning.NEAR)
        stays = count == 2 or (count == 3 and any(at[a] and at[b] for a, b in thinning.CORNERS))
        gone = False
        for on_, off, some in thinning.templates():
            needs = [d for d, b in thinning.BITS.items() if on_ >> b & 1]
            bars = [d for d, b in thinning.BITS.items() if off >> b & 1]
            may = [d for d, b in thinning.BITS.items() if some >> b & 1]
            gone |= all(at[d] for d in needs) and not any(at[d] for d in bars) and (not may or any(at[d] for d in may))
        if stays or not gone:
            left[p] = v
    return left


def volume(seed, share):
    r = np.random.default_rng(seed)
    return {p: int(r.integers(1, 256)) for p in product(*map(range, DIMS)) if r.random() < share}


@pytest.mark.parametrize(("seed", "share"), [(1, 0.25), (2, 0.6), (3, 0.9)])
def test_a_pass_equals_a_loop(spark, seed, share, monkeypatch):
    monkeypatch.setattr(stencil, "BRICK", (4, 4, 5))
    held = volume(seed, share)
    vox = spark.createDataFrame([(0, 0, *p, v) for p, v in held.items()], "t int, c int, z int, y int, x int, v int")
    found = stencil.apply(vox, DIMS, 2, thinning.thin_once(0.1)).collect()
    assert {(r["z"], r["y"], r["x"]): r["v"] for r in found} == plain(held, 26)


def test_a_bar_thins_to_a_line_in_one_piece(spark):
    bar = [(0, 0, z, y, x, 200) for z in range(1, 5) for y in range(2, 6) for x in range(1, 10)]
    vox = spark.createDataFrame(bar, "t int, c int, z int, y int, x int, v int")
    left = {(r["z"], r["y"], r["x"]) for r in thinning.skeleton(vox, DIMS).collect()}
    assert 0 < len(left) < len(bar) / 4
    start = next(iter(left))
    seen, front = {start}, [start]
    while front:
        p = front.pop()
        for d in thinning.NEAR:
            q = thinning.plus(p, d)
            if q in left and q not in seen:
                seen.add(q)
                front.append(q)
    assert seen == left
