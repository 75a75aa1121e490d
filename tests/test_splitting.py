"""Component splits, merges and local fits against plain loops."""

import numpy as np
import pytest

from voxloom.operators import splitting

SCHEMA = "t int, c int, z int, y int, x int, v int, mask int, label long"


def blob(r, at, n, label, t=0, spread=2.0):
    rows = {}
    for p in np.rint(r.normal(at, spread, (n, 3))).astype(int):
        rows[tuple(p)] = (t, 0, *(int(q) for q in p), int(r.integers(100, 255)), 0, label)
    return list(rows.values())


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(11)
    two = blob(r, (20, 20, 20), 200, 1) + blob(r, (20, 20, 45), 150, 1)
    three = blob(r, (60, 20, 20), 120, 2) + blob(r, (60, 50, 20), 120, 2) + blob(r, (60, 35, 50), 120, 2)
    single = blob(r, (100, 20, 20), 200, 3, spread=4.0)
    return two + three + single + [(1, 0, 5, 5, x, 100 + x, 0, 7) for x in range(10)] + [(1, 0, 9, 9, 9, 50, 0, 8)]


def density(p, m, s):
    s = s + np.eye(3) * (0.0 if np.linalg.det(s) > 1e-9 else 0.5)
    d = p - m
    return np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d)) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(s))


def plain_mixture(p, w, k):
    order = np.lexsort((np.arange(len(p)), -w))
    centres = [p[order[0]]]
    while len(centres) < k:
        centres.append(p[np.argmax(((p - centres[-1]) ** 2).sum(1))])
    centres = np.array(centres, float)
    for _ in range(100):
        name = ((p[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([np.average(p[name == j], axis=0, weights=w[name == j]) if (name == j).any() else centres[j] for j in range(k)])
        moved, centres = np.abs(new - centres).max(), new
        if moved <= 1e-6:
            break
    name = ((p[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    parts = []
    for j in range(k):
        m = np.average(p[name == j], axis=0, weights=w[name == j])
        parts.append((1 / k, m, np.diag(np.average((p[name == j] - m) ** 2, axis=0, weights=w[name == j]))))
    last = None
    for _ in range(100):
        d = np.array([tau * density(p, m, s) for tau, m, s in parts]).T
        s = d.sum(1)
        share = np.where(s[:, None] > 0, d / np.where(s > 0, s, 1)[:, None], 1.0)
        fit = (w * np.log(np.maximum(s, 1e-300))).sum()
        parts = []
        for j in range(k):
            g = share[:, j] * w
            m = (p * g[:, None]).sum(0) / g.sum()
            parts.append((g.sum() / w.sum(), m, ((p - m).T * g) @ (p - m) / g.sum()))
        if last is not None and abs(fit - last) <= 1e-6 * abs(fit):
            break
        last = fit
    d = np.array([tau * density(p, m, s) for tau, m, s in parts]).T
    return (d / d.sum(1, keepdims=True)), parts


def of(rows, t, label):
    mine = sorted((r for r in rows if r[0] == t and r[7] == label), key=lambda r: r[2:5])
    return np.array([r[4:1:-1] for r in mine], float), np.array([r[5] for r in mine]) / 255.0


def test_splits_equal_a_loop(spark, rows):
    vox = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame([(0, 0, 1, 2), (0, 0, 1, 2), (0, 0, 2, 3), (1, 0, 8, 2), (1, 0, 7, 1), (9, 9, 9, 2), (0, 0, 3, None), (0, 0, 3, 1)], "t int, c int, label long, k int")
    found = splitting.split_samples(vox, wanted).collect()
    by = {}
    for r in found:
        by.setdefault(r["label"], []).append(r)
    for label, k in ((1, 2), (2, 3)):
        share, _ = plain_mixture(*of(rows, 0, label), k)
        mine = sorted(by[label], key=lambda r: r["id"])
        assert [r["cluster"] for r in mine] == share.argmax(1).tolist()
        assert mine[0]["quality"] == pytest.approx(share.max(1).mean(), abs=1e-6)
    # One sample has no two parts; unknown components and those without a k of two or more are left out.
    assert set(by) == {1, 2}


def test_split_components_take_free_labels(spark, rows):
    vox = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame([(0, 0, 1, 2), (0, 0, 2, 3)], "t int, c int, label long, k int")
    out = splitting.split_components(vox, wanted)
    assert out.columns == vox.columns
    got = {tuple(r[:6]): r["label"] for r in out.collect()}
    assert len(got) == len({r[:6] for r in rows})
    assert {v for k, v in got.items() if k[0] == 1} == {7, 8}
    # The planted halves of component 1 lie on either side of x = 33; its labels are 1 + 3 and 1 + 6.
    halves = {(k[4] > 33): set() for k in got}
    for r in rows:
        if r[7] == 1:
            halves[r[4] > 33].add(got[r[:6]])
    assert halves[False] | halves[True] == {4, 7}
    assert len(halves[False]) == len(halves[True]) == 1
    assert {got[r[:6]] for r in rows if r[7] == 2} == {5, 8, 11}


def test_nothing_to_split(spark, rows):
    vox = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "t int, c int, label long, k int")
    assert splitting.split_samples(vox, none).count() == 0
    assert sorted(splitting.split_components(vox, none).collect()) == sorted(vox.collect())


def test_local_centres_equal_a_loop(spark, rows):
    vox = spark.createDataFrame(rows, SCHEMA)
    found = {(r["t"], r["label"]): r for r in splitting.local_centres(splitting.component_points(vox)).collect()}
    assert len(found) == 5
    for (t, label), r in found.items():
        p, w = of(rows, t, label)
        first = m = np.average(p, axis=0, weights=w)
        s = np.diag(np.average((p - m) ** 2, axis=0, weights=w))
        last, risen, shift = 0.0, 0, 0.0
        for _ in range(30):
            g = density(p, m, s) * w * w
            new = (p * g[:, None]).sum(0) / g.sum()
            s = ((p - new).T * g) @ (p - new) / g.sum()
            shift, m = float(np.linalg.norm(new - m)), new
            risen += shift >= last
            if shift <= 1e-3 or risen > 3:
                break
            last = shift
        want = m if shift < 0.5 else first
        assert [r["x"], r["y"], r["z"]] == pytest.approx(want.tolist(), abs=1e-5)
        assert [r["mx"], r["my"], r["mz"]] == pytest.approx(first.tolist())


def test_forks_and_merges(spark):
    links = spark.createDataFrame([(0, 0, 1, 5, 1), (0, 0, 2, 5, 1), (0, 0, 2, 6, 0), (0, 0, 3, 7, 1), (0, 0, 3, 8, 1), (0, 0, 4, 9, 1), (0, 0, 4, 10, 1)], "t int, c int, v1 long, v2 long, link int")
    assert sorted(map(tuple, splitting.forked(links).collect())) == [(0, 0, 3, 2), (0, 0, 4, 2), (1, 0, 5, 2)]
    assert sorted(map(tuple, splitting.far_ends(links, back=True).collect())) == [(0, 0, 5, 1), (0, 0, 5, 2)]
    sets = splitting.far_ends(links)
    assert sorted(map(tuple, sets.collect())) == [(1, 0, 3, 7), (1, 0, 3, 8), (1, 0, 4, 9), (1, 0, 4, 10)]
    block = lambda x0, label: [(1, 0, z, y, x0 + x, 200, 0, label) for z in range(3) for y in range(3) for x in range(3)]
    vox = spark.createDataFrame(block(0, 7) + block(3, 8) + block(20, 9) + block(40, 10) + [(1, 0, 60, 60, 60, 9, 0, 11)], SCHEMA)
    more = sets.unionByName(spark.createDataFrame([(1, 0, 5, 11), (1, 0, 5, 11)], "t int, c int, set long, label long"))
    found = {r["set"]: (r["clusters"], r["merge"]) for r in splitting.merge_verdicts(vox, more).collect()}
    assert found == {3: (1, True), 4: (2, False), 5: (0, False)}
