"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from voxloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, node string, dim string, unit string, row long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "n", "d", "u", 1) for i, v, k in rows], SCHEMA)


def brute(rows, least=0.93):
    """n_links and component of each row by comparing all pairs."""
    units = []
    for _, v, k in rows:
        x = None if v is None or k is None or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        units.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else x / np.linalg.norm(x))
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = {}
    for i in range(n):
        members.setdefault(find(i), []).append(rows[i][0])
    least_id = {r: min((m for m in ids if m is not None), default=None) for r, ids in members.items()}
    return sorted(((rows[i][0], links[i], least_id[find(i)], rows[i][0] == least_id[find(i)]) for i in range(n)), key=repr)


def turned(r, v, cosine):
    """A vector at the given cosine to ``v``."""
    v = v / np.linalg.norm(v)
    w = r.normal(size=len(v))
    w -= (w @ v) * v
    return (cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)) * r.uniform(0.1, 9)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    base = [r.normal(size=64) for _ in range(300)]
    made = [(v, int(r.integers(3))) for v in base]
    made += [(turned(r, base[i], c), made[i][1]) for i, c in zip(range(200), r.uniform(0.9, 0.96, 200), strict=True)]
    centre = r.normal(size=64)
    made += [(turned(r, centre, 0.98), 1) for _ in range(150)]  # a crowd, linked with each other for the most part
    made += [(base[0], made[0][1])] * 40 + [(base[1] * 2, made[1][1])] * 3  # copies, and copies of another length
    made += [(r.normal(size=5), 0), (np.ones(5), 0), (np.ones(5) * 3, 0), (np.ones(64), None), (np.ones(200), 2), (np.ones(200), 2)]
    rows = [(int(i), [float(x) for x in v], k) for i, (v, k) in zip(r.permutation(len(made)), made, strict=True)]
    odd = [None, [], [0.0] * 64, [-0.0] * 64, [None, *[1.0] * 63], [float("nan"), *[1.0] * 63], [float("inf"), *[1.0] * 63]]
    return rows + [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(None, rows[3][1], rows[3][2]), (7, rows[9][1], rows[9][2])]


@pytest.mark.parametrize(("shelf", "queries", "lists"), [(2048, 16_384, 64), (16, 40, 8)])
def test_links_and_components_equal_all_pairs(spark, rows, monkeypatch, shelf, queries, lists):
    monkeypatch.setattr(ed, "SHELF", shelf)
    monkeypatch.setattr(ed, "QUERIES", queries)
    monkeypatch.setattr(ed, "BROADCAST_ROWS", 10_000 if shelf > 16 else 0)
    found = sorted(map(tuple, ed.near_vectors(table(spark, rows), lists=lists).collect()), key=repr)
    expected = brute(rows)
    assert found == expected
    assert sum(r[1] for r in expected) > 10_000


def test_few_or_no_vectors(spark):
    assert ed.near_vectors(table(spark, []).limit(0)).collect() == []
    few = [(3, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (1, [1.0, 0.1], 2), (0, None, 1)]
    assert sorted(map(tuple, ed.near_vectors(table(spark, few)).collect())) == brute(few)


def test_probes_meet_from_one_side_at_least():
    """Of every close pair in different lists one end probes the other's list."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(32, 6))
    p = r.normal(size=(4000, 6))
    step = r.normal(size=p.shape)
    q = p + 0.4 * step / np.linalg.norm(step, axis=1)[:, None] * r.uniform(0, 1, (len(p), 1))
    (hp, np_), (hq, nq) = ed.probed(p, centres, 0.2), ed.probed(q, centres, 0.2)
    i = np.arange(len(p))
    assert (hp != hq).sum() > 300
    assert ((hp == hq) | np_[i, hq] | nq[i, hp]).all()


def test_merge_finds_components():
    r = np.random.default_rng(1)
    root = np.arange(500)
    a, b = r.integers(0, 500, 300), r.integers(0, 500, 300)
    for k in range(0, 300, 50):
        ed.merge(root, a[k : k + 50], b[k : k + 50])
    plain = list(range(500))

    def find(i):
        return i if plain[i] == i else find(plain[i])

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        plain[max(x, y)] = min(x, y)
    assert root.tolist() == [find(i) for i in range(500)]
