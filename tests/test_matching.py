"""Alternating paths and settled links against plain walks."""

import numpy as np
import pytest

from voxloom.operators import matching

SCHEMA = "t int, c int, v1 long, v2 long, n long, total long"


def random_links(seed, n, sides):
    r = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in zip(r.integers(0, sides, n), r.integers(0, sides, n), strict=True)}
    return [(1, 0, a, b, int(r.integers(1, 4)), int(r.integers(1, 30))) for a, b in sorted(pairs)]


def walked(rows, similarity):
    """Each start's paths by walking one after the other with a set of taken components."""
    total, n = {(a, b): w for _, _, a, b, _, w in rows}, {(a, b): k for _, _, a, b, k, _ in rows}
    out = []
    for start in sorted({a for a, _ in total}):
        near = sorted((b for a, b in total if a == start), key=lambda b: (-total[start, b], -n[start, b], b))
        seen, paths = {start}, []
        for b in near:
            free = [a for a in sorted((a for a, x in total if x == b), key=lambda a: (-total[a, b], -n[a, b], a)) if a not in seen]
            far = free[0] if free else None
            seen |= {far}
            paths.append((b, far, total[start, b], total[far, b] if free else 0))
        ahead = sum(p[3] for p in paths)
        ranked = sorted(((w + ahead - x, k) for k, (_, _, w, x) in enumerate(paths)), key=lambda p: (-p[0], p[1]))
        for rank, (weight, k) in enumerate(ranked, 1):
            b, far, w, x = paths[k]
            out.append((1, 0, start, b, far, w, x, weight, rank, rank > 1 and ranked[0][0] - weight >= similarity * ranked[0][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "n", "sides"), [(1, 60, 20), (2, 200, 15), (3, 6, 3), (4, 30, 6)])
def test_paths_equal_a_walk(spark, seed, n, sides):
    rows = random_links(seed, n, sides)
    found = matching.alternating_paths(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=repr) == walked(rows, 0.2)


def settle(rows, rounds, similarity):
    link, count = {(a, b): 1 for _, _, a, b, _, _ in rows}, {(a, b): 0 for _, _, a, b, _, _ in rows}
    total = {(a, b): w for _, _, a, b, _, w in rows}
    flipped = [(t, c, b, a, n, w) for t, c, a, b, n, w in rows]
    far_off = [{(p[2], p[3]): p[9] for p in walked(rows, similarity)}, {(p[3], p[2]): p[9] for p in walked(flipped, similarity)}]
    for _ in range(rounds):
        for side in (0, 1):
            new = dict(link)
            for v in {e[side] for e in link}:
                mine = [e for e in link if e[side] == v]
                held = [e for e in mine if link[e]]
                if not held:
                    top = max(total[e] for e in mine)
                    new |= {e: 1 for e in mine if top - total[e] < similarity * top}
                elif len(held) > 1:
                    top = max(total[e] for e in held)
                    off = [e for e in held if top - total[e] >= similarity * top] or [e for e in held if far_off[side][e]]
                    if not off:
                        other = [e for e in held if any(link[x] for x in link if x[1 - side] == e[1 - side] and x != e)]
                        off = other if len(other) < len(held) else []
                    new |= {e: 0 for e in off}
            count = {e: count[e] + (new[e] != link[e]) for e in link}
            link = new
    return sorted((1, 0, *e, total[e], link[e], count[e]) for e in link)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_settle_like_plain_rounds(spark, seed):
    rows = random_links(seed, 120, 25)
    for similarity in (0.2, 0.5):
        found = matching.settled_links(spark.createDataFrame(rows, SCHEMA), 2, similarity).drop("n").collect()
        assert sorted(map(tuple, found)) == settle(rows, 2, similarity)


def test_an_empty_table_and_a_single_link(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert matching.alternating_paths(none).collect() == [] and matching.settled_links(none).collect() == []
    one = spark.createDataFrame([(0, 0, 5, 6, 2, 9)], SCHEMA)
    assert [tuple(r) for r in matching.alternating_paths(one).collect()] == [(0, 0, 5, 6, None, 9, 0, 9, 1, False)]
    cells = spark.createDataFrame([(0, 0, 5), (0, 0, 5), (9, 9, 9)], "t int, c int, label long")
    assert [tuple(r) for r in matching.path_report(matching.alternating_paths(one), cells).collect()] == [(0, 0, 5, 1, "5-6 (9)")]
