"""Windows of gait whose correlations tie, and window scores against a plain loop."""

import numpy as np

from voxloom.operators import timeseries

CYCLE = [[1.0, 3.0, 2.0, -1.0, -2.0, 0.0, 1.0], [0.0, 1.0, 1.0, 0.0, -1.0, -1.0, 0.0]]
#: The best correlation is met by two widths, which sums of floating point put apart: the shorter width, its thirds.
TIES = [([[0, 4, 5, 3, 8, 3, 9, 11, 8, 5], [9, 9, 6, 1, 1, 5, 0, 5, 0, 7]], 5, 77), ([[3, 0, 10, 8, 7, 2, 10, 7, 3, 3], [3, 7, 1, 11, 4, 2, 7, 5, 2, 9]], 8, 61), ([[1, 8, 2, 2, 7, 5, 5, 8, 8, 1], [7, 7, 3, 8, 9, 0, 2, 2, 9, 1]], 4, 87)]


def test_of_windows_that_tie_the_shortest_counts():
    for data, width, thirds in TIES:
        assert timeseries._windows(10, np.array(CYCLE), np.array(data, float), 1)[0] == (0, width, round(thirds / 3, 9))


def test_window_scores_match_a_plain_loop_and_carry_no_whole_series(spark):
    r = np.random.default_rng(4)
    walks = {"a": [r.integers(0, 9, 23), r.integers(0, 9, 23)], "b": [r.integers(0, 9, 4), r.integers(0, 9, 3)], "c": [r.integers(0, 9, 2)] * 2}
    rows = [(k, d, f, float(v)) for k, dims in walks.items() for d, vs in enumerate(dims) for f, v in enumerate(vs)]
    df = timeseries.window_scores(spark.createDataFrame(rows, "series string, dim int, frame int, value double"), CYCLE)
    want = {}
    for k, dims in walks.items():
        for d, vs in enumerate(dims):
            for s in range(len(vs)):
                for w in range(3, min(10, len(vs) - s) + 1):
                    want[k, s, w] = want.get((k, s, w), 0.0) + float((timeseries.resampled(vs[s : s + w].astype(float), 7) * CYCLE[d]).sum())
    got = {(q.series, q.start, q.width): q.corr for q in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # No sum is keyed by the width, so as many keys are held as there are starts.
    keys = df._jdf.queryExecution().executedPlan().toString().split("keys=[")[1:]
    assert keys and all("width" not in k.split("]")[0] for k in keys)
