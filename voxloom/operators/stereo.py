"""Points in space from two cameras' views of the same rulers.

A view (ruler, n, t, x, y) holds points in the camera's own units: image
places less the principal point, over the focal length (``in_camera``).
Cameras are three rows of four numbers.  Points of both views meet by ruler,
number and time; calibration takes one row of sums from them, whatever their number.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["ruler", "n", "t"]
#: The camera that looks along z from the origin.
FIRST = np.eye(3, 4)


def in_camera(points: DataFrame, centre: tuple[float, float], focal: float) -> DataFrame:
    """A view from image places: less the principal point, over the focal length."""
    return points.select(*KEY, *[((F.col(k) - float(c)) / float(focal)).alias(k) for k, c in zip("xy", centre, strict=True)])


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """ruler, n, t, x1, y1, x2, y2: points that both views hold; null and non-finite places are left out."""
    both = left.select(*KEY, F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1")).join(right.select(*KEY, F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2")).hint("merge"), KEY)
    held = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.abs(k) < float("inf")) for k in ("x1", "y1", "x2", "y2")])
    return both.where(held)


def _spread(pairs: DataFrame) -> list[np.ndarray]:
    """For each view the matrix that moves its mean to the origin and its mean square distance to two."""
    names = ("x1", "y1", "x2", "y2")
    r = pairs.agg(F.count("*").alias("n"), *[F.avg(k).alias(k) for k in names], *[F.var_pop(k).alias(f"v{k}") for k in names]).first()
    if r["n"] < 8:
        raise ValueError(f"{r['n']} common points are too few: a calibration takes eight")
    out = []
    for k in "12":
        s = np.sqrt(2.0 / (r[f"vx{k}"] + r[f"vy{k}"]))
        out.append(np.array([[s, 0, -s * r[f"x{k}"]], [0, s, -s * r[f"y{k}"]], [0, 0, 1.0]]))
    return out


def essential(pairs: DataFrame) -> np.ndarray:
    """The matrix E of least squares with (x2, y2, 1) E (x1, y1, 1) = 0, its singular values made 1, 1 and 0.

    Two aggregations: means and spreads, then the 45 sums of the normal equations.
    """
    one, two = _spread(pairs)
    p = [F.col("x1") * float(one[0, 0]) + float(one[0, 2]), F.col("y1") * float(one[1, 1]) + float(one[1, 2]), F.lit(1.0)]
    q = [F.col("x2") * float(two[0, 0]) + float(two[0, 2]), F.col("y2") * float(two[1, 1]) + float(two[1, 2]), F.lit(1.0)]
    rows = pairs.select(*[(b * a).alias(f"k{3 * i + j}") for i, b in enumerate(q) for j, a in enumerate(p)])
    sums = rows.agg(*[F.sum(F.col(f"k{i}") * F.col(f"k{j}")).alias(f"s{i}_{j}") for i in range(9) for j in range(i, 9)]).first()
    normal = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(9)] for i in range(9)])
    least = np.linalg.eigh(normal)[1][:, 0].reshape(3, 3)
    u, _, v = np.linalg.svd(two.T @ least @ one)
    return u @ np.diag([1.0, 1.0, 0.0]) @ v


def _solved(cameras: list[np.ndarray]) -> tuple[Column, Column, Column]:
    """The point of least squares of both views' four equations, as expressions of x1, y1, x2, y2."""
    rows = []
    for k, p in zip("12", cameras, strict=True):
        for i, name in enumerate("xy"):
            rows.append([F.col(f"{name}{k}") * float(p[2, j]) - float(p[i, j]) for j in range(4)])
    dot = lambda a, b: reduce(lambda s, q: s + q, [r[a] * r[b] for r in rows])
    m = [[dot(min(i, j), max(i, j)) for j in range(3)] for i in range(3)]
    b = [-dot(i, 3) for i in range(3)]
    det = lambda a: a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    whole = det(m)
    parts = [det([[b[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
    return tuple(F.when(whole != 0, part / whole) for part in parts)


def triangulated(pairs: DataFrame, first: np.ndarray, second: np.ndarray) -> DataFrame:
    """ruler, n, t, x, y, z of the points of ``paired``; null where both rays are one."""
    x, y, z = _solved([first, second])
    return pairs.select(*KEY, x.alias("x"), y.alias("y"), z.alias("z"))


def second_camera(pairs: DataFrame) -> np.ndarray:
    """The second camera against the first (``FIRST``), its distance being one.

    Of the four that an essential matrix allows, the one before which, and
    before the first, most points lie; one aggregation counts for all four.
    """
    u, _, v = np.linalg.svd(essential(pairs))
    u, v = u * np.linalg.det(u), v * np.linalg.det(v)
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    found = [np.column_stack([u @ w @ v, s * u[:, 2]]) for w in (turn, turn.T) for s in (1.0, -1.0)]
    counts = []
    for i, p in enumerate(found):
        x, y, z = _solved([FIRST, p])
        ahead = x * float(p[2, 0]) + y * float(p[2, 1]) + z * float(p[2, 2]) + float(p[2, 3])
        counts.append(F.count_if((z > 0) & (ahead > 0)).alias(f"n{i}"))
    n = pairs.agg(*counts).first()
    return found[int(np.argmax([n[f"n{i}"] for i in range(4)]))]


def affine_plane(left: DataFrame, right: DataFrame, names: list, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The plane where parallels meet, from six rulers in ``names``: two parallels along each of three directions.

    Each ruler's points 0 and 1 at time 0 count (at most 24 rows come to the driver).
    """
    spots = []
    for view in (left, right):
        rows = view.where(F.col("ruler").isin(list(names)) & F.col("n").isin(0, 1) & (F.col("t") == 0)).select("ruler", "n", "x", "y").collect()
        at = {(r["ruler"], r["n"]): np.array([r["x"], r["y"], 1.0]) for r in rows}
        gone = [k for k in names if (k, 0) not in at or (k, 1) not in at]
        if len(names) != 6 or gone:
            raise ValueError(f"six rulers of two points in both views are needed; missing: {gone}")
        lines = [np.cross(at[k, 0], at[k, 1]) for k in names]
        spots.append([np.cross(lines[i], lines[i + 1]) for i in (0, 2, 4)])
    meets = []
    for a, b in zip(*spots, strict=True):
        # Places far off have no finite coordinates, so equations are kept homogeneous.
        rows = [q[i] * p[2] - q[2] * p[i] for p, q in ((first, a / np.linalg.norm(a)), (second, b / np.linalg.norm(b))) for i in (0, 1)]
        meets.append(np.linalg.svd(np.array(rows))[2][-1])
    return np.linalg.svd(np.array(meets))[2][-1]


def rectified(points: DataFrame, plane: np.ndarray) -> DataFrame:
    """``points`` (x, y, z) moved so that ``plane`` goes to infinity and parallels are parallel again."""
    over = F.col("x") * float(plane[0]) + F.col("y") * float(plane[1]) + F.col("z") * float(plane[2]) + float(plane[3])
    return points.withColumns({k: F.when(over != 0, F.col(k) / over) for k in "xyz"})
