"""Rigid motion between frames: candidates are rows, scored together, from coarse levels to fine ones."""

from __future__ import annotations

from itertools import product
from math import cos, radians, sin

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

KEY = ["t", "c"]
Dims = tuple[int, int, int]
Angles = tuple[float, float, float]
MOVE = ["move", "dz", "dy", "dx"]


def rotation(angles: Angles) -> list[list[float]]:
    """The matrix, in z, y, x order, of turns by degrees about x, then y, then z."""
    az, ay, ax = (radians(a) for a in angles)

    def times(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
        return [[sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)] for i in range(3)]

    about_z = [[1.0, 0.0, 0.0], [0.0, cos(az), sin(az)], [0.0, -sin(az), cos(az)]]
    about_y = [[cos(ay), 0.0, -sin(ay)], [0.0, 1.0, 0.0], [sin(ay), 0.0, cos(ay)]]
    about_x = [[cos(ax), sin(ax), 0.0], [-sin(ax), cos(ax), 0.0], [0.0, 0.0, 1.0]]
    return times(about_z, times(about_y, about_x))


def reduced(vox: DataFrame, by: int) -> DataFrame:
    """Means of blocks of ``by`` samples a side, absent samples counted as zeros, as whole numbers."""
    if by == 1:
        return vox.where("v > 0").select(*KEY, "z", "y", "x", F.col("v").cast("long").alias("v"))
    place = [F.floor(F.col(k) / by).cast("int").alias(k) for k in "zyx"]
    means = vox.where("v > 0").groupBy(*KEY, *place).agg(F.sum("v").alias("v"))
    return means.withColumn("v", F.round(F.col("v") / by**3).cast("long")).where("v > 0")


def rigid_scores(vox: DataFrame, dims: Dims, turns: list[Angles], candidates: DataFrame) -> DataFrame:
    """``candidates`` (t, c, move, dz, dy, dx) with ``total``: the sum of products of frame t and frame t + 1.

    A sample at p of frame t meets the sample nearest to
    R (p - centre) + centre + d of frame t + 1, R being that of
    ``turns[move]``; what lies outside the grid, or is absent, counts as zero.
    Both frames have whole values, so totals are exact.

    A sample becomes as many rows as its frame has candidates, and these are
    joined by place and summed by candidate where they were joined first.
    """
    centred = [F.col(k) + F.lit(0.5 - n / 2) for k, n in zip("zyx", dims, strict=True)]

    # One row a turn.
    names = [f"m{i}{j}" for i in range(3) for j in range(3)]
    table = [(m, *sum(rotation(a), [])) for m, a in enumerate(turns)]
    matrices = vox.sparkSession.createDataFrame(table, ", ".join(["move int", *[f"{n} double" for n in names]]))
    wanted = candidates.select(*KEY, *MOVE).distinct().join(F.broadcast(matrices), "move")
    rows = vox.where("v > 0").select(*KEY, "z", "y", "x", "v").join(wanted, KEY)
    place = [sum((c * F.col(f"m{i}{j}") for j, c in enumerate(centred)), F.lit(n / 2)) for i, n in enumerate(dims)]
    moved = rows.select(*KEY, *MOVE, "v", *[F.floor(p + F.col(f"d{k}") + F.lit(1e-9)).cast("int").alias(k) for p, k in zip(place, "zyx", strict=True)])
    nxt = vox.where("v > 0").select((F.col("t") - 1).cast("int").alias("t"), "c", "z", "y", "x", F.col("v").alias("w"))
    found = moved.join(nxt, [*KEY, "z", "y", "x"]).groupBy(*KEY, *MOVE).agg(F.sum(F.col("v").cast("long") * F.col("w")).alias("total"))
    return candidates.join(found, [*KEY, *MOVE], "left").na.fill(0, ["total"])


def _best(scores: DataFrame, turns: list[Angles]) -> DataFrame:
    size = F.element_at(F.array(*[F.lit(sum(abs(a) for a in angles)) for angles in turns]), F.col("move") + 1)
    order = Window.partitionBy(*KEY).orderBy(F.desc("total"), F.abs("dz") + F.abs("dy") + F.abs("dx"), size, *MOVE)
    return scores.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def register_rigid(vox: DataFrame, dims: Dims, axes: str = "z", reach: float = 20.0, step: float = 5.0, shift: int = 3, levels: int = 1, rounds: int = 12) -> DataFrame:
    """t, c, az, ay, ax, dz, dy, dx, total, settled: the turn (degrees) and shift that lay frame t over frame t + 1.

    The coarsest of ``levels`` halvings of the grid tries every turn within
    ``reach`` about the ``axes``, ``step`` apart, with every shift of up to
    ``shift`` of its samples along y and x.  Then each level climbs over neighbouring turns
    with neighbouring shifts, turns being half as far apart at each finer
    level; a pair of frames has ``settled`` when the last round of the finest
    level has not moved it.  All
    pairs of frames climb at once, a row each.  Of equal totals the shorter
    shift and the smaller turn is taken.
    """
    grid = [round(-reach + k * step, 6) for k in range(int(2 * reach / step) + 1)]
    turns = sorted({tuple(a if k in axes else 0.0 for k, a in zip("zyx", of, strict=True)) for of in product(*[grid if k in axes else [0.0] for k in "zyx"])})
    frames = vox.where("v > 0").select(*KEY).distinct()
    pairs = cut(frames.join(frames.select((F.col("t") - 1).cast("int").alias("t"), "c"), KEY))
    at = None
    for level in range(levels, -1, -1):
        by = 1 << level
        small, size = cut(reduced(vox, by)), tuple(-(-n // by) for n in dims)
        if at is None:
            span = [range(1), *[range(-shift, shift + 1)] * 2]
            moves = F.array(*[F.struct(F.lit(m).alias("move"), *[F.lit(q).alias(f"d{k}") for k, q in zip("zyx", d, strict=True)]) for m in range(len(turns)) for d in product(*span)])
            first = pairs.select(*KEY, F.explode(moves).alias("m")).select(*KEY, "m.*")
            found = cut(_best(rigid_scores(small, size, turns, first), turns))
        else:
            # As many rows as there are pairs of frames: their turns and shifts, now in samples twice as fine.
            found = at.select(*KEY, "move", *[(F.col(f"d{k}") * 2).alias(f"d{k}") for k in "zyx"], "total")
            step /= 2
        at = found.withColumn("settled", F.lit(False))
        for _ in range(rounds):
            now = at.select(*KEY, *MOVE).collect()
            held = {(r["t"], r["c"]): (turns[r["move"]], r["dz"], r["dy"], r["dx"]) for r in now}
            near, names = [], {}
            for (t, c), (angles, dz, dy, dx) in held.items():
                turned = {tuple(round(a + q * step, 6) if k in axes else a for k, a, q in zip("zyx", angles, of, strict=True)) for of in product((-1, 0, 1), repeat=3)}
                tried = {(a, dz + z, dy + y, dx + x) for a in turned for z, y, x in product((-1, 0, 1), repeat=3)}
                for a, *d in sorted(tried):
                    near.append((t, c, names.setdefault(a, len(names)), *d))
            turns = list(names)
            tries = vox.sparkSession.createDataFrame(near, "t int, c int, move int, dz int, dy int, dx int")
            best = _best(rigid_scores(small, size, turns, tries), turns).collect()
            after = {(r["t"], r["c"]): (turns[r["move"]], r["dz"], r["dy"], r["dx"]) for r in best}
            rows = [(*[r[k] for k in (*KEY, *MOVE, "total")], held[r["t"], r["c"]] == after[r["t"], r["c"]]) for r in best]
            at = vox.sparkSession.createDataFrame(rows, "t int, c int, move int, dz int, dy int, dx int, total long, settled boolean")
            if held == after:
                break
    angle = [F.element_at(F.array(*[F.lit(a[i]) for a in turns]), F.col("move") + 1).alias(f"a{k}") for i, k in enumerate("zyx")]
    return at.select(*KEY, *angle, "dz", "dy", "dx", "total", "settled")


def track_stencils(vox: DataFrame, first: int, last: int, reach: Dims = (0, 2, 2), follow: bool = True) -> DataFrame:
    """t, c, label, z, y, x, dz, dy, dx, total: where the masks of frame ``first`` lie in each later frame, up to ``last``.

    From frame to frame each mask (c, label) moves as a whole by the shift
    within ``reach`` whose sum of products with the next frame is largest; of
    equal ones by the shorter, then the first in order.  ``follow``: it is
    compared by the values of the frame before; otherwise by those of frame
    ``first``.  ``total`` belongs to the mask's last move.  Masks move
    independently and may come to overlap; samples outside all data count as
    zeros, and masks keep them.

    Frames are taken one after the other, masks all at once: a sample becomes
    as many rows as there are shifts, joined with the next frame by place.
    """
    shifts = [F.struct(*[F.lit(q).alias(f"d{k}") for k, q in zip("zyx", d, strict=True)]) for d in product(*[range(-r, r + 1) for r in reach])]
    mask = ["c", "label"]
    now = vox.where((F.col("t") == first) & (F.col("label") != 0)).select(*mask, "z", "y", "x", "v")
    zero = [F.lit(0).alias(f"d{k}") for k in "zyx"]
    out = now.select(F.lit(first).alias("t"), *mask, "z", "y", "x", *zero, F.lit(0).cast("long").alias("total"))
    order = Window.partitionBy(*mask).orderBy(F.desc("total"), F.abs("dz") + F.abs("dy") + F.abs("dx"), "dz", "dy", "dx")
    for t in range(first + 1, last + 1):
        there = vox.where((F.col("t") == t) & (F.col("v") > 0)).select("c", "z", "y", "x", F.col("v").alias("w"))
        tried = now.select(*mask, "z", "y", "x", "v", F.explode(F.array(*shifts)).alias("d")).select(*mask, "d.*", "v", *[(F.col(k) + F.col(f"d.d{k}")).alias(k) for k in "zyx"])
        met = tried.join(there, ["c", "z", "y", "x"]).groupBy(*mask, "dz", "dy", "dx").agg(F.sum(F.col("v").cast("long") * F.col("w")).alias("total"))
        best = met.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
        # A mask that meets nothing stays where it is.
        moved = now.join(best, mask, "left").na.fill(0, ["dz", "dy", "dx", "total"])
        moved = moved.select(*mask, *[(F.col(k) + F.col(f"d{k}")).alias(k) for k in "zyx"], "v", "dz", "dy", "dx", "total")
        if follow:
            moved = moved.drop("v").join(there, ["c", "z", "y", "x"], "left").select(*mask, "z", "y", "x", F.coalesce("w", F.lit(0)).alias("v"), "dz", "dy", "dx", "total")
        moved = cut(moved)
        out = out.unionByName(moved.select(F.lit(t).alias("t"), *mask, "z", "y", "x", "dz", "dy", "dx", "total"))
        now = moved.select(*mask, "z", "y", "x", "v")
    return out
