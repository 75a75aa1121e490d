"""Local extrema: the flood downhill from each component's brightest sample, and the moments of what it covers."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

KEY = ["t", "c", "label"]
PLACE = ["z", "y", "x"]
OFFSETS = [d for d in product((-1, 0, 1), repeat=3) if any(d)]
#: Samples of a brick's side.
BRICK = 32


def peaks(vox: DataFrame) -> DataFrame:
    """t, c, label, peak, pz, py, px, range: the brightest sample of each component, the first in z, y, x order, and its rise over the darkest."""
    rows = vox.where("label <> 0 and v > 0")
    best = F.max(F.struct("v", *[(-F.col(k)).alias(f"p{k}") for k in PLACE])).alias("b")
    found = rows.groupBy(*KEY).agg(best, (F.max("v") - F.min("v")).alias("range"))
    return found.select(*KEY, F.col("b.v").alias("peak"), *[(-F.col(f"b.p{k}")).alias(f"p{k}") for k in PLACE], "range")


def _flooded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The samples of one brick that its seeds reach and that were not reached before."""
    low = pdf[PLACE].min().to_numpy() - 1
    shape = pdf[PLACE].max().to_numpy() - low + 2
    at = np.ravel_multi_index(tuple((pdf[PLACE].to_numpy() - low).T), shape)
    v, label, span = (np.zeros(int(np.prod(shape)), np.int64) for _ in range(3))
    v[at], label[at], span[at] = pdf["v"], pdf["label"], pdf["range"]
    open_ = np.zeros(len(v), bool)
    open_[at] = ~pdf["reached"].to_numpy(bool)
    front = at[pdf["seed"].to_numpy(bool) & open_[at]]
    open_[front] = False
    new = [front]
    steps = [int(np.ravel_multi_index(np.array(d) + 1, shape)) - int(np.ravel_multi_index((1, 1, 1), shape)) for d in OFFSETS]
    while len(front):
        found = []
        for step in steps:
            to = front + step
            found.append(to[open_[to] & (label[to] == label[front]) & (100 * (v[to] - v[front]) < span[front])])
        front = np.unique(np.concatenate(found))
        open_[front] = False
        new.append(front)
    at = np.concatenate(new)
    z, y, x = np.unravel_index(at, shape)
    t, c, *_ = key
    return pd.DataFrame({"t": t, "c": c, "label": label[at], "z": z + low[0], "y": y + low[1], "x": x + low[2], "v": v[at], "range": span[at]})


def floods(vox: DataFrame, brick: int = BRICK) -> DataFrame:
    """t, c, label, z, y, x, v: what is reached from each component's peak over 26 neighbours of the component.

    A step may rise by less than a hundredth of the component's range.  A
    brick floods inside itself until it settles; then only reached samples at
    its faces are joined with their neighbours beyond, which seed the next
    round.  So rounds count crossings of bricks, and a round reads no brick
    without a new seed.  Repeated rows of one position: the largest counts.
    """
    at = [F.floor(F.col(k) / brick).cast("int").alias(f"b{k}") for k in PLACE]
    tops = peaks(vox)
    rows = vox.where("label <> 0 and v > 0").groupBy("t", "c", *PLACE).agg(F.max(F.struct("v", "label")).alias("s")).select("t", "c", *PLACE, "s.v", "s.label")
    rows = cut(rows.join(tops.select(*KEY, "range"), KEY).select("t", "c", *at, *KEY[2:], *PLACE, "v", "range"))
    seeds = cut(tops.select(*KEY, *[F.col(f"p{k}").alias(k) for k in PLACE]))
    reached = None
    whole = [*KEY, *PLACE]
    kinds = "t int, c int, label long, z int, y int, x int, v int, range int"
    while not seeds.isEmpty():
        bricks = seeds.select("t", "c", *at).distinct()
        awake = rows.join(bricks, ["t", "c", "bz", "by", "bx"], "left_semi").join(seeds.select(*whole, F.lit(True).alias("seed")), whole, "left")
        if reached is None:
            awake = awake.withColumn("reached", F.lit(False))
        else:
            awake = awake.join(reached.select(*whole, F.lit(True).alias("reached")), whole, "left")
        awake = awake.na.fill(False, ["seed", "reached"]) if reached is not None else awake.na.fill(False, ["seed"])
        new = cut(awake.groupBy("t", "c", "bz", "by", "bx").applyInPandas(_flooded, kinds))
        reached = new if reached is None else cut(reached.unionByName(new))
        face = None
        for k in PLACE:
            on = (F.pmod(F.col(k), F.lit(brick)) == 0) | (F.pmod(F.col(k), F.lit(brick)) == brick - 1)
            face = on if face is None else face | on
        step = F.explode(F.array(*[F.struct(*[F.lit(q).alias(f"d{k}") for k, q in zip(PLACE, d, strict=True)]) for d in OFFSETS])).alias("d")
        near = new.where(face).select(*KEY, *PLACE, F.col("v").alias("from"), "range", step)
        other = [F.floor((F.col(k) + F.col(f"d.d{k}")) / brick) != F.floor(F.col(k) / brick) for k in PLACE]
        near = near.where(other[0] | other[1] | other[2]).select(*KEY, "from", *[(F.col(k) + F.col(f"d.d{k}")).alias(k) for k in PLACE])
        met = near.join(rows, whole).where("100 * (v - `from`) < range").select(*whole).distinct()
        seeds = cut(met.join(reached.select(*whole), whole, "left_anti"))
    return reached.drop("range") if reached is not None else rows.select(*whole, "v").limit(0)


def local_extrema(vox: DataFrame, brick: int = BRICK) -> DataFrame:
    """Per component: peak, pz, py, px, n, low, and the means (mx ...) and variances (vx ...) of the flood.

    Samples weigh by their rise over the flood's darkest, ``low``; where all
    are equal there are no moments (null).
    """
    wet = floods(vox, brick)
    lows = wet.groupBy(*KEY).agg(F.min("v").alias("low"))
    rows = wet.join(lows, KEY).withColumn("w", F.col("v") - F.col("low"))
    total = F.sum("w")
    mean = {k: F.when(total > 0, F.sum(F.col("w") * F.col(k)) / total) for k in "xyz"}
    square = {k: F.when(total > 0, F.sum(F.col("w") * F.col(k) * F.col(k)) / total) for k in "xyz"}
    moments = rows.groupBy(*KEY, "low").agg(F.count("*").alias("n"), *[mean[k].alias(f"m{k}") for k in "xyz"], *[(square[k] - mean[k] * mean[k]).alias(f"v{k}") for k in "xyz"])
    return peaks(vox).drop("range").join(moments, KEY)
