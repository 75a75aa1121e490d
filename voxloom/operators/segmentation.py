"""Labels grown over gated volumes, and label edits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stencil
from .graph import connected, cut

KEY = ["t", "c"]
#: Side of the bricks in which runs are found; positions have 20 bits an axis.
SIDE, BITS = 32, 20


def scan_code(z: Column | str = "z", y: Column | str = "y", x: Column | str = "x") -> Column:
    """Place of a position in scan order, as a long."""
    z, y, x = (F.col(k) if isinstance(k, str) else k for k in (z, y, x))
    return F.shiftleft(z.cast("long"), 2 * BITS).bitwiseOR(F.shiftleft(y.cast("long"), BITS)).bitwiseOR(x.cast("long"))


def brick_runs(on: np.ndarray) -> np.ndarray:
    """For each true sample of a dense brick, the flat index of its run's first sample in scan order; runs join over 26 neighbours."""
    n = on.size
    at = np.where(on, np.arange(n).reshape(on.shape), n)
    while True:
        padded = np.pad(at, 1, constant_values=n)
        least = at.copy()
        for _, view in stencil.shifts(padded, 1):
            np.minimum(least, view, out=least)
        least[~on] = n
        # A sample takes over what its run's first sample so far has found.
        least[on] = least.reshape(-1)[least[on]]
        if (least == at).all():
            return at
        at = least


def _runs(on: DataFrame) -> DataFrame:
    """t, c, z, y, x, run: runs inside bricks, named by the place of their first sample."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        # The brick is cut to where its samples are.
        low = [int(pdf[k].min()) for k in "zyx"]
        at = tuple(pdf[k].to_numpy() - q for k, q in zip("zyx", low, strict=True))
        dense = np.zeros([int(q.max()) + 1 for q in at], bool)
        dense[at] = True
        first = np.unravel_index(brick_runs(dense)[at], dense.shape)
        z, y, x = (f.astype(np.int64) + q for f, q in zip(first, low, strict=True))
        return pdf[[*KEY, "z", "y", "x"]].assign(run=z << 2 * BITS | y << BITS | x)

    bricks = [F.floor(F.col(k) / SIDE).cast("int").alias(f"b{k}") for k in "zyx"]
    rows = on.select(*KEY, "z", "y", "x", *bricks).groupBy(*KEY, "bz", "by", "bx")
    return rows.applyInPandas(label, "t int, c int, z int, y int, x int, run long")


def grow(vox: DataFrame, level: int) -> DataFrame:
    """t, c, z, y, x, label of samples above ``level``: connected runs over 26 neighbours share a label.

    The growth's fixed point without random gating.  A run's label is one more
    than the place of its first sample in scan order.  Runs are found brick by
    brick; only samples on bricks' faces are joined, and what is linked
    between tasks are runs, not samples.
    """
    rows = cut(_runs(vox.where(F.col("v") > level)))
    sides = [(F.col(k) % SIDE).isin(0, SIDE - 1) for k in "zyx"]
    rim = rows.where(sides[0] | sides[1] | sides[2])
    half = [d for d in ((z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)) if d > (0, 0, 0)]
    offsets = F.explode(F.array(*[F.struct(*[F.lit(q).alias(k) for q, k in zip(d, ("dz", "dy", "dx"), strict=True)]) for d in half]))
    seen = rim.withColumn("o", offsets)
    crossing = [F.floor((F.col(k) + F.col(f"o.d{k}")) / SIDE) != F.floor(F.col(k) / SIDE) for k in "zyx"]
    seen = seen.where(crossing[0] | crossing[1] | crossing[2])
    seen = seen.select(*KEY, *[(F.col(k) + F.col(f"o.d{k}")).alias(k) for k in "zyx"], F.col("run").alias("a"))
    pairs = seen.join(rim.select(*KEY, "z", "y", "x", F.col("run").alias("b")), [*KEY, "z", "y", "x"]).select(*KEY, "a", "b").distinct()
    node = lambda k: F.struct(*KEY, F.col(k).alias("run")).alias(k)
    roots = connected(pairs.select(node("a"), node("b")))
    roots = roots.select("node.t", "node.c", "node.run", F.col("root.run").alias("first"))
    named = rows.join(roots, [*KEY, "run"], "left")
    return named.select(*KEY, "z", "y", "x", (F.coalesce("first", "run") + 1).alias("label"))


def stopped(vox: DataFrame, dims: tuple[int, int, int], value: float, value_falloff: float, grad_falloff: float, least: float = 1e-4) -> DataFrame:
    """Samples of ``vox`` where the stop function (see ``stencil.stop``) reaches ``least``: growth goes on."""
    gate = stencil.apply(vox, dims, 1, stencil.stop(value, value_falloff, grad_falloff), exact=True)
    return vox.join(gate.where(F.col("v") >= least).select(*KEY, "z", "y", "x"), [*KEY, "z", "y", "x"], "left_semi")


def stop_grow(vox: DataFrame, dims: tuple[int, int, int], value: float, value_falloff: float = 0.0, grad_falloff: float = 0.0) -> DataFrame:
    """``grow`` over the samples above zero at which the stop function does not end it."""
    return grow(stopped(vox, dims, value, value_falloff, grad_falloff), 0)


def clean_outside(vox: DataFrame, inside: bool = False) -> DataFrame:
    """Labels outside (or inside) the mask become 0."""
    hit = F.col("mask") > 0 if inside else F.col("mask") == 0
    return vox.withColumn("label", F.when(hit, 0).otherwise(F.col("label")).cast("long"))


def replace_id(vox: DataFrame, target: int) -> DataFrame:
    """Masked labels other than 0 become ``target``."""
    return vox.withColumn("label", F.when((F.col("mask") > 0) & (F.col("label") != 0), target).otherwise(F.col("label")).cast("long"))


def new_id(vox: DataFrame) -> DataFrame:
    """The masked region of each frame and channel takes an unused label: its largest plus ten."""
    top = vox.groupBy(*KEY).agg((F.max("label") + 10).alias("fresh"))
    return vox.join(top, KEY).withColumn("label", F.when(F.col("mask") > 0, F.col("fresh")).otherwise(F.col("label"))).drop("fresh")


def combine_ids(vox: DataFrame) -> DataFrame:
    """Masked labels become the first masked label in scan order."""
    first = vox.where("mask > 0 and label <> 0").groupBy(*KEY).agg(F.min_by("label", F.struct("z", "y", "x")).alias("first"))
    return vox.join(first, KEY, "left").withColumn("label", F.when((F.col("mask") > 0) & (F.col("label") != 0), F.col("first")).otherwise(F.col("label"))).drop("first")


def mask_only_id(vox: DataFrame, label: int) -> DataFrame:
    return vox.withColumn("mask", F.when(F.col("label") == label, 255).otherwise(0))


def clean_noise(vox: DataFrame, least: int) -> DataFrame:
    """Samples of components below ``least`` take the label of the closest (L1, then scan order) 26-neighbour of a larger one that is no darker."""
    size = F.count("*").over(Window.partitionBy(*KEY, "label"))
    rows = vox.where("label <> 0 and v > 0").withColumn("size", size)
    offsets = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) != (0, 0, 0)]
    o = F.explode(F.array(*[F.struct(*[F.lit(q).alias(k) for q, k in zip(d, ("dz", "dy", "dx"), strict=True)], F.lit(sum(map(abs, d))).alias("l1"), F.lit(i).alias("ord")) for i, d in enumerate(offsets)]))
    small = rows.where(F.col("size") < least).withColumn("o", o)
    seen = small.select(*KEY, F.col("z").alias("z0"), F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("v").alias("v0"), F.struct("o.l1", "o.ord").alias("near"), *[(F.col(k) + F.col(f"o.d{k}")).alias(k) for k in "zyx"])
    big = rows.where(F.col("size") >= least).select(*KEY, "z", "y", "x", F.col("label").alias("nl"), F.col("v").alias("nv"))
    taken = seen.join(big, [*KEY, "z", "y", "x"]).where("nv >= v0").groupBy(*KEY, F.col("z0").alias("z"), F.col("y0").alias("y"), F.col("x0").alias("x")).agg(F.min_by("nl", "near").alias("nl"))
    return rows.drop("size").join(taken, [*KEY, "z", "y", "x"], "left").withColumn("label", F.coalesce("nl", "label")).drop("nl")


def masked_grow(vox: DataFrame, level: int) -> DataFrame:
    """``grow`` inside the mask alone."""
    return grow(vox.where("mask > 0"), level)


def diffused(vox: DataFrame, seed_level: int, level: int) -> DataFrame:
    """t, c, z, y, x of the selection: samples above ``level`` that neighbours of 26 join to one at ``seed_level`` or more.

    The fixed point of the growth: whole runs that hold a seed.
    """
    at = [*KEY, "z", "y", "x"]
    runs = grow(vox, level)
    seeds = vox.where(F.col("v") >= seed_level).select(*at).join(runs, at).select(*KEY, "label").distinct()
    return runs.join(seeds, [*KEY, "label"], "left_semi").select(*at)


def replay(vox: DataFrame, commands: list[dict[str, str]]) -> DataFrame:
    """``vox`` with the labels that a recorded list of commands gives: generate, clean, fixate.

    ``generate`` grows above ``thresh`` (a share of full scale), ``clean``
    repeats the noise cleaning ``clean_iter`` times below ``clean_size_vl``
    samples (a generate command with ``cleanb`` does so as well), and
    ``fixate`` keeps the components of ``size`` samples or more as they are
    when later commands grow again.
    """
    at = [*KEY, "z", "y", "x"]
    fixed = None
    for c in commands:
        if c["type"] not in ("generate", "clean", "fixate"):
            raise ValueError(f"unknown command {c['type']}")
        if c["type"] == "generate":
            found = grow(vox, int(float(c.get("thresh", 0)) * 255))
            if fixed is not None:
                top = fixed.groupBy(*KEY).agg(F.max("label").alias("top"))
                found = found.join(fixed, at, "left_anti").join(top, KEY, "left").withColumn("label", F.col("label") + F.coalesce("top", F.lit(0))).drop("top").unionByName(fixed)
            vox = vox.drop("label").join(found, at, "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("long"))
        if c["type"] == "clean" or (c["type"] == "generate" and c.get("cleanb") == "1"):
            for _ in range(int(c.get("clean_iter", 1))):
                new = clean_noise(vox, int(c.get("clean_size_vl", 5))).select(*at, F.col("label").alias("new"))
                vox = cut(vox.join(new, at, "left").withColumn("label", F.coalesce("new", "label")).drop("new"))
        if c["type"] == "fixate":
            size = F.count("*").over(Window.partitionBy(*KEY, "label"))
            fixed = cut(vox.where("label <> 0").withColumn("_n", size).where(F.col("_n") >= int(c.get("size", 0))).select(*at, "label"))
    return vox
