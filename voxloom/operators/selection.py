"""Masks made from component lists, sizes, points and rays, and channels chosen by visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bricks
from .segmentation import grow

CELL = ["t", "c", "label"]


def _marked(vox: DataFrame, cells: DataFrame) -> DataFrame:
    """``vox`` with ``hit``: whether the sample's component is in ``cells`` (t, c, label)."""
    hits = cells.select(*CELL).distinct().withColumn("hit", F.lit(True))
    return vox.join(hits, CELL, "left").withColumn("hit", F.coalesce("hit", F.lit(False)) & (F.col("label") != 0))


def select_cells(vox: DataFrame, cells: DataFrame) -> DataFrame:
    """The mask becomes full on the listed components and empty elsewhere."""
    return _marked(vox, cells).withColumn("mask", F.when(F.col("hit"), 255).otherwise(0)).drop("hit")


def erase_cells(vox: DataFrame, cells: DataFrame) -> DataFrame:
    """The mask becomes empty on the listed components and stays elsewhere; an empty list empties it whole."""
    if cells.isEmpty():
        return select_all(vox, 0)
    return _marked(vox, cells).withColumn("mask", F.when(F.col("hit"), 0).otherwise(F.col("mask"))).drop("hit")


def select_sized(vox: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """The mask becomes full on components strictly inside the size bounds and empty elsewhere."""
    size = vox.where("label <> 0 and v > 0").groupBy(*CELL).agg(F.count("*").alias("n"))
    if low is not None:
        size = size.where(F.col("n") > low)
    if high is not None:
        size = size.where(F.col("n") < high)
    return select_cells(vox, size)


def select_all(vox: DataFrame, value: int = 255) -> DataFrame:
    """The mask takes one value everywhere: 255 selects all, 0 clears."""
    return vox.withColumn("mask", F.lit(value))


def component_at(vox: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (t, c, z, y, x as doubles) with the label at the nearest sample, 0 where there is none."""
    at = points.select("*", *[F.floor(F.col(k) + 0.5).cast("int").alias(f"i{k}") for k in "zyx"])
    seen = vox.where("label <> 0").select("t", "c", *[F.col(k).alias(f"i{k}") for k in "zyx"], "label")
    found = at.join(seen, ["t", "c", "iz", "iy", "ix"], "left")
    return found.withColumn("label", F.coalesce("label", F.lit(0)).cast("long")).drop("iz", "iy", "ix")


def linked_at(vox: DataFrame, points: DataFrame, links: DataFrame, dims: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """``component_at`` in a bricked volume: each point with brick and label of all parts linked to the one under it.

    ``links`` are ``bricks.linked_components``; a part without links stands alone, a point on nothing gives no row.
    """
    cell = ["t", "c", "brick", "label"]
    found = component_at(vox, points).where("label <> 0")
    place = [F.floor(F.col(k) + 0.5) for k in "zyx"]
    found = found.withColumns({f"_{k}": F.col(k) for k in "zyx"}).withColumns(dict(zip("zyx", place, strict=True))).withColumn("brick", bricks.brick_of(dims, size))
    found = found.withColumns({k: F.col(f"_{k}") for k in "zyx"}).drop("_z", "_y", "_x")
    root = ["t", "c", "root_brick", "root_label"]
    own = found.join(links, cell, "left").withColumn("root_brick", F.coalesce("root_brick", "brick")).withColumn("root_label", F.coalesce("root_label", "label"))
    parts = links.select(*root, F.col("brick").alias("part_brick"), F.col("label").alias("part_label"))
    every = own.join(parts, root, "left")
    return every.select(*points.columns, F.coalesce("part_brick", "brick").alias("brick"), F.coalesce("part_label", "label").alias("label"))


def channels(vox: DataFrame, volumes: DataFrame, mode: int, current: int = 0) -> DataFrame:
    """Samples of the channels a task addresses: 0 the current, 1 all, 2 shown, 3 hidden (volumes: c, visible)."""
    if mode == 1:
        return vox
    if mode == 0:
        return vox.where(F.col("c") == current)
    wanted = volumes.where("visible" if mode == 2 else "not visible").select("c").distinct()
    return vox.join(wanted, "c", "left_semi")


def without_noise(vox: DataFrame, level: int, size: int) -> DataFrame:
    """``vox`` without the runs of samples above ``level`` that have fewer than ``size`` samples; other samples stay."""
    at = ["t", "c", "z", "y", "x"]
    runs = grow(vox, level)
    small = runs.groupBy("t", "c", "label").agg(F.count("*").alias("n")).where(F.col("n") < size)
    return vox.join(runs.join(small, CELL, "left_semi").select(*at), at, "left_anti")


def changed_cells(links: DataFrame, changes: Column, least: int) -> DataFrame:
    """t, c, label of components that a link with ``least`` changes or more touches."""
    seen = links.where(changes >= least)
    out = seen.select("t", "c", F.col("v1").alias("label")).union(seen.select(F.col("t") + 1, "c", F.col("v2")))
    return out.distinct()


def auto_threshold(volumes: DataFrame, current: float) -> float:
    """The stored automatic threshold of the volume (one row, ``auto``), when it is 0 or more; else ``current``."""
    row = volumes.select("auto").first()
    return float(row["auto"]) if row and row["auto"] is not None and row["auto"] >= 0 else current


def ray_peak(samples: DataFrame, vox: DataFrame) -> DataFrame:
    """t, c, ray, step, v: the first sample of largest value above zero on each ray (samples: t, c, ray, step, z, y, x)."""
    seen = samples.join(vox.where("v > 0").select("t", "c", "z", "y", "x", "v"), ["t", "c", "z", "y", "x"])
    best = seen.groupBy("t", "c", "ray").agg(F.max(F.struct("v", (-F.col("step")).alias("s"))).alias("b"))
    return best.select("t", "c", "ray", (-F.col("b.s")).alias("step"), F.col("b.v").alias("v"))


def ray_front(samples: DataFrame, vox: DataFrame, opacity: float, level: float) -> DataFrame:
    """t, c, ray, step: where the value accumulated front to back first exceeds ``level``.

    A sample adds its value times ``opacity`` times what earlier samples let
    through.  A ray is one window; its length is bounded by the grid.
    """
    ray = Window.partitionBy("t", "c", "ray").orderBy("step")
    seen = samples.join(vox.where("v > 0").select("t", "c", "z", "y", "x", "v"), ["t", "c", "z", "y", "x"])
    a = F.col("v") / 255.0 * opacity
    through = F.exp(F.coalesce(F.sum(F.log1p(-a)).over(ray.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    seen = seen.withColumn("add", through * a).withColumn("acc", F.round(F.sum("add").over(ray), 9))
    return seen.where(F.col("acc") > level).groupBy("t", "c", "ray").agg(F.min("step").alias("step"))
