"""Local density, its tile statistics, distance fields, and the growth that they gate."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segmentation, stencil

KEY = ["t", "c"]
Dims = tuple[int, int, int]
_FAR = 1 << 30


def density(vox: DataFrame, dims: Dims, radius: int = 1, scale: float = 1.0) -> DataFrame:
    """t, c, z, y, x, v: mean of the in-plane neighbourhood times ``scale``, cut to bytes."""
    mean = stencil.kernel(lambda dz, dy, dx: 1.0, planar=True, scaled=True)
    return stencil.apply(vox, dims, radius, lambda a, r: scale * np.round(mean(a, r), 12))


def tile_field(field: DataFrame, dims: Dims, tile: Dims) -> DataFrame:
    """t, c, bz, by, bx, mean, sigma of whole tiles, cut to bytes; absent samples are zeros of their tile."""
    volume = float(np.prod(tile))
    at = [F.floor(F.col(k) / s).cast("int").alias(f"b{k}") for k, s in zip("zyx", tile, strict=True)]
    sums = field.groupBy(*KEY, *at).agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    mean = F.col("s1") / volume
    spread = F.sqrt(F.greatest(F.col("s2") / volume - mean * mean, F.lit(0.0)))
    return sums.select(*KEY, "bz", "by", "bx", F.floor(mean).cast("int").alias("mean"), F.floor(F.least(spread, F.lit(255.0))).cast("int").alias("sigma"))


def interpolated(rows: DataFrame, tiles: DataFrame, dims: Dims, tile: Dims, names: tuple[str, ...] = ("mean", "sigma")) -> DataFrame:
    """``rows`` with the tiles' values interpolated between tile centres, cut to bytes; the outermost tiles extend.

    A cell lies between the centres of eight tiles.  Each tile is dealt to its
    cells, a row a cell then holds the eight corners, and samples join their
    cell once: tiles are few, so only that join may move the samples.
    """
    counts = [-(-n // s) for n, s in zip(dims, tile, strict=True)]
    corners = tiles
    for k, n in zip("zyx", counts, strict=True):
        b = F.col(f"b{k}")
        cell = lambda g, o: F.struct(g.cast("int").alias("g"), F.lit(o).alias("o"))
        cells = F.array(cell(b, 0), cell(b - 1, 1), F.when(b == 0, cell(F.lit(-1), 0)), F.when(b == n - 1, cell(F.lit(n - 1), 1)))
        corners = corners.withColumn(f"e{k}", F.explode(F.filter(cells, lambda q: q.isNotNull())))
    on = [F.col(f"e{k}.g").alias(f"g{k}") for k in "zyx"]
    code = F.col("ez.o") * 4 + F.col("ey.o") * 2 + F.col("ex.o")
    corners = corners.groupBy(*KEY, *on).agg(*[F.sum(F.when(code == q, F.col(n))).alias(f"{n}_{q}") for n in names for q in range(8)])

    def place(k: str, s: int) -> tuple[Column, Column]:
        inside = F.col(k) % s
        low = inside < s / 2
        g = F.floor(F.col(k) / s) - low.cast("int")
        return g.cast("int").alias(f"g{k}"), ((inside - s / 2) / s + low.cast("int")).alias(f"f{k}")

    placed = rows.select("*", *[c for k, s in zip("zyx", tile, strict=True) for c in place(k, s)])
    placed = placed.join(corners, [*KEY, "gz", "gy", "gx"], "left")
    for n in names:
        total = F.lit(0.0)
        for q, side in enumerate(product((0, 1), repeat=3)):
            w = F.lit(1.0)
            for k, o in zip("zyx", side, strict=True):
                w = w * (F.col(f"f{k}") if o else 1 - F.col(f"f{k}"))
            total = total + w * F.coalesce(f"{n}_{q}", F.lit(0))
        placed = placed.withColumn(n, F.floor(total + 1e-6).cast("int"))
    return placed.select(*rows.columns, *names)


def distance(inside: DataFrame, dims: Dims, most: int = 30) -> DataFrame:
    """t, c, z, y, x, dist of the positions in ``inside``: layers peeled off over 6 neighbours, ``most`` at most.

    The grid's faces are outside.  Layers are the city-block distance to the
    nearest outside position, which three passes of windows along the axes
    give: no loop over layers.  Only the outside positions that touch the
    inside are held.
    """
    edge = [(F.col(k) > 0) & (F.col(k) < n - 1) for k, n in zip("zyx", dims, strict=True)]
    held = inside.where(edge[0] & edge[1] & edge[2]).select(*KEY, "z", "y", "x").distinct()
    steps = F.array(*[F.struct(*[F.lit(q).alias(f"d{k}") for k, q in zip("zyx", d, strict=True)]) for d in ((0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0))])
    around = held.withColumn("o", F.explode(steps)).select(*KEY, *[(F.col(k) + F.col(f"o.d{k}")).alias(k) for k in "zyx"])
    both = held.withColumn("d", F.lit(_FAR)).unionByName(around.withColumn("d", F.lit(0))).groupBy(*KEY, "z", "y", "x").agg(F.max("d").alias("d"))
    for axis in "xyz":
        line = Window.partitionBy(*KEY, *[k for k in "zyx" if k != axis]).orderBy(axis)
        back = F.min(F.col("d") - F.col(axis)).over(line.rowsBetween(Window.unboundedPreceding, 0)) + F.col(axis)
        ahead = F.min(F.col("d") + F.col(axis)).over(line.rowsBetween(0, Window.unboundedFollowing)) - F.col(axis)
        both = both.withColumn("d", F.least(back, ahead))
    return both.where("d > 0").select(*KEY, "z", "y", "x", F.least(F.col("d"), F.lit(most)).cast("int").alias("dist"))


def dense_enough(vox: DataFrame, dims: Dims, radius: int, tile: Dims, level: float, spread: float, scale: float = 1.0) -> DataFrame:
    """Samples where the tiles' sigma reaches ``spread`` * 255 and the density mean - (1 - level) * sigma."""
    field = density(vox, dims, radius, scale)
    gate = interpolated(field.withColumnRenamed("v", "density"), tile_field(field, dims, tile), dims, tile)
    gate = gate.where((F.col("sigma") >= spread * 255) & (F.col("density") >= F.col("mean") - (1 - level) * F.col("sigma")))
    return vox.join(gate.select(*KEY, "z", "y", "x"), [*KEY, "z", "y", "x"], "left_semi")


def distance_weighted(vox: DataFrame, dims: Dims, level: int, strength: float, most: int = 30) -> DataFrame:
    """``v`` drawn towards the distance inside ``v`` > ``level``: v * (1 - strength) + min(5 * dist / most, 1) * strength, of full scale 255."""
    d = distance(vox.where(F.col("v") > level), dims, most)
    near = F.least(F.coalesce("dist", F.lit(0)) * F.lit(5.0 / most), F.lit(1.0)) * 255
    rows = vox.join(d, [*KEY, "z", "y", "x"], "left")
    return rows.withColumn("v", F.floor(F.col("v") * (1 - strength) + near * strength + 1e-6).cast("int")).drop("dist")


def density_grow(vox: DataFrame, dims: Dims, level: int, radius: int = 1, tile: Dims = (4, 8, 8), density_level: float = 1.0, spread: float = 0.01) -> DataFrame:
    """Growth (see ``segmentation.grow``) over the samples that are dense enough."""
    return segmentation.grow(dense_enough(vox, dims, radius, tile, density_level, spread), level)


def distance_grow(vox: DataFrame, dims: Dims, level: int, strength: float = 0.5, most: int = 30) -> DataFrame:
    """Growth over samples drawn towards their distance from the background."""
    return segmentation.grow(distance_weighted(vox, dims, level, strength, most), level)


def distance_density_grow(vox: DataFrame, dims: Dims, level: int, strength: float = 0.5, most: int = 30, radius: int = 1, tile: Dims = (4, 8, 8), density_level: float = 1.0, spread: float = 0.01) -> DataFrame:
    """Growth gated by density, over samples drawn towards their distance."""
    return segmentation.grow(dense_enough(distance_weighted(vox, dims, level, strength, most), dims, radius, tile, density_level, spread), level)
