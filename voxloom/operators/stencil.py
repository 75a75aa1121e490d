"""Neighbourhood operators over dense bricks with a halo.

Samples are dealt to bricks, those near a brick's edge to its neighbours too,
so one shuffle brings each brick all it needs.  Numpy works on one brick at a
time.  Samplers clamp to the grid's edge; results are clamped to 0..1 and cut
to integers of full scale 255.  Absent samples are zero.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRICK = (16, 32, 64)
Stencil = Callable[[np.ndarray, int], np.ndarray]


def shifts(a: np.ndarray, r: int, planar: bool = False):
    """All shifted cores of an array padded by ``r``: (dz, dy, dx), view."""
    nz, ny, nx = (s - 2 * r for s in a.shape)
    for dz in [0] if planar else range(-r, r + 1):
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                yield (dz, dy, dx), a[r + dz : r + dz + nz, r + dy : r + dy + ny, r + dx : r + dx + nx]


def core(a: np.ndarray, r: int) -> np.ndarray:
    return a[r : a.shape[0] - r, r : a.shape[1] - r, r : a.shape[2] - r]


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    return reduce(np.add, (v for _, v in shifts(a, r))) / (2 * r + 1) ** 3


def dilate(a: np.ndarray, r: int) -> np.ndarray:
    return reduce(np.maximum, (v for _, v in shifts(a, r)))


def erode(a: np.ndarray, r: int) -> np.ndarray:
    return reduce(np.minimum, (v for _, v in shifts(a, r)))


def median(a: np.ndarray, r: int) -> np.ndarray:
    """The element one below the middle, counted from one."""
    k = (2 * r + 1) ** 3
    return np.partition(np.stack([v for _, v in shifts(a, r)]), k // 2 - 1, axis=0)[k // 2 - 1]


def gradient(a: np.ndarray, r: int) -> np.ndarray:
    return dilate(a, r) - core(a, r)


def kernel(weights: Callable[[int, int, int], float], planar: bool = False, scaled: bool = False) -> Stencil:
    """Weighted sum over the neighbourhood; ``scaled`` divides by the sum of weights."""

    def run(a: np.ndarray, r: int) -> np.ndarray:
        out, total = np.zeros_like(core(a, r)), 0.0
        for d, v in shifts(a, r, planar):
            w = weights(*d)
            out, total = out + w * v, total + w
        return out / total if scaled else out

    return run


def gaussian(sigma: float, planar: bool = False) -> Stencil:
    return kernel(lambda dz, dy, dx: float(np.exp(-(dz * dz + dy * dy + dx * dx) / (2 * sigma * sigma))), planar, True)


laplacian = kernel(lambda dz, dy, dx: -26.0 if dz == dy == dx == 0 else 1.0)
_smooth = (1.0, 2.0, 1.0)


def sobel(a: np.ndarray, r: int) -> np.ndarray:
    """Magnitude of three directional kernels: a difference along one axis, smoothed over the others."""
    parts = []
    for axis in range(3):
        parts.append(kernel(lambda *d, axis=axis: d[axis] * float(np.prod([_smooth[q + 1] for k, q in enumerate(d) if k != axis])))(a, 1))
    return np.sqrt(sum(p * p for p in parts))


def central_gradient(a: np.ndarray, r: int) -> np.ndarray:
    """Magnitude of half differences along each axis."""
    v = dict(shifts(a, 1))
    halves = [(v[p] - v[tuple(-q for q in p)]) / 2 for p in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    return np.sqrt(sum(h * h for h in halves))


def stop(value: float, value_falloff: float, grad_falloff: float) -> Stencil:
    """How freely growth passes: a Gaussian falloff of the gradient times that of the value below ``value``.

    Each falls off as exp(-d * d / falloff) and is cut off beyond 2.12 times
    the root of its falloff.  A gradient falloff of 0 leaves the gradient out;
    a value falloff of 0 passes values above ``value`` alone.
    """

    def run(a: np.ndarray, r: int) -> np.ndarray:
        v = core(a, r)
        out = np.ones_like(v)
        if grad_falloff > 0:
            grad = central_gradient(a, r)
            out = np.where(grad > np.sqrt(grad_falloff) * 2.12, 0.0, np.exp(-grad * grad / grad_falloff))
        below = np.zeros_like(v)
        if value_falloff > 0:
            below = np.where(v < value - np.sqrt(value_falloff) * 2.12, 0.0, np.exp(-((v - value) ** 2) / value_falloff))
        return out * np.where(v > value, 1.0, below)

    return run


def remove_background(spread: float, factor: float, factor2: float, planar: bool = False) -> Stencil:
    """0 where the sigma or the excess over the mean is small; the excess where it is large."""

    def run(a: np.ndarray, r: int) -> np.ndarray:
        views = np.stack([v for _, v in shifts(a, r, planar)])
        mean, sigma, v = views.mean(axis=0), views.std(axis=0), core(a, r)
        low = (sigma < spread) | (v - mean < sigma * factor)
        return np.where(low, 0.0, np.where(v - mean > sigma * factor2, v - mean, v))

    return run


def direction_erode(planar: bool) -> Stencil:
    """Least sample at radius r along the direction of each offset of the 3-neighbourhood."""

    def run(a: np.ndarray, r: int) -> np.ndarray:
        views, out = dict(shifts(a, r)), core(a, r)
        for d in [(z, y, x) for z in ([0] if planar else (-1, 0, 1)) for y in (-1, 0, 1) for x in (-1, 0, 1)]:
            length = float(np.sqrt(sum(q * q for q in d)))
            if length:
                out = np.minimum(out, views[tuple(int(np.floor(q / length * r + 0.5)) for q in d)])
        return out

    return run


def wiener(sigma: float, eps: float) -> Stencil:
    blur = gaussian(sigma)

    def run(a: np.ndarray, r: int) -> np.ndarray:
        b = blur(a, r)
        return core(a, r) * np.clip(b / (b * b + eps), 0, 2)

    return run


def richardson_lucy(blur: Stencil, eps: float) -> Stencil:
    """One step for a blur whose weights sum to one: the sample times its ratio to its blur.  Repeat by ``apply``."""

    def run(a: np.ndarray, r: int) -> np.ndarray:
        v = core(a, r)
        return v * (v / (blur(a, r) + eps))

    return run


#: Planes in which a sample's ring of eight neighbours is read: two directions (z, y, x) each.
RINGS = [((0, 0, 1), (0, 1, 0)), ((1, 0, 1), (0, 1, 0)), ((1, 0, 0), (0, 1, 0)), ((1, 0, -1), (0, 1, 0)), ((0, 0, 1), (1, 0, 0))]


def thin(level: float) -> Stencil:
    """Drops samples whose five rings each hold 3 to 7 neighbours of ``level`` or more, in one run; those below it too."""

    def run(a: np.ndarray, r: int) -> np.ndarray:
        views = dict(shifts(a, r))
        drop = np.ones(core(a, r).shape, bool)
        for p, q in RINGS:
            ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
            on = np.stack([views[tuple(i * u + j * w for u, w in zip(p, q, strict=True))] >= level for i, j in ring])
            starts = (on & ~np.roll(on, 1, axis=0)).sum(axis=0)
            count = on.sum(axis=0)
            drop &= (count > 2) & (count < 8) & (starts == 1)
        v = core(a, r)
        return np.where(drop | (v < level), 0.0, v)

    return run


def apply(vox: DataFrame, dims: tuple[int, int, int], radius: int, stencil: Stencil, repeat: int = 1, exact: bool = False) -> DataFrame:
    """t, c, z, y, x, v where the result is not zero; ``exact`` keeps it as a double in 0..1.

    ``dims`` is the grid (z, y, x).  Repeated rows of one position: the largest counts.
    """
    for _ in range(repeat):
        vox = _once(vox, dims, radius, stencil, exact)
    return vox


def _once(vox: DataFrame, dims, radius: int, stencil: Stencil, exact: bool) -> DataFrame:
    def bricks(axis: int, name: str):
        b, n = BRICK[axis], dims[axis]
        lo = F.greatest(F.lit(0), F.floor((F.col(name) - radius) / b)).cast("int")
        hi = F.least(F.lit((n - 1) // b), F.floor((F.col(name) + radius) / b)).cast("int")
        return F.explode(F.sequence(lo, hi)).alias(f"b{name}")

    rows = vox.where("v > 0").select("t", "c", "z", "y", "x", "v")
    for axis, name in enumerate("zyx"):
        rows = rows.select("*", bricks(axis, name))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, c, *at = key
        lo = [b * s for b, s in zip(at, BRICK, strict=True)]
        hi = [min(l + s, n) for l, s, n in zip(lo, BRICK, dims, strict=True)]
        edge = [(max(0, l - radius), min(n, h + radius)) for l, h, n in zip(lo, hi, dims, strict=True)]
        a = np.zeros([e - s for s, e in edge])
        where = tuple(pdf[k].to_numpy() - s for k, (s, _) in zip("zyx", edge, strict=True))
        np.maximum.at(a, where, pdf["v"].to_numpy() / (1.0 if exact and pdf["v"].dtype.kind == "f" else 255.0))
        pad = [(radius - (l - s), radius - (e - h)) for l, h, (s, e) in zip(lo, hi, edge, strict=True)]
        out = np.clip(stencil(np.pad(a, pad, mode="edge"), radius), 0, 1)
        out = np.round(out, 9) if exact else np.floor(out * 255 + 1e-6)
        z, y, x = np.nonzero(out)
        v = out[z, y, x]
        return pd.DataFrame({"t": t, "c": c, "z": z + lo[0], "y": y + lo[1], "x": x + lo[2], "v": v if exact else v.astype(int)})

    kind = "double" if exact else "int"
    return rows.groupBy("t", "c", "bz", "by", "bx").applyInPandas(run, f"t int, c int, z int, y int, x int, v {kind}")


def binarize(vox: DataFrame, level: int) -> DataFrame:
    return vox.withColumn("v", F.when(F.col("v") >= level, 255).otherwise(0))


def tile_stats(vox: DataFrame, tile: tuple[int, int, int]) -> DataFrame:
    """Mean and population sigma of each tile's samples in the table."""
    at = [F.floor(F.col(k) / s).cast("int").alias(f"b{k}") for k, s in zip("zyx", tile, strict=True)]
    return vox.groupBy("t", "c", *at).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sigma"))


def background(spread: float, factor: float) -> Stencil:
    """Samples whose in-plane surroundings are flat, or that are less than ``factor`` sigmas above their mean; others 0."""

    def run(a: np.ndarray, r: int) -> np.ndarray:
        parts = np.stack([v for _, v in shifts(a, r, True)])
        mean, sigma, v = parts.mean(axis=0), parts.std(axis=0), core(a, r)
        return np.where((sigma < spread) | (v - mean < sigma * factor), v, 0.0)

    return run
