"""Masked statistics, exact histograms, order statistics and colocalization."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .algebra import POSITION


def basic(vox: DataFrame, by: list[str]) -> DataFrame:
    """Counts, sums and extremes of samples above zero, of these inside the mask, and the mask's own count and sum."""
    on, masked = F.col("v") > 0, (F.col("v") > 0) & (F.col("mask") > 0)
    return vox.groupBy(*by).agg(
        F.count_if(on).alias("n"),
        F.sum(F.when(on, F.col("v")).otherwise(0)).alias("total"),
        F.count_if(masked).alias("n_masked"),
        F.sum(F.when(masked, F.col("v")).otherwise(0)).alias("total_masked"),
        F.min(F.when(on, F.col("v"))).alias("least"),
        F.max("v").alias("most"),
        F.count_if(F.col("mask") > 0).alias("mask_voxels"),
        F.sum(F.when(F.col("mask") > 0, F.col("v")).otherwise(0)).alias("mask_total"),
    )


def integer_histogram(vox: DataFrame, by: list[str]) -> DataFrame:
    """Exact counts of each value above zero."""
    return vox.where("v > 0").groupBy(*by, "v").agg(F.count("*").alias("n"))


def order_statistics(vox: DataFrame, by: list[str]) -> DataFrame:
    """Median (first value whose cumulative count reaches half the count, rounded down) and mode (smallest of the commonest).

    Works on the histogram, at most one row a value, so windows stay small.
    """
    h = integer_histogram(vox, by)
    w = Window.partitionBy(*by)
    h = h.withColumn("below", F.sum("n").over(w.orderBy("v"))).withColumn("all", F.sum("n").over(w))
    h = h.withColumn("top", F.max("n").over(w))
    return h.groupBy(*by).agg(
        F.min(F.when(F.col("below") >= F.floor(F.col("all") / 2), F.col("v"))).alias("median"),
        F.min(F.when(F.col("n") == F.col("top"), F.col("v"))).alias("mode"),
    )


def binned_histogram(vox: DataFrame, by: list[str], bins: int, lo: int = 0, hi: int = 255) -> DataFrame:
    """Counts in ``bins`` bins scaled by bins - 1, so the last holds only ``hi``; ``share`` of all samples."""
    b = F.floor((F.col("v") - lo) * (bins - 1) / (hi - lo)).cast("int")
    h = vox.where(F.col("v").between(lo, hi)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def ellipse_mean(vox: DataFrame, by: list[str], centre: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> DataFrame:
    """Mean and count of samples above zero whose centre lies in the ellipse with half axes ``a`` and ``b``."""
    px, py = F.col("x") + 0.5 - centre[0], F.col("y") + 0.5 - centre[1]
    along = lambda v: F.pow((px * v[0] + py * v[1]) / (v[0] ** 2 + v[1] ** 2), 2)
    return vox.where((F.col("v") > 0) & (along(a) + along(b) <= 1)).groupBy(*by).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def colocalization(vox: DataFrame, lo: int = 64, hi: int = 255) -> DataFrame:
    """t, c1, c2 and all pairwise measures, masked and not: one self-join on position.

    Thresholds are half-open (lo, hi]; the weighted threshold sums the first
    channel only, so it is not symmetric.  Positions hold at most one row a channel.
    """
    a = vox.where("v > 0").select(*POSITION, F.col("c").alias("c1"), F.col("v").alias("v1"), F.col("mask").alias("m1"))
    b = vox.where("v > 0").select(*POSITION, F.col("c").alias("c2"), F.col("v").alias("v2"), F.col("mask").alias("m2"))
    j = a.join(b, POSITION)
    inside = (F.col("v1") > lo) & (F.col("v1") <= hi) & (F.col("v2") > lo) & (F.col("v2") <= hi)
    masked = (F.col("m1") > 0) & (F.col("m2") > 0)
    return j.groupBy("t", "c1", "c2").agg(
        F.sum(F.col("v1") * F.col("v2")).alias("dot"),
        F.count("*").alias("n"),
        F.sum(F.least("v1", "v2")).alias("least_sum"),
        F.count_if(inside).alias("inside"),
        F.sum(F.when(inside, F.col("v1")).otherwise(0)).alias("inside_sum"),
        F.count_if(masked).alias("n_masked"),
        F.sum(F.when(masked, F.col("v1") * F.col("v2")).otherwise(0)).alias("dot_masked"),
    )


def ratio_matrix(pairs: DataFrame, measure: str) -> DataFrame:
    """100 * m[i][j] / m[i][i]; 0 where m[j][j] is 0, or where m[i][i] is."""
    own = pairs.where("c1 = c2")
    left = own.select("t", "c1", F.col(measure).alias("mii"))
    right = own.select("t", "c2", F.col(measure).alias("mjj"))
    j = pairs.join(left, ["t", "c1"], "left").join(right, ["t", "c2"], "left")
    ok = (F.coalesce("mjj", F.lit(0)) != 0) & (F.coalesce("mii", F.lit(0)) != 0)
    return j.select("t", "c1", "c2", F.when(ok, 100.0 * F.col(measure) / F.col("mii")).otherwise(0.0).alias("ratio"))


def physical_matrix(pairs: DataFrame, measure: str, spacing: tuple[float, float, float]) -> DataFrame:
    """t, c1, c2, volume: a count of samples in units of ``spacing``."""
    x, y, z = spacing
    return pairs.select("t", "c1", "c2", (F.col(measure) * float(x * y * z)).alias("volume"))


def scatter(vox: DataFrame, by: list[str], level: int = 1) -> DataFrame:
    """Mean position of masked samples, and the sums of products about it (not divided by the count)."""
    rows = vox.where(F.col("mask") >= level)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(k).alias(f"m{k}") for k in "xyz"],
        *[(F.covar_pop(a, b) * F.count("*")).alias(f"s{a}{b}") for a, b in pairs],
    )


def principal_lengths(scatters: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``scatters`` (see ``scatter``) with e1 >= e2 >= e3, the eigenvalues of the products' matrix in units of ``spacing`` (x, y, z).

    The closed form for symmetric matrices of three rows, all in expressions.
    """
    size = dict(zip("xyz", spacing, strict=True))
    m = {a + b: F.col(f"s{a}{b}") * float(size[a] * size[b]) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    off = m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"]
    q = (m["xx"] + m["yy"] + m["zz"]) / 3
    d = {k: m[k + k] - q for k in "xyz"}
    p = F.sqrt((sum((d[k] * d[k] for k in "xyz"), F.lit(0.0)) + 2 * off) / 6)
    det = d["x"] * (d["y"] * d["z"] - m["yz"] * m["yz"]) - m["xy"] * (m["xy"] * d["z"] - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - d["y"] * m["xz"])
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))) / 3
    round_ = p == 0
    rows = scatters.withColumn("_q", q).withColumn("_p", p).withColumn("_a", F.when(round_, 0.0).otherwise(turn))
    out = rows.withColumn("e1", F.col("_q") + 2 * F.col("_p") * F.cos("_a"))
    out = out.withColumn("e3", F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_a") + 2 * math.pi / 3))
    return out.withColumn("e2", 3 * F.col("_q") - F.col("e1") - F.col("e3")).drop("_q", "_p", "_a")


def results(vox: DataFrame, by: list[str]) -> DataFrame:
    """Count, sum and mean of samples above zero as a task reads them: floats, and whole numbers rounded half up."""
    rows = basic(vox, by).select(*by, "n", "total")
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0)
    return rows.select(*by, "n", F.col("total").cast("double").alias("total_f"), "total", mean.alias("mean_f"), F.floor(mean + 0.5).cast("long").alias("mean_i"))


def bounds(vox: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box of the mask."""
    return vox.where("mask > 0").groupBy(*by).agg(*[f(k).alias(f"{n}_{k}") for k in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])


def box_face_counts(vox: DataFrame, by: list[str], lo: int, hi: int) -> DataFrame:
    """Masked samples on the two faces of a box along x."""
    return vox.groupBy(*by).agg(F.count_if((F.col("mask") > 0) & F.col("x").isin(lo, hi)).alias("n"))


def record_summary(records: DataFrame) -> DataFrame:
    """key, most, population: the largest value of each named parameter, and the mean population of all records (population, params map)."""
    sizes = records.agg(F.avg("population").alias("population"))
    most = records.select(F.explode("params").alias("key", "value")).groupBy("key").agg(F.max("value").alias("most"))
    # One row.
    return most.crossJoin(F.broadcast(sizes))
