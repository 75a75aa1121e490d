"""Rulers (ruler, t, x, y, z; t numbers the points): nearest points, projection, frames, averages, pruning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT = ("x", "y", "z")


def centres(points: DataFrame) -> DataFrame:
    """ruler, x, y, z: the mean of each ruler's points."""
    return points.groupBy("ruler").agg(*[F.avg(k).alias(k) for k in AT])


def average(points: DataFrame) -> DataFrame:
    """One row: the mean of the rulers' centres."""
    return centres(points).agg(*[F.avg(k).alias(k) for k in AT])


def distance_to(place: tuple[float, float, float]) -> Column:
    """Distance of x, y, z from a place."""
    return F.sqrt(sum((F.pow(F.col(k) - float(v), 2) for k, v in zip(AT, place, strict=True)), F.lit(0.0)))


def nearest_points(points: DataFrame, places: list[tuple[float, float, float]]) -> DataFrame:
    """place, ruler, t, dist: the nearest ruler point of each stated place; of equals the last ruler, then point.

    The places are a stated list; one pass with partial aggregates, nothing but their best points is shuffled.
    """
    rows = points.select("ruler", "t", F.posexplode(F.array(*[distance_to(p) for p in places])).alias("place", "dist"))
    best = rows.groupBy("place").agg(F.min(F.struct(F.round("dist", 9).alias("dist"), (-F.col("ruler")).alias("r"), (-F.col("t")).alias("s"))).alias("b"))
    return best.select("place", (-F.col("b.r")).alias("ruler"), (-F.col("b.s")).alias("t"), F.col("b.dist").alias("dist"))


def component_distances(stats: DataFrame, points: DataFrame, rulers: list[int]) -> DataFrame:
    """t, c, label, ruler, dist: distance of each component's centre from the centre of each stated ruler."""
    found = {r["ruler"]: tuple(r[k] for k in AT) for r in centres(points.where(F.col("ruler").isin(rulers))).collect()}
    if not found:
        return stats.select("t", "c", "label", F.lit(None).cast("long").alias("ruler"), F.lit(None).cast("double").alias("dist")).limit(0)
    here = stats.select("t", "c", "label", *[F.col(f"c{k}").alias(k) for k in AT])
    pairs = F.array(*[F.struct(F.lit(r).cast("long").alias("ruler"), distance_to(p).alias("dist")) for r, p in sorted(found.items())])
    return here.select("t", "c", "label", F.inline(pairs))


def projected(rows: DataFrame, line: list[tuple[float, float, float]]) -> DataFrame:
    """``rows`` (x, y, z) with along, across and segment of a stated polyline.

    The segment is the one whose middle is nearest (of equals the first);
    ``along`` counts from the polyline's start, ``across`` is the distance from the segment's axis.
    """
    p = np.asarray(line, float)
    start = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
    parts = []
    for i, (a, b) in enumerate(zip(p[:-1], p[1:], strict=True)):
        axis = (b - a) / (np.linalg.norm(b - a) or 1.0)
        dot = sum(((F.col(k) - float(q)) * float(u) for k, q, u in zip(AT, a, axis, strict=True)), F.lit(0.0))
        across = F.sqrt(F.greatest(F.lit(0.0), F.pow(distance_to(tuple(a)), 2) - dot * dot))
        parts.append(F.struct(F.round(distance_to(tuple((a + b) / 2)), 9).alias("far"), F.lit(i).alias("segment"), (dot + float(start[i])).alias("along"), across.alias("across")))
    best = F.array_min(F.array(*parts))
    return rows.withColumn("_b", best).select("*", "_b.along", "_b.across", "_b.segment").drop("_b")


def frame_of(first: tuple, second: tuple, length: float, dim: int = 3) -> np.ndarray:
    """3 x 4: origin and scaled axes of the frame that a reference ruler of physical ``length`` spans."""
    o, p = np.array(first, float), np.array(second, float)
    if dim < 3:
        o[2] = p[2] = 0.0
    far = float(np.linalg.norm(p - o))
    if far == 0:
        raise ValueError("the reference ruler has no length")
    vx = (p - o) / far
    flat = np.array([vx[0], 0.0, vx[2]])
    if np.linalg.norm(flat) > 0:
        vz = np.cross(vx, flat)
        vz = vz / (np.linalg.norm(vz) or 1.0)
        vy = np.cross(vz, vx)
    else:
        vy, vz = np.array([1.0, 0.0, 0.0]), np.array([0.0, 0.0, -1.0])
    return np.column_stack([np.stack([vx, vy, vz], 1) * (length / far), o])


def transformed(points: DataFrame, reference: int, length: float, dim: int = 3) -> DataFrame:
    """Points carried by the frame of the ruler ``reference`` (its first two points); two dimensions drop z."""
    ends = points.where(F.col("ruler") == reference).orderBy("t").select(*AT).limit(2).collect()
    if len(ends) < 2:
        raise ValueError(f"ruler {reference} has fewer than two points")
    m = frame_of(tuple(ends[0]), tuple(ends[1]), length, dim)
    z = F.lit(0.0) if dim < 3 else F.col("z")
    return points.select("ruler", "t", *[(F.col("x") * float(r[0]) + F.col("y") * float(r[1]) + z * float(r[2]) + float(r[3])).alias(k) for k, r in zip(AT, m, strict=True)])


def scaled(points: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    return points.select("ruler", "t", *[(F.col(k) * float(s)).alias(k) for k, s in zip(AT, spacing, strict=True)])


def reversed_points(points: DataFrame) -> DataFrame:
    """Points in opposite order, numbered from 0."""
    nth = F.row_number().over(Window.partitionBy("ruler").orderBy(F.desc("t"))) - 1
    return points.withColumn("t", nth.cast("int"))


def pruned(points: DataFrame, length: int) -> DataFrame:
    """Points without the branches (``branch`` above 0) that have ``length`` + 1 points or fewer; branch 0 stays."""
    n = F.count("*").over(Window.partitionBy("ruler", "branch"))
    return points.withColumn("_n", n).where((F.col("branch") == 0) | (F.col("_n") > length + 1)).drop("_n")


def point_text(points: DataFrame) -> DataFrame:
    """ruler, line: coordinates of all points in order, tab-separated."""
    one = F.concat_ws("\t", *AT)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", one.alias("s")))), lambda q: q["s"]), "\t")
    return points.groupBy("ruler").agg(line.alias("line"))


def through_components(stats: DataFrame) -> DataFrame:
    """t, c, point, x, y, z: the polyline through the centres of a frame's components, by label; three at least."""
    frame = Window.partitionBy("t", "c")
    rows = stats.withColumn("_n", F.count("*").over(frame)).where("_n >= 3")
    nth = F.row_number().over(frame.orderBy("label")) - 1
    return rows.select("t", "c", nth.cast("int").alias("point"), *[F.col(f"c{k}").alias(k) for k in AT])


def profile_peak(profile: DataFrame, value: str, at: str) -> DataFrame:
    """ruler, value and place of the largest value; of equals the first."""
    best = profile.groupBy("ruler").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(at)).alias("p"))).alias("b"))
    return best.select("ruler", F.col("b.v").alias(value), (-F.col("b.p")).alias(at))
