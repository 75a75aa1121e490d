"""Per-component measurement: size, intensity, place, surface, contacts, neighbours."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

FACES = [(0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)]


def component_stats(vox: DataFrame, by: tuple[str, ...] = ("t", "c"), selected: bool = False, least: int = 0) -> DataFrame:
    """One row a component: count, sums, extremes, mean, population sigma, centre and box.

    Only samples above zero count; ``selected`` keeps masked ones; components below ``least`` samples go.
    """
    rows = vox.where("label <> 0 and v > 0" + (" and mask > 0" if selected else ""))
    sums = rows.groupBy(*by, "label").agg(
        F.count("*").alias("n"),
        F.sum("v").alias("total"),
        F.sum(F.col("v") * F.col("v")).alias("squares"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        *[F.sum(k).alias(f"s{k}") for k in "xyz"],
        *[f(k).alias(f"{n}_{k}") for k in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))],
    )
    n = F.col("n")
    sigma = F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("total") * F.col("total") / n) / n))
    out = sums.withColumn("mean", F.col("total") / n).withColumn("sigma", sigma)
    for k in "xyz":
        out = out.withColumn(f"c{k}", F.col(f"s{k}") / n)
    return out.where(n >= least).drop("squares", "sx", "sy", "sz")


def scaled(stats: DataFrame, spacing: tuple[float, float, float], intensity: float = 1.0) -> DataFrame:
    """Physical size, scaled intensity and spaced centre."""
    sx, sy, sz = spacing
    return stats.select("t", "c", "label", (F.col("n") * (sx * sy * sz)).alias("phys_size"), (F.col("total") * intensity).alias("phys_total"), (F.col("cx") * sx).alias("px"), (F.col("cy") * sy).alias("py"), (F.col("cz") * sz).alias("pz"))


def face_neighbours(vox: DataFrame) -> DataFrame:
    """t, c, label, v of each labelled sample beside each of its six faces: nl and nv (null outside the table).

    One equi-join: each labelled sample is dealt to the six positions that see it.
    """
    own = vox.where("label <> 0 and v > 0").select("t", "c", "z", "y", "x", "label", "v")
    offsets = F.explode(F.array(*[F.struct(*[F.lit(d).alias(k) for d, k in zip(f, ("dz", "dy", "dx"), strict=True)]) for f in FACES]))
    seen = own.withColumn("o", offsets).select("t", "c", *[(F.col(k) + F.col(f"o.d{k}")).alias(k) for k in "zyx"], *[F.col(k).alias(f"o{k}") for k in "zyx"], "label", "v")
    other = own.select("t", "c", "z", "y", "x", F.col("label").alias("nl"), F.col("v").alias("nv"))
    return seen.join(other, ["t", "c", "z", "y", "x"], "left")


def surface(vox: DataFrame) -> DataFrame:
    """Surface samples of each component and their sum: those that lack a neighbour of their own label on some face."""
    sides = face_neighbours(vox).groupBy("t", "c", "oz", "oy", "ox", "label", "v").agg(F.count_if(F.col("nl") == F.col("label")).alias("same"))
    return sides.groupBy("t", "c", "label").agg(F.count_if(F.col("same") < 6).alias("n_surface"), F.sum(F.when(F.col("same") < 6, F.col("v")).otherwise(0)).alias("total_surface"))


def contacts(vox: DataFrame, level: float = 0.6) -> DataFrame:
    """t, c, a < b: faces shared by two components whose smaller sample is above ``level`` of full scale.

    Each face is seen from both sides, so counts and sums are doubled.
    """
    f = face_neighbours(vox).where((F.col("nl") != F.col("label")) & (F.least("v", "nv") > level * 255))
    return f.groupBy("t", "c", F.least("label", "nl").alias("a"), F.greatest("label", "nl").alias("b")).agg(F.count("*").alias("n"), F.sum(F.least("v", "nv")).alias("total"))


def channel_overlap(vox: DataFrame) -> DataFrame:
    """For each component and other channel, count and sum of the other's samples above zero under it."""
    own = vox.where("label <> 0 and v > 0").select("t", "z", "y", "x", "c", "label")
    other = vox.where("v > 0").select("t", "z", "y", "x", F.col("c").alias("other"), F.col("v").alias("ov"))
    return own.join(other, ["t", "z", "y", "x"]).where("c <> other").groupBy("t", "c", "label", "other").agg(F.count("*").alias("n"), F.sum("ov").alias("total"))


def size_filter(stats: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Components strictly above ``low`` and strictly below ``high``; either may be open."""
    if low is not None:
        stats = stats.where(F.col("n") > low)
    return stats if high is None else stats.where(F.col("n") < high)


def touched(vox: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """All samples of the components that the mask touches: their mask becomes full, others' empty.

    With bounds, only components strictly between them count (samples above zero).
    """
    hit = vox.where("mask > 0 and label <> 0").select("t", "c", "label").distinct().withColumn("hit", F.lit(255))
    if low is not None or high is not None:
        hit = hit.join(size_filter(component_stats(vox), low, high).select("t", "c", "label"), ["t", "c", "label"], "left_semi")
    return vox.drop("mask").join(hit, ["t", "c", "label"], "left").withColumn("mask", F.coalesce("hit", F.lit(0))).drop("hit")


def component_pairs(stats: DataFrame) -> DataFrame:
    """t, c, a, b, dist: the distance matrix of each frame and channel, both ways; its size is the square of the components."""
    a, b = _ends(stats)
    return a.join(b, ["t", "c"]).where("a <> b").select("t", "c", "a", "b", _apart().alias("dist"))


def _ends(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(stats.select("t", "c", F.col("label").alias(n), *[F.col(f"c{q}").alias(f"{n}{q}") for q in "xyz"]) for n in "ab")


def _apart() -> Column:
    return F.round(F.sqrt(sum((F.pow(F.col(f"a{q}") - F.col(f"b{q}"), 2) for q in "xyz"), F.lit(0.0))), 6)


def nearest_components(stats: DataFrame, k: int, reach: float | None = None) -> DataFrame:
    """t, c, a, b, dist, rank: the k nearest other components by centre, within each frame and channel; of equals the smallest labels.

    A component meets those of the 27 grid cells around it, of side ``reach``
    (from the components' density where it is not given).  It is settled when
    k of them are no farther than the side, since none outside can be nearer;
    the others go on with cells of twice the side, until a cell spans all.
    """
    key = ["t", "c", "a"]
    stats = cut(stats.select("t", "c", "label", "cx", "cy", "cz"))
    ends = stats.groupBy("t", "c").agg(F.count("*").alias("n"), *[f(f"c{q}").alias(f"{m}{q}") for q in "xyz" for f, m in ((F.min, "lo"), (F.max, "hi"))])
    wide = F.greatest(*[F.col(f"hi{q}") - F.col(f"lo{q}") for q in "xyz"])
    top = ends.agg(F.max(wide).alias("wide"), F.max("n").alias("n")).first()
    if top["n"] is None or top["n"] < 2:
        return component_pairs(stats).withColumn("rank", F.lit(1)).limit(0)
    side = reach or max(1e-6, top["wide"] * min(1.0, (2.0 * (k + 1) / top["n"]) ** (1 / 3)))
    open_a, b = _ends(stats)
    near = F.explode(F.array(*[F.struct(*[F.lit(q).alias(n) for q, n in zip(d, "xyz", strict=True)]) for d in product((-1, 0, 1), repeat=3)])).alias("o")
    done = []
    while True:
        last = side > top["wide"]
        cell = lambda n: [F.floor(F.col(f"{n}{q}") / side).cast("long").alias(f"g{q}") for q in "xyz"]  # noqa: B023, E731
        seen = open_a.select("*", *cell("a"), near).select("t", "c", "a", *[f"a{q}" for q in "xyz"], *[(F.col(f"g{q}") + F.col(f"o.{q}")).alias(f"g{q}") for q in "xyz"])
        pairs = seen.join(b.select("*", *cell("b")), ["t", "c", "gx", "gy", "gz"]).where("a <> b").select(*key, "b", _apart().alias("dist"))
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("dist", "b"))
        best = cut(pairs.withColumn("rank", rank).where(F.col("rank") <= k))
        if last:
            done.append(best)
            break
        settled = best.where((F.col("rank") == k) & (F.col("dist") <= side)).select(*key)
        done.append(best.join(settled, key, "left_semi"))
        open_a = cut(open_a.join(settled, key, "left_anti"))
        if open_a.isEmpty():
            break
        side *= 2
    return reduce(DataFrame.unionByName, done)


def size_colour(stats: DataFrame) -> DataFrame:
    """(size - min) / (max - min) over all components; 1 when all are equal."""
    ends = stats.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # One row.
    return stats.crossJoin(F.broadcast(ends)).select("t", "c", "label", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("n") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("shade"))


def near_neighbours(vox: DataFrame, reach: int) -> DataFrame:
    """t, c, a < b, dist: smallest distance between samples of two components, where it is ``reach`` or less.

    Only surface samples take part.  Each is dealt to the offsets in reach, so
    the join is an equi-join whatever the number of components.
    """
    key = ["t", "c", "z", "y", "x"]
    sides = face_neighbours(vox).groupBy("t", "c", *[F.col(f"o{k}").alias(k) for k in "zyx"], "label").agg(F.count_if(F.col("nl") == F.col("label")).alias("same"))
    rim = sides.where("same < 6").select(*key, "label")
    span = range(-reach, reach + 1)
    offsets = [(z, y, x) for z in span for y in span for x in span if (0, 0, 0) < (z, y, x) and z * z + y * y + x * x <= reach * reach]
    o = F.explode(F.array(*[F.struct(*[F.lit(d).alias(k) for d, k in zip(f, "zyx", strict=True)], F.lit(sum(d * d for d in f)).alias("d2")) for f in offsets]))
    seen = rim.withColumn("o", o).select("t", "c", *[(F.col(k) + F.col(f"o.{k}")).alias(k) for k in "zyx"], F.col("label").alias("l1"), "o.d2")
    pairs = seen.join(rim.withColumnRenamed("label", "l2"), key).where("l1 <> l2")
    best = pairs.groupBy("t", "c", F.least("l1", "l2").alias("a"), F.greatest("l1", "l2").alias("b")).agg(F.min("d2").alias("d2"))
    return best.select("t", "c", "a", "b", F.sqrt("d2").alias("dist"))


def distance_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """t, c, a, b, dist, same: pairs of components marked by whether both are in one group (t, c, label, grp)."""
    a = groups.select("t", "c", F.col("label").alias("a"), F.col("grp").alias("ga"))
    b = groups.select("t", "c", F.col("label").alias("b"), F.col("grp").alias("gb"))
    return pairs.join(a, ["t", "c", "a"]).join(b, ["t", "c", "b"]).withColumn("same", F.col("ga").eqNullSafe(F.col("gb"))).drop("ga", "gb")
