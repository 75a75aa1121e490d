"""Text exports: component tables, report rows, series lines, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import label_colour


def component_lines(stats: DataFrame) -> DataFrame:
    """One tab-separated line a component, in a stated order of columns."""
    cols = ["label", "n", "total", "least", "most", "lo_x", "hi_x", "lo_y", "hi_y", "lo_z", "hi_z"]
    return stats.select("t", "c", "label", F.concat_ws("\t", *[F.col(k).cast("string") for k in cols]).alias("line"))


def report_values(local: DataFrame, background: DataFrame) -> DataFrame:
    """obj, t, value: the object's own value, else the last background value up to that frame, else 0.

    Every object meets every frame of the background (t, bg), which has one row a frame.
    """
    w = Window.partitionBy("obj").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    grid = local.select("obj").distinct().crossJoin(background.select("t", "bg"))
    j = grid.join(local, ["obj", "t"], "left")
    return j.select("obj", "t", F.coalesce("v", F.last("bg", True).over(w), F.lit(0)).alias("value"))


def series_lines(series: DataFrame) -> DataFrame:
    """roi and its values joined in frame order; a series is one line, so it is one group."""
    rows = series.groupBy("roi").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    return rows.select("roi", F.array_join(F.transform("s", lambda r: r["v"].cast("string")), ", ").alias("line"))


def profile_lines(profile: DataFrame) -> DataFrame:
    """bin, value: accumulated over pixels, 0.0 where there are none."""
    return profile.select("bin", F.when(F.col("pixels") > 0, F.col("accum") / F.col("pixels")).otherwise(0.0).alias("value"))


def distance_lines(pairs: DataFrame) -> DataFrame:
    """t, c, a, line: a component's distances to the others of its frame in label order, tab-separated, 0.0 to itself."""
    own = pairs.select("t", "c", "a", F.col("a").alias("b"), F.lit(0.0).alias("dist")).distinct()
    rows = pairs.select("t", "c", "a", "b", "dist").unionByName(own).groupBy("t", "c", "a").agg(F.array_sort(F.collect_list(F.struct("b", "dist"))).alias("s"))
    return rows.select("t", "c", "a", F.array_join(F.transform("s", lambda r: F.format_string("%.6f", r["dist"])), "\t").alias("line"))


def component_channels(vox: DataFrame) -> DataFrame:
    """Samples of components with a channel for each component of a frame and channel, numbered from 0 by label."""
    rows = vox.where("label <> 0 and v > 0")
    names = rows.select("t", "c", "label").distinct()
    names = names.withColumn("channel", (F.row_number().over(Window.partitionBy("t", "c").orderBy("label")) - 1).cast("int"))
    return rows.join(names, ["t", "c", "label"]).select("t", "c", "channel", "z", "y", "x", "v")


def rgb_channels(vox: DataFrame) -> DataFrame:
    """Samples of components as three channels (0 red, 1 green, 2 blue), coloured by label."""
    rows = vox.where("label <> 0 and v > 0")
    parts = F.array(*[F.struct(F.lit(k).alias("channel"), F.floor(q * F.col("v") + F.lit(0.5 + 1e-9)).cast("int").alias("shade")) for k, q in enumerate(label_colour(F.col("label")))])
    return rows.select("t", "c", "z", "y", "x", F.inline(parts)).where("shade > 0")


def annotation_rows(stats: DataFrame) -> DataFrame:
    """t, c, label, text, x, y, z: a label's text at the centre of each component."""
    return stats.select("t", "c", "label", F.format_string("ID%d", "label").alias("text"), *[F.col(f"c{k}").alias(k) for k in "xyz"])


def report(rows: DataFrame, template: str, begin: str = "#begin data", end: str = "#end") -> str:
    """``template`` with the text between the marks replaced by one line a row (id, t, value), in order of id and frame.

    The page is a text for people, so its rows come to the driver one at a time.
    """
    head, rest = template.split(begin, 1)
    tail = rest.split(end, 1)[1]
    lines = (f"ID-{r['obj']},{r['t']},{r['value']}\\n\\" for r in rows.orderBy("obj", "t").toLocalIterator())
    return "\n".join([head + begin, *lines, end + tail])


def coordinate_lines(points: DataFrame, dim: int = 3) -> DataFrame:
    """ruler, axis, line: one line for t and each axis, values in frame order; two dimensions leave z out."""
    axes = ["t", "x", "y", *(["z"] if dim in (0, 3) else [])]
    rows = points.groupBy("ruler").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y", "z"))).alias("s"))
    line = lambda k: F.array_join(F.transform("s", lambda r: r[k].cast("string")), ",")
    return rows.select("ruler", F.inline(F.array(*[F.struct(F.lit(k).alias("axis"), line(k).alias("line")) for k in axes])))
