"""Links between frames, their selection, and tracked identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected


def frame_links(vox: DataFrame, least: int = 0) -> DataFrame:
    """t, c, v1, v2: overlap of components of frame t and t + 1: samples, sum of smaller values, centre distance."""
    rows = vox.where("label <> 0 and v > 0").select("t", "c", "z", "y", "x", "label", "v")
    sizes = rows.groupBy("t", "c", "label").agg(F.count("*").alias("size"), *[F.avg(k).alias(f"m{k}") for k in "xyz"]).where(F.col("size") >= least)
    nxt = rows.select((F.col("t") - 1).alias("t"), "c", "z", "y", "x", F.col("label").alias("v2"), F.col("v").alias("w2"))
    j = rows.join(nxt, ["t", "c", "z", "y", "x"]).groupBy("t", "c", F.col("label").alias("v1"), "v2").agg(F.count("*").alias("n"), F.sum(F.least("v", "w2")).alias("total"))
    a = sizes.select("t", "c", F.col("label").alias("v1"), *[F.col(f"m{k}").alias(f"a{k}") for k in "xyz"])
    b = sizes.select((F.col("t") - 1).alias("t"), "c", F.col("label").alias("v2"), *[F.col(f"m{k}").alias(f"b{k}") for k in "xyz"])
    d = F.sqrt(sum((F.pow(F.col(f"a{k}") - F.col(f"b{k}"), 2) for k in "xyz"), F.lit(0.0)))
    return j.join(a, ["t", "c", "v1"]).join(b, ["t", "c", "v2"]).select("t", "c", "v1", "v2", "n", "total", F.round(d, 6).alias("dist"))


def ranked_links(links: DataFrame) -> DataFrame:
    """Links of each component of frame t, by overlap sum, largest first."""
    w = Window.partitionBy("t", "c", "v1").orderBy(F.desc("total"), F.desc("n"), "v2")
    return links.withColumn("rank", F.row_number().over(w))


def best_links(links: DataFrame, similarity: float = 0.2) -> DataFrame:
    """``linked``: the largest overlap of each component, and those that differ from it by less than ``similarity`` of it."""
    top = F.max("total").over(Window.partitionBy("t", "c", "v1"))
    return links.withColumn("linked", (top - F.col("total")) < F.lit(similarity) * top)


def trimmed_links(links: DataFrame, similarity: float = 0.2) -> DataFrame:
    """``kept``: links in falling order up to the first that is not similar to the largest."""
    r = best_links(ranked_links(links), similarity)
    first = F.min(F.when(~F.col("linked"), F.col("rank"))).over(Window.partitionBy("t", "c", "v1"))
    return r.withColumn("kept", first.isNull() | (F.col("rank") < first)).drop("linked")


def valences(vox: DataFrame, links: DataFrame, least: int = 25) -> DataFrame:
    """Components of ``least`` samples or more with the numbers of their links forward and back."""
    v = vox.where("label <> 0 and v > 0").groupBy("t", "c", "label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    out = links.groupBy("t", "c", F.col("v1").alias("label")).agg(F.count("*").alias("n_out"))
    back = links.groupBy((F.col("t") + 1).alias("t"), "c", F.col("v2").alias("label")).agg(F.count("*").alias("n_in"))
    return v.join(out, ["t", "c", "label"], "left").join(back, ["t", "c", "label"], "left").na.fill(0, ["n_out", "n_in"])


def link_report(valence: DataFrame) -> DataFrame:
    """Per frame and channel, components without and with several links back (not in the first frame) and forward (not in the last)."""
    ends = valence.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    # One row.
    v = valence.crossJoin(F.broadcast(ends))
    inner, outer = F.col("t") > F.col("t0"), F.col("t") < F.col("t1")
    return v.groupBy("t", "c").agg(
        F.count_if(inner & (F.col("n_in") == 0)).alias("orphans_in"),
        F.count_if(inner & (F.col("n_in") > 1)).alias("multi_in"),
        F.count_if(outer & (F.col("n_out") == 0)).alias("orphans_out"),
        F.count_if(outer & (F.col("n_out") > 1)).alias("multi_out"),
    )


def merge_candidates(links: DataFrame, contacts: DataFrame, stats: DataFrame, level: float = 0.6) -> DataFrame:
    """Pairs of frame t + 1 that one component of frame t overlaps and whose contact is large against either's size."""
    l = links.select((F.col("t") + 1).alias("t"), "c", "v1", "v2")
    pairs = l.select("t", "c", "v1", F.col("v2").alias("a")).join(l.select("t", "c", "v1", F.col("v2").alias("b")), ["t", "c", "v1"]).where("a < b")
    pairs = pairs.select("t", "c", "a", "b").distinct().join(contacts.select("t", "c", "a", "b", F.col("n").alias("faces")), ["t", "c", "a", "b"])
    sa = stats.select("t", "c", F.col("label").alias("a"), F.col("n").alias("na"))
    sb = stats.select("t", "c", F.col("label").alias("b"), F.col("n").alias("nb"))
    out = pairs.join(sa, ["t", "c", "a"]).join(sb, ["t", "c", "b"])
    return out.where(F.col("faces") / F.least("na", "nb") > level).select("t", "c", "a", "b", "faces")


def contact_bins(candidates: DataFrame) -> DataFrame:
    """t, c, label, bin: components that merging candidates (t, c, a, b) join, directly or over others; named by the smallest label."""
    node = lambda k: F.struct("t", "c", F.col(k).alias("label")).alias(k)
    found = connected(candidates.select(node("a"), node("b")))
    return found.select("node.t", "node.c", "node.label", F.col("root.label").alias("bin"))


def vertex_links(stats: DataFrame, links: DataFrame, similarity: float = 0.2) -> DataFrame:
    """t, c, v1, v2, rule: each component's links to the next frame once its vertex has been settled.

    ``size``: a vertex with several links keeps the largest and those similar
    to it; a single link stays.  ``orphan``: one without any is linked to the
    nearest unlinked component of the next frame, if similar and touching.
    """
    kept = trimmed_links(links, similarity).where("kept").select("t", "c", "v1", "v2", F.lit("size").alias("rule"))
    lone = orphan_links(stats, links, similarity).select("t", "c", "v1", "v2", F.lit("orphan").alias("rule"))
    return kept.unionByName(lone)


def mapped_edges(links: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """The links that join a component of the former selection to one of the present (t, c, label), in the frame after it."""
    a = before.select("t", "c", F.col("label").alias("v1")).distinct()
    b = now.select((F.col("t") - 1).cast("int").alias("t"), "c", F.col("label").alias("v2")).distinct()
    return links.join(a, ["t", "c", "v1"], "left_semi").join(b, ["t", "c", "v2"], "left_semi")


def tracks(links: DataFrame, similarity: float = 0.2) -> DataFrame:
    """t, c, label, track: components joined by their best links; the track is named by its first member."""
    best = trimmed_links(links, similarity).where("kept and rank = 1")
    name = lambda t, v: F.concat_ws("/", F.col("c"), F.lpad(t.cast("string"), 6, "0"), F.lpad(F.col(v).cast("string"), 12, "0"))
    found = connected(best.select(name(F.col("t"), "v1").alias("a"), name(F.col("t") + 1, "v2").alias("b")))
    part = F.split("node", "/")
    return found.select(part[1].cast("int").alias("t"), part[0].cast("int").alias("c"), part[2].cast("long").alias("label"), F.col("root").alias("track"))


def orphan_links(stats: DataFrame, links: DataFrame, similarity: float = 0.2) -> DataFrame:
    """For components without a link forward, the nearest unlinked one of the next frame, if of similar size and touching boxes.

    Pairs form inside one frame and channel, where components are few by nature.
    """
    free = stats.join(links.select("t", "c", F.col("v1").alias("label")).distinct(), ["t", "c", "label"], "left_anti")
    back = stats.join(links.select((F.col("t") + 1).alias("t"), "c", F.col("v2").alias("label")).distinct(), ["t", "c", "label"], "left_anti")
    cols = ["n", "cx", "cy", "cz", "lo_x", "hi_x", "lo_y", "hi_y", "lo_z", "hi_z"]
    a = free.select("t", "c", F.col("label").alias("v1"), *[F.col(k).alias(f"a_{k}") for k in cols])
    b = back.select((F.col("t") - 1).alias("t"), "c", F.col("label").alias("v2"), *[F.col(k).alias(f"b_{k}") for k in cols])
    d = F.sqrt(sum((F.pow(F.col(f"a_c{k}") - F.col(f"b_c{k}"), 2) for k in "xyz"), F.lit(0.0)))
    j = a.join(b, ["t", "c"]).withColumn("dist", F.round(d, 6))
    j = j.withColumn("rank", F.row_number().over(Window.partitionBy("t", "c", "v1").orderBy("dist", "v2"))).where("rank = 1")
    near = F.abs(F.col("a_n") - F.col("b_n")) / F.greatest("a_n", "b_n") < similarity
    boxes = [(F.col(f"a_lo_{k}") <= F.col(f"b_hi_{k}") + 1) & (F.col(f"b_lo_{k}") <= F.col(f"a_hi_{k}") + 1) for k in "xyz"]
    return j.where(near & boxes[0] & boxes[1] & boxes[2]).select("t", "c", "v1", "v2", "dist")


LINK = ["t", "c", "v1", "v2"]


def linked(links: DataFrame, pairs: DataFrame, exclusive: bool = False) -> DataFrame:
    """``links`` with the pairs (t, c, v1, v2) linked by hand; ``forced`` marks them.

    A pair without overlap gets n = total = 1.  ``exclusive`` first isolates
    both ends between the two frames.  Repeated pairs count once.
    """
    pairs = pairs.select(*LINK).distinct()
    if exclusive:
        links = links.join(pairs.select("t", "c", "v1").distinct(), ["t", "c", "v1"], "left_anti")
        links = links.join(pairs.select("t", "c", "v2").distinct(), ["t", "c", "v2"], "left_anti")
    both = links.join(pairs.withColumn("hand", F.lit(True)), LINK, "full")
    return both.select(*LINK, F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("total", F.lit(1)).alias("total"), F.coalesce("hand", F.lit(False)).alias("forced"))


def unlinked(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``links`` without the pairs (t, c, v1, v2)."""
    return links.join(pairs.select(*LINK).distinct(), LINK, "left_anti")


def isolated(links: DataFrame, cells: DataFrame) -> DataFrame:
    """``links`` without those, back or forward, of the cells (t, c, label)."""
    out = links.join(cells.select("t", "c", F.col("label").alias("v1")).distinct(), ["t", "c", "v1"], "left_anti")
    return out.join(cells.select((F.col("t") - 1).alias("t"), "c", F.col("label").alias("v2")).distinct(), ["t", "c", "v2"], "left_anti")


def combined_cells(links: DataFrame, cells: DataFrame) -> DataFrame:
    """t, c, v1, v2, n, total once ``cells`` (t, c, label, into) have joined the cell ``into``: links that meet are added up."""
    cells = cells.groupBy("t", "c", "label").agg(F.min("into").alias("into"))
    a = cells.select("t", "c", F.col("label").alias("v1"), F.col("into").alias("i1"))
    b = cells.select((F.col("t") - 1).alias("t"), "c", F.col("label").alias("v2"), F.col("into").alias("i2"))
    rows = links.join(a, ["t", "c", "v1"], "left").join(b, ["t", "c", "v2"], "left")
    return rows.groupBy("t", "c", F.coalesce("i1", "v1").alias("v1"), F.coalesce("i2", "v2").alias("v2")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def mapped_cells(links: DataFrame, cells: DataFrame, ahead: bool = True) -> DataFrame:
    """t, c, label of the components that links join to ``cells`` (t, c, label): in the next frame, or in the one before."""
    near, far, own, other = ("v1", "v2", 0, 1) if ahead else ("v2", "v1", 1, 0)
    start = cells.select((F.col("t") - own).cast("int").alias("t"), "c", F.col("label").alias(near)).distinct()
    return links.join(start, ["t", "c", near], "left_semi").select((F.col("t") + other).cast("int").alias("t"), "c", F.col(far).alias("label")).distinct()


def tracked_ids(links: DataFrame) -> DataFrame:
    """t, c, label, tracked: the component of the frame before that each component continues: the largest overlap, of equals the smallest label."""
    best = links.groupBy("t", "c", "v2").agg(F.max(F.struct("total", "n", (-F.col("v1")).alias("m"))).alias("b"))
    return best.select((F.col("t") + 1).alias("t"), "c", F.col("v2").alias("label"), (-F.col("b.m")).alias("tracked"))


def change_counts(cells: DataFrame, links: DataFrame) -> DataFrame:
    """t, c, label, n_in, n_out: changes (``count`` of links) of each cell's links back and forward; 0 where there are none."""
    out = links.groupBy("t", "c", F.col("v1").alias("label")).agg(F.sum("count").alias("n_out"))
    back = links.groupBy((F.col("t") + 1).alias("t"), "c", F.col("v2").alias("label")).agg(F.sum("count").alias("n_in"))
    key = ["t", "c", "label"]
    return cells.select(*key).join(back, key, "left").join(out, key, "left").na.fill(0, ["n_in", "n_out"])


def change_histogram(counts: DataFrame, value: str) -> DataFrame:
    """level, n: cells by change count, with 0 for the levels between that have none."""
    seen = counts.groupBy(F.col(value).cast("long").alias("level")).agg(F.count("*").alias("n"))
    levels = seen.agg(F.max("level").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("level"))
    return levels.join(seen, "level", "left").na.fill(0, ["n"])


def valley(histogram: list[int], dissimilar: float = 0.65) -> int:
    """Level of the valley between the first peak and a later, clearly higher one; 0 where there is none.

    ``histogram`` holds the counts of levels 0, 1, ...; it is as long as the number of refinement rounds.
    """
    if not histogram or max(histogram) == 0:
        return 0
    peak = histogram.index(max(histogram))
    top = histogram[peak]
    while True:
        rising = [(n, -i) for i, n in enumerate(histogram) if i > peak and n > histogram[i - 1]]
        if not rising:
            return 0
        n2, later = max(rising)
        between = [(n, i) for i, n in enumerate(histogram) if peak < i < -later and n < top]
        if between:
            low, at = min(between)
            if abs(n2 - low) / max(n2, low) >= dissimilar:
                return at
        peak = -later


def track_lines(trails: DataFrame, stats: DataFrame, frame: int, lead: int, tail: int) -> DataFrame:
    """track, t, x, y, z: centres of the tracks seen in ``frame``, from ``tail`` frames before to ``lead`` frames after."""
    seen = trails.where(F.col("t") == frame).select("track").distinct()
    rows = trails.where(F.col("t").between(frame - tail, frame + lead)).join(seen, "track", "left_semi")
    places = rows.join(stats.select("t", "c", "label", "cx", "cy", "cz"), ["t", "c", "label"])
    return places.groupBy("track", "t").agg(*[F.avg(f"c{k}").alias(k) for k in "xyz"])


def carried_selection(vox: DataFrame, links: DataFrame, frame: int, low: int) -> DataFrame:
    """t, c, z, y, x of frame + 1 that belong to components mapped from those of ``frame`` with more than ``low`` samples."""
    sizes = vox.where((F.col("t") == frame) & (F.col("label") != 0) & (F.col("v") > 0)).groupBy("t", "c", "label").agg(F.count("*").alias("n"))
    found = mapped_cells(links, sizes.where(F.col("n") > low))
    return vox.where(F.col("t") == frame + 1).join(found, ["t", "c", "label"], "left_semi").select("t", "c", "z", "y", "x")
