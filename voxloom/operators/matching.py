"""Alternating paths between two frames, and links that settle by them.

``links`` (t, c, v1, v2, n, total) are the edges of one two-sided graph for
each pair of neighbouring frames: v1 in frame t, v2 in frame t + 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

EDGE = ["t", "c", "v1", "v2"]


def reversed_links(links: DataFrame) -> DataFrame:
    """The same links with the two frames' components exchanged."""
    other = {"v1": "v2", "v2": "v1"}
    return links.select(*[F.col(other.get(k, k)).alias(k) for k in links.columns])


def _falling(near: str, far: str):
    return Window.partitionBy("t", "c", near).orderBy(F.desc("total"), F.desc("n"), far)


def alternating_paths(links: DataFrame, similarity: float = 0.2) -> DataFrame:
    """t, c, v1, v2, far, total, beyond, weight, rank, dissimilar: one path from each start v1 over each of its links.

    Links are walked in falling order of ``total``, ``n`` and rising number of
    the component.  A path goes on from v2 to the first component ``far`` of
    the start's own frame that no path before it has taken; ``beyond`` is that
    link's total (0 where the path ends at v2).  A path's weight is what the
    start gains by keeping it: its own total, and what all its other
    neighbours overlap beyond.  Paths rank by falling weight; those from the
    first on that differ from the best by ``similarity`` of it or more are
    ``dissimilar``.

    That a component goes to the first path that asks for it is settled in
    rounds, for all starts at once: every path asks for the first component it
    may still have, and where one is asked for or held by an earlier path, the
    later ones' options of it go.  What is left when no round takes anything
    away is what a walk from path to path finds.
    """
    near = links.select(*EDGE, "total", "n").withColumn("k", F.row_number().over(_falling("v1", "v2")))
    back = links.select("t", "c", "v2", F.col("v1").alias("far"), F.col("total").alias("beyond"), F.row_number().over(_falling("v2", "v1")).alias("option"))
    options = cut(near.select(*EDGE, "k").join(back, ["t", "c", "v2"]).where("far <> v1"))
    path, taken = Window.partitionBy(*EDGE), Window.partitionBy("t", "c", "v1", "far")
    left = options.count()
    while True:
        asked = F.when(F.col("option") == F.min("option").over(path), F.col("k"))
        kept = options.withColumn("asked", asked).withColumn("holder", F.min("asked").over(taken))
        options = cut(kept.where("holder is null or k <= holder").drop("asked", "holder"))
        now = options.count()
        if now == left:
            break
        left = now
    first = options.withColumn("least", F.min("option").over(path)).where("option = least").select(*EDGE, "far", "beyond")
    start = Window.partitionBy("t", "c", "v1")
    paths = near.join(first, EDGE, "left").na.fill(0, ["beyond"])
    paths = paths.withColumn("weight", F.col("total") + F.sum("beyond").over(start) - F.col("beyond"))
    paths = paths.withColumn("rank", F.row_number().over(start.orderBy(F.desc("weight"), "k")))
    best = F.max("weight").over(start)
    far_off = (best <= 0) | (best - F.col("weight") >= F.lit(similarity) * best)
    return paths.select(*EDGE, "far", "total", "beyond", "weight", "rank", ((F.col("rank") > 1) & far_off).alias("dissimilar"))


def _half_round(edges: DataFrame, paths: DataFrame, similarity: float) -> DataFrame:
    """One look at every component v1: ``link`` and ``count`` of its edges (EDGE, total, n, link, count) after it."""
    start, there = Window.partitionBy("t", "c", "v1"), Window.partitionBy("t", "c", "v2")
    e = edges.join(paths.select(*EDGE, "dissimilar"), EDGE)
    on = F.col("link") == 1
    e = e.withColumn("valence", F.sum("link").over(start)).withColumn("others", F.sum("link").over(there) - F.col("link"))
    e = e.withColumn("top", F.max(F.when(on, F.col("total"))).over(start)).withColumn("most", F.max("total").over(start))
    apart = lambda top: (F.col(top) - F.col("total")) >= F.lit(similarity) * F.col(top)
    rules = [on & apart("top"), on & F.col("dissimilar"), on & (F.col("others") > 0)]
    e = e.withColumns({f"rule{i}": r for i, r in enumerate(rules)})
    found = {f"found{i}": F.sum(F.col(f"rule{i}").cast("int")).over(start) for i in range(3)}
    e = e.withColumns(found)
    # The first rule that finds something decides; the last one only if it leaves a link.
    many = F.col("valence") > 1
    off = F.when(F.col("found0") > 0, F.col("rule0")).when(F.col("found1") > 0, F.col("rule1")).otherwise(F.col("rule2") & (F.col("found2") < F.col("valence")))
    to = F.when(many & off, 0).when(F.col("valence") == 0, F.when(apart("most"), 0).otherwise(1)).otherwise(F.col("link"))
    e = e.withColumn("to", to.cast("int"))
    return e.select(*EDGE, "total", "n", F.col("to").alias("link"), (F.col("count") + (F.col("to") != F.col("link")).cast("int")).alias("count"))


def settled_links(links: DataFrame, rounds: int = 2, similarity: float = 0.2) -> DataFrame:
    """t, c, v1, v2, total, n, link, count: which links hold (1) once vertices have been looked at, and how often each has changed.

    All links hold at first.  A round looks at all components of frames t,
    then at all of frames t + 1, each time at all of them at once.  One without
    a link takes its largest overlap and those similar to it.  One with
    several drops those that are not similar to its largest; if none is, the
    dissimilar alternating paths' links; if there are none, the links to
    components that have another link, unless these are all it has.
    """
    edges = cut(links.select(*EDGE, "total", "n").withColumn("link", F.lit(1)).withColumn("count", F.lit(0)))
    ahead = cut(alternating_paths(edges, similarity).select(*EDGE, "dissimilar"))
    behind = cut(alternating_paths(reversed_links(edges), similarity).select(*EDGE, "dissimilar"))
    for _ in range(rounds):
        edges = cut(_half_round(edges, ahead, similarity))
        edges = cut(reversed_links(_half_round(reversed_links(edges), behind, similarity)).select(*EDGE, "total", "n", "link", "count"))
    return edges


def path_report(paths: DataFrame, cells: DataFrame) -> DataFrame:
    """t, c, label, paths, text: the paths from the selected ``cells`` (t, c, label), best first, as ``start-over-far (weight)``."""
    mine = paths.join(cells.select("t", "c", F.col("label").alias("v1")).distinct(), ["t", "c", "v1"], "left_semi")
    far = F.coalesce(F.concat(F.lit("-"), F.col("far").cast("string")), F.lit(""))
    line = F.concat(F.col("v1").cast("string"), F.lit("-"), F.col("v2").cast("string"), far, F.lit(" ("), F.col("weight").cast("string"), F.lit(")"))
    rows = mine.groupBy("t", "c", F.col("v1").alias("label")).agg(F.count("*").alias("paths"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return rows.select("t", "c", "label", "paths", F.array_join("lines.line", "; ").alias("text"))
