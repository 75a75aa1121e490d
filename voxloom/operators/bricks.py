"""Components of a volume that was labelled brick by brick: seams, linking, merged statistics, consistent identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected

Dims = tuple[int, int, int]
CELL = ["t", "c", "brick", "label"]


def brick_of(dims: Dims, size: Dims) -> Column:
    """Number of the brick that holds a sample, bricks counted along x, then y, then z."""
    ny, nx = (-(-n // s) for n, s in zip(dims[1:], size[1:], strict=True))
    bz, by, bx = (F.floor(F.col(k) / s) for k, s in zip("zyx", size, strict=True))
    return ((bz * ny + by) * nx + bx).cast("int")


def _name(brick: str, label: str) -> Column:
    """A node name that sorts by frame, channel, brick and label."""
    return F.concat_ws("/", *[F.lpad(F.col(k).cast("string"), n, "0") for k, n in (("t", 6), ("c", 4), (brick, 10), (label, 12))])


def seams(vox: DataFrame, dims: Dims, size: Dims) -> DataFrame:
    """t, c, brick, label, brick2, label2, n: faces at which components of neighbouring bricks meet.

    Only the samples on the upper faces of bricks are dealt to the position
    beyond the face, so what is shuffled grows with the seams' area.
    """
    rows = vox.where("label <> 0 and v > 0").select("t", "c", "z", "y", "x", "label", brick_of(dims, size).alias("brick"))
    step = [F.when(F.col(k) % s == s - 1, F.struct(*[F.lit(int(q == k)).alias(q) for q in "zyx"])) for k, s in zip("zyx", size, strict=True)]
    out = rows.withColumn("o", F.explode(F.filter(F.array(*step), lambda s: s.isNotNull())))
    out = out.select("t", "c", *[(F.col(k) + F.col(f"o.{k}")).alias(k) for k in "zyx"], "brick", "label")
    beyond = rows.select("t", "c", "z", "y", "x", F.col("brick").alias("brick2"), F.col("label").alias("label2"))
    return out.join(beyond, ["t", "c", "z", "y", "x"]).groupBy(*CELL, "brick2", "label2").agg(F.count("*").alias("n"))


def linked_components(seam: DataFrame, least: int = 5) -> DataFrame:
    """t, c, brick, label, root_brick, root_label for components joined over seams of ``least`` faces or more.

    The root is the joined component of the smallest brick, then label.
    """
    edges = seam.where(F.col("n") >= least).select(_name("brick", "label").alias("a"), _name("brick2", "label2").alias("b"))
    own, root = F.split("node", "/"), F.split("root", "/")
    return connected(edges).select(
        own[0].cast("int").alias("t"),
        own[1].cast("int").alias("c"),
        own[2].cast("int").alias("brick"),
        own[3].cast("long").alias("label"),
        root[2].cast("int").alias("root_brick"),
        root[3].cast("long").alias("root_label"),
    )


def _with_roots(cells: DataFrame, links: DataFrame) -> DataFrame:
    rows = cells.join(links, CELL, "left")
    return rows.withColumns({f"root_{k}": F.coalesce(f"root_{k}", k) for k in ("brick", "label")})


def merged_stats(vox: DataFrame, links: DataFrame, dims: Dims, size: Dims) -> DataFrame:
    """One row a brick's component, with count, sum, extremes, mean and sigma of all that it is linked to."""
    rows = vox.where("label <> 0 and v > 0").withColumn("brick", brick_of(dims, size))
    cells = rows.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.min("v").alias("least"), F.max("v").alias("most"))
    cells = _with_roots(cells, links)
    root = ["t", "c", "root_brick", "root_label"]
    whole = cells.groupBy(*root).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"))
    n = F.col("n")
    sigma = F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("total") * F.col("total") / n) / n))
    whole = whole.withColumn("mean", F.col("total") / n).withColumn("sigma", sigma).drop("squares")
    return cells.select(*CELL, "root_brick", "root_label").join(whole, root)


def consistent_labels(cells: DataFrame, links: DataFrame) -> DataFrame:
    """t, c, brick, label, new for the cells (t, c, brick, label) that change: ids of linked components get one colour.

    Colours repeat every 253 ids.  A linked component whose label differs from
    the root's in that remainder takes a free label of the root's colour in
    its brick: the first of root, root + 253, ... that no cell of the brick
    has.  Several such cells of a brick take one each, in the order of root and label.
    """
    rows = _with_roots(cells.select(*CELL).distinct(), links)
    change = rows.where(F.pmod(F.col("label") - F.col("root_label"), F.lit(253)) != 0).withColumn("colour", F.pmod("root_label", F.lit(253)))
    group = ["t", "c", "brick", "colour"]
    change = change.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("root_label", "root_brick", "label")))
    used = cells.select("t", "c", "brick", "label").distinct().withColumn("colour", F.pmod("label", F.lit(253)))
    counts = used.groupBy(*group).agg(F.count("*").alias("taken"))
    wanted = change.groupBy(*group).agg(F.count("*").alias("n"), F.min("root_label").alias("start")).join(counts, group, "left")
    # As many candidates as cells that change and labels that are taken, so enough are free.
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + F.coalesce("taken", F.lit(0)) - 1))
    free = wanted.select(*group, "start", steps.alias("k")).select(*group, (F.col("start") + 253 * F.col("k")).alias("new"))
    free = free.join(used.select(*group, F.col("label").alias("new")), [*group, "new"], "left_anti")
    free = free.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("new")))
    return change.join(free, [*group, "nth"]).select(*CELL, "new")


def consistent_ids(vox: DataFrame, links: DataFrame, dims: Dims, size: Dims) -> DataFrame:
    """Samples with ``id``: their label, or the new one where ``consistent_labels`` gives one; 0 where there is no label."""
    rows = vox.withColumn("brick", brick_of(dims, size))
    changed = consistent_labels(rows.where("label <> 0"), links)
    rows = rows.join(changed, CELL, "left")
    return rows.select("t", "c", "z", "y", "x", F.coalesce("new", "label").alias("id"))


def component_count(vox: DataFrame, links: DataFrame, dims: Dims, size: Dims) -> DataFrame:
    """t, c, comps: linked components count once."""
    cells = vox.where("label <> 0 and v > 0").select("t", "c", "label", brick_of(dims, size).alias("brick")).distinct()
    return _with_roots(cells, links).groupBy("t", "c").agg(F.count_distinct("root_brick", "root_label").alias("comps"))
