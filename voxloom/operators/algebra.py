"""Element-wise algebra of two aligned volumes, masks and channel mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITION = ["t", "z", "y", "x"]


def unit(column: str = "v", bits: int = 8) -> Column:
    """Integer samples as 0..1."""
    return F.col(column) / F.lit(float((1 << bits) - 1))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both volumes at every position that either holds: va, vb, ma, mb; absent samples are 0, and a volume without a mask column counts as masked whole."""
    mask = lambda v: unit("mask") if "mask" in v.columns else F.lit(1.0)
    left = a.select(*POSITION, unit().alias("va"), mask(a).alias("ma"))
    right = b.select(*POSITION, unit().alias("vb"), mask(b).alias("mb"))
    return left.join(right, POSITION, "full").na.fill(0.0, ["va", "ma", "vb", "mb"])


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """All two-input operations of two aligned volumes, clamped to 0..1, one column each."""
    zero, one = F.lit(0.0), F.lit(1.0)
    va, vb = F.col("va"), F.col("vb")
    both = (va > 1e-5) & (vb > 1e-5)
    return aligned(a, b).select(
        *POSITION,
        F.greatest(va - vb, zero).alias("subtract"),
        F.least(va + vb, one).alias("add"),
        F.when(both, F.least(va / vb, one)).otherwise(zero).alias("divide"),
        F.least(va, vb).alias("intersect"),
        F.least(va * F.col("ma"), vb * F.col("mb")).alias("intersect_masked"),
    )


def extract(vox: DataFrame, inverse: bool = False) -> DataFrame:
    """The selection's samples (or, with ``inverse``, what is left when it is deleted)."""
    m = unit("mask")
    return vox.withColumn("v", (F.col("v") * (1 - m if inverse else m) + 0.5).cast("int"))


def mask_union(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Mask set algebra: replace, union, exclude or intersect; absent samples are 0."""
    j = a.select(*POSITION, F.col("mask").alias("a")).join(b.select(*POSITION, F.col("mask").alias("b")), POSITION, "full").na.fill(0, ["a", "b"])
    rule = {
        "replace": F.col("b"),
        "union": F.greatest("a", "b"),
        "exclude": F.when((F.col("a") > 0) & (F.col("b") > 0), 0).otherwise(F.col("a")),
        "intersect": F.least("a", "b"),
    }[how]
    return j.select(*POSITION, rule.cast("int").alias("mask"))


def group_extract(vox: DataFrame, volumes: DataFrame, group: int, inverse: bool = False) -> DataFrame:
    """``extract`` on the visible channels of one group (volumes: c, grp, visible); other channels stay."""
    chosen = volumes.where((F.col("grp") == group) & F.col("visible")).select("c", F.lit(True).alias("hit")).distinct()
    rows = vox.join(chosen, "c", "left")
    m = unit("mask")
    new = (F.col("v") * (1 - m if inverse else m) + 0.5).cast("int")
    return rows.withColumn("v", F.when(F.col("hit"), new).otherwise(F.col("v"))).drop("hit")


def from_float(vox: DataFrame, low: float, high: float, bits: int = 8) -> DataFrame:
    """Float samples as whole numbers: ``low`` to ``high`` becomes 0 to full scale, rounded down, what lies outside is cut."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - low) / (high - low)))
    return vox.withColumn("v", F.floor(share * ((1 << bits) - 1)).cast("int"))


def scaled_mask(mask16: DataFrame, scale: float) -> DataFrame:
    """A mask of 16-bit samples (``mask``) as bytes: times ``scale``, rounded down; for ``mask_union``."""
    return mask16.withColumn("mask", F.pmod(F.floor(F.col("mask") * scale), F.lit(256)).cast("int"))


def rgb(vox: DataFrame, colours: DataFrame, most: int = 255) -> DataFrame:
    """Channels mixed by colour (c, r, g, b in 0..1): sums of rounded parts, clipped at ``most``.

    ``colours`` has one row a channel.
    """
    mixed = vox.join(colours, "c")
    part = lambda k: F.least(F.sum(F.floor(F.col(k) * F.col("v") + 0.5)), F.lit(most)).cast("int").alias(k)
    return mixed.groupBy(*POSITION).agg(part("r"), part("g"), part("b"))


def average_channels(vox: DataFrame, weight: float) -> DataFrame:
    """Weighted sum of all channels at each position."""
    return vox.groupBy(*POSITION).agg((F.sum("v") * F.lit(weight)).alias("v"))


def fill_holes(vox: DataFrame, level: int) -> DataFrame:
    """Positions inside the bounding box of samples above ``level`` that such samples enclose on all six sides become full.

    Sides reach half the box's width in x and height in y, and its depth in
    z.  All tests use the samples as given, so the order of filling is immaterial.
    The empty candidates are the absent or lower positions of the box.
    """
    key = ["t", "c"]
    full = vox.where(F.col("v") > level).select(*key, "z", "y", "x")
    box = full.groupBy(*key).agg(*[f(k).alias(f"{n}{k}") for k in "zyx" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    seq = lambda k: F.explode(F.sequence(f"lo{k}", f"hi{k}")).alias(k)
    grid = box.select("*", seq("z")).select("*", seq("y")).select("*", seq("x"))
    marked = grid.join(full.withColumn("on", F.lit(1)), [*key, "z", "y", "x"], "left")
    from pyspark.sql import Window

    tests = []
    for axis, others, reach in (("x", ["z", "y"], "div2"), ("y", ["z", "x"], "div2"), ("z", ["y", "x"], "all")):
        w = Window.partitionBy(*key, *others).orderBy(axis)
        at = F.when(F.col("on") == 1, F.col(axis))
        before = F.max(at).over(w.rowsBetween(Window.unboundedPreceding, -1))
        after = F.min(at).over(w.rowsBetween(1, Window.unboundedFollowing))
        size = F.col(f"hi{axis}") - F.col(f"lo{axis}") + 1
        far = F.floor(size / 2) if reach == "div2" else size
        tests.append((F.col(axis) - before <= far) & (after - F.col(axis) <= far))
    found = marked.select(*key, "z", "y", "x", "on", *[t.alias(f"k{i}") for i, t in enumerate(tests)])
    return found.where("on = 1 or (k0 and k1 and k2)").select(*key, "z", "y", "x", F.lit(255).alias("v"))
