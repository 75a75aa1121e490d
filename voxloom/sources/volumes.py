"""Volumes as tables: frames and channels as partitions, sidecars, reduced levels, and indexes of vendor folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images, nrrd

AT = ["t", "c", "z", "y", "x"]


def save(vox: DataFrame, path: str, lo: tuple[int, int, int] | None = None, hi: tuple[int, int, int] | None = None) -> None:
    """Writes ``vox``, cropped to the box from ``lo`` to ``hi`` (z, y, x, both included) and moved to its corner, one folder a frame and channel."""
    for i, k in enumerate("zyx"):
        if hi is not None:
            vox = vox.where(F.col(k) <= hi[i])
        if lo is not None:
            vox = vox.where(F.col(k) >= lo[i]).withColumn(k, (F.col(k) - lo[i]).cast("int"))
    # Samples of a frame and channel are spread over tasks by slice.
    vox.repartition("t", "c", "z").write.partitionBy("t", "c").parquet(path)


def load(spark: SparkSession, path: str, frames: list[int] | None = None) -> DataFrame:
    """t, c, z, y, x, v, mask, label of a saved volume; wanted frames alone are read, and what has no mask or label gets 0."""
    vox = spark.read.parquet(path)
    if frames is not None:
        vox = vox.where(F.col("t").isin(frames))
    for name, kind in (("mask", "int"), ("label", "long")):
        stored = F.coalesce(F.col(name), F.lit(0)) if name in vox.columns else F.lit(0)
        vox = vox.withColumn(name, stored.cast(kind))
    return vox.select(*AT, "v", "mask", "label")


def sidecar(vox: DataFrame, name: str) -> DataFrame:
    """The mask or the label of ``vox`` alone, where it is not 0."""
    return vox.where(F.col(name) != 0).select(*AT, name)


def with_sidecar(vox: DataFrame, side: DataFrame, name: str) -> DataFrame:
    """``vox`` with a mask or label from another table (t, c, z, y, x, ``name``); samples found in either appear."""
    return vox.drop(name).join(side.select(*AT, F.col(name).alias("_side")), AT, "full").withColumn(name, F.coalesce("_side", F.lit(0))).drop("_side").na.fill(0)


def sidecar_files(spark: SparkSession, path: str, name: str, channel: int = 0) -> DataFrame:
    """Mask (.msk) or label (.lbl) files, which are NRRD volumes of one frame, as a sidecar table."""
    return nrrd.read(spark, path).select("t", F.lit(channel).alias("c"), "z", "y", "x", F.col("v").alias(name))


def level(vox: DataFrame, k: int) -> DataFrame:
    """The volume reduced ``k`` times by two along each axis: rounded-down means of the samples in the table."""
    at = [F.shiftright(F.col(q), k).alias(q) for q in "zyx"]
    return vox.groupBy("t", "c", *at).agg(F.floor(F.avg("v")).cast("int").alias("v"))


def save_levels(vox: DataFrame, path: str, levels: int, brick: tuple[int, int, int]) -> None:
    """Writes levels 0 to ``levels`` - 1, one folder a level and row of bricks, so that a box of a level reads its bricks alone."""
    for k in range(levels):
        rows = vox.select(*AT, "v") if k == 0 else level(vox, k)
        bricks = {f"b{q}": F.floor(F.col(q) / s).cast("int") for q, s in zip("zyx", brick, strict=True)}
        rows = rows.withColumns({"level": F.lit(k), **bricks})
        rows.repartition("t", "c", "bz", "by", "bx").write.mode("append").partitionBy("level", "bz", "by", "bx").parquet(path)


def load_level(spark: SparkSession, path: str, k: int, lo: tuple[int, int, int], hi: tuple[int, int, int], brick: tuple[int, int, int]) -> DataFrame:
    """t, c, z, y, x, v of the box from ``lo`` to ``hi`` (both included) at one level; other levels and bricks are not read."""
    rows = spark.read.parquet(path).where(F.col("level") == k)
    for i, q in enumerate("zyx"):
        rows = rows.where(F.col(f"b{q}").between(lo[i] // brick[i], hi[i] // brick[i]) & F.col(q).between(lo[i], hi[i]))
    return rows.select(*AT, "v")


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """file, t, c, z of the images that a microscope's scan index (XML: Sequence, Frame, File) lists.

    Sequences are frames and their Frame elements slices; in a time series
    (type holding ``TSeries``) with one sequence, Frame elements are frames.
    """
    shape = "_cycle INT, _type STRING, Frame ARRAY<STRUCT<_index: INT, File: ARRAY<STRUCT<_channel: INT, _filename: STRING>>>>"
    rows = spark.read.format("xml").option("rowTag", "Sequence").schema(shape).load(path)
    rows = rows.select("_cycle", F.coalesce("_type", F.lit("")).alias("kind"), F.explode("Frame").alias("f")).select("_cycle", "kind", F.col("f._index").alias("i"), F.explode("f.File").alias("g"))
    series = F.col("kind").contains("TSeries")
    cycle = F.greatest(F.coalesce("_cycle", F.lit(1)) - 1, F.lit(0))
    return rows.select(F.col("g._filename").alias("file"), F.when(series, F.col("i") - 1).otherwise(cycle).alias("t"), (F.col("g._channel") - 1).alias("c"), F.when(series, 0).otherwise(F.col("i") - 1).alias("z"))


def scan(spark: SparkSession, index: str, folder: str) -> DataFrame:
    """t, c, z, y, x, v of the TIFF files that a scan index lists; z counts on over a file's pages."""
    rows = images.read(spark, folder, depth=r"(?!)").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("z").alias("page"), "y", "x", "v")
    return rows.join(scan_index(spark, index), "file").select("t", "c", (F.col("z") + F.col("page")).alias("z"), "y", "x", "v")
