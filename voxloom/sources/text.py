"""Text sources: gait blocks, pose tables, OBJ meshes, annotations and command lists."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line of text files; lines are numbered inside each file, which is one group."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return raw.select("file", F.posexplode(F.split("value", r"\r?\n"))).select("file", F.col("pos").alias("n"), F.col("col").alias("line"))


def gait_csv(spark: SparkSession, path: str, rows_per_block: int) -> DataFrame:
    """series, dim, frame, value of blocks of a name line, a time line and coordinate lines."""
    lines = numbered_lines(spark, path).where("trim(line) <> ''")
    n = F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1
    lines = lines.select("file", "line", F.floor(n / rows_per_block).alias("block"), (n % rows_per_block).alias("k"))
    names = lines.where("k = 0").select("file", "block", F.trim("line").alias("series"))
    values = lines.where("k >= 2").select("file", "block", (F.col("k") - 2).cast("int").alias("dim"), F.posexplode(F.split("line", ",")).alias("frame", "value"))
    return values.join(names, ["file", "block"]).select("series", "dim", "frame", F.trim("value").cast("double").alias("value"))


def pose_csv(spark: SparkSession, path: str) -> DataFrame:
    """ruler, t, x, y of a pose table with scorer, bodypart and coordinate header lines and an optional time_offset line."""
    lines = numbered_lines(spark, path).where("trim(line) <> ''")
    offset = lines.where("line like 'time_offset,%'").select("file", F.element_at(F.split("line", ","), 2).cast("int").alias("offset"))
    parts = lines.where("line like 'bodyparts,%'").select("file", F.posexplode(F.split("line", ",")).alias("k", "ruler"))
    coords = lines.where("line like 'coords,%'").select("file", F.posexplode(F.split("line", ",")).alias("k", "axis"))
    body = lines.where(r"line rlike '^\\d'").select("file", F.element_at(F.split("line", ","), 1).cast("int").alias("frame"), F.posexplode(F.split("line", ",")).alias("k", "value"))
    rows = body.join(parts, ["file", "k"]).join(coords, ["file", "k"]).where("axis in ('x', 'y')").join(offset, "file", "left")
    t = F.col("frame") + F.coalesce("offset", F.lit(0))
    return rows.groupBy("ruler", t.alias("t")).agg(*[F.max(F.when(F.col("axis") == a, F.col("value").cast("double"))).alias(a) for a in "xy"])


def obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (file, vid, x, y, z) and triangles (file, tid, i0, i1, i2; from 1; polygons as fans)."""
    lines = numbered_lines(spark, path).withColumn("p", F.split(F.trim("line"), r"\s+"))
    number = lambda kind: F.row_number().over(Window.partitionBy("file").orderBy("n")).alias(kind)
    v = lines.where("p[0] = 'v'").select("file", number("vid"), *[F.col("p")[k + 1].cast("double").alias(a) for k, a in enumerate("xyz")])
    f = lines.where("p[0] = 'f'").select("file", "n", F.transform(F.slice("p", 2, 64), lambda s: F.split(s, "/")[0].cast("int")).alias("i"))
    fan = f.select("file", "n", "i", F.posexplode(F.sequence(F.lit(2), F.size("i") - 1)).alias("k", "m"))
    return v, fan.select("file", F.row_number().over(Window.partitionBy("file").orderBy("n", "k")).alias("tid"), F.col("i")[0].alias("i0"), F.element_at("i", F.col("m")).alias("i1"), F.element_at("i", F.col("m") + 1).alias("i2"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """file, name, text, x, y, z, info: tab-separated rows after a Components: line; headers are matched whole."""
    lines = numbered_lines(spark, path)
    name = lines.where("line like 'Name:%'").groupBy("file").agg(F.min(F.trim(F.substring("line", 6, 9999))).alias("name"))
    begin = lines.where("line like 'Components:%'").groupBy("file").agg(F.min("n").alias("at"))
    rows = lines.join(begin, "file").where("n > at and line like '%\t%'").withColumn("p", F.split("line", "\t"))
    get = lambda k: F.try_element_at("p", F.lit(k))
    return rows.join(name, "file", "left").select("file", "name", get(1).alias("text"), *[get(k + 2).cast("double").alias(a) for k, a in enumerate("xyz")], get(5).alias("info"))


def commands(text: str) -> list[dict[str, str]]:
    """Sections of an INI command list or task script, in order, with their names."""
    parser = configparser.ConfigParser(strict=False, interpolation=None)
    parser.optionxform = str
    parser.read_string(text)
    return [{"section": s, **dict(parser[s])} for s in parser.sections()]
