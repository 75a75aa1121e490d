"""Warehouse tables as volumes, points, rulers, records and series.

``voxels`` is the canonical table: t, c, z, y, x, v (0-255), mask (0/255), label.
Rows with no value, mask or label may be absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grid of the adapter's volumes: z, y, x.
DIMS = (7, 32, 50)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 7-frame, 3-channel volume made of ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    at = li.groupBy(
        (F.year("l_shipdate") - 1995).cast("int").alias("t"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("c"),
        (F.col("l_linenumber") - 1).cast("int").alias("z"),
        (F.col("l_partkey") % 32).cast("int").alias("y"),
        (F.col("l_quantity") - 1).cast("int").alias("x"),
    ).agg(F.max("l_extendedprice").alias("p"), F.max("l_discount").alias("d"))
    at = at.withColumn("v", (F.floor("p").cast("long") % 256).cast("int"))
    label = F.when(F.col("v") < 64, 0).otherwise(1 + F.floor((F.col("x") + 2 * F.col("t")) / 10) + 7 * F.floor(F.col("y") / 8)).cast("long")
    return at.select("t", "c", "z", "y", "x", "v", F.when(F.col("d") > 0.05, 255).otherwise(0).alias("mask"), label.alias("label"))


#: Grid of the wide volumes, whose samples grow with the tables.
WIDE_DIMS = (7, 2048, 2048)


def wide_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume of nearly as many samples as ``lineitem`` has rows, gathered around the diagonal of its planes; blocks of 16 are its components."""
    li = table(spark, sf_dir, "lineitem")
    y = (F.col("l_orderkey") % 2048).cast("int")
    at = li.groupBy(
        (F.year("l_shipdate") - 1995).cast("int").alias("t"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("c"),
        (F.col("l_linenumber") - 1).cast("int").alias("z"),
        y.alias("y"),
        ((y + F.col("l_partkey") % 48) % 2048).cast("int").alias("x"),
    ).agg(F.max("l_extendedprice").alias("p"), F.max("l_discount").alias("d"))
    at = at.withColumn("v", (F.floor("p").cast("long") % 256).cast("int"))
    label = F.when(F.col("v") < 64, 0).otherwise(1 + F.floor(F.col("x") / 16) + 128 * F.floor(F.col("y") / 16)).cast("long")
    return at.select("t", "c", "z", "y", "x", "v", F.when(F.col("d") > 0.05, 255).otherwise(0).alias("mask"), label.alias("label"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z, w, grp: the first coordinates of ``embeddings`` in thousandths."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda k: F.round(F.col("embedding")[k].cast("double") * 1000).cast("long")
    return e.select(F.col("vec_id").alias("id"), part(0).alias("x"), part(1).alias("y"), part(2).alias("z"), F.abs(part(3)).alias("w"), F.col("label").alias("grp"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, hist (8 integers): records whose inputs are quantised embeddings, so some are equal."""
    e = table(spark, sf_dir, "embeddings")
    hist = F.transform(F.slice("embedding", 1, 8), lambda v: F.round(v.cast("double") * 2).cast("long"))
    return e.select(F.col("vec_id").alias("rec_id"), hist.alias("hist"), F.col("label").alias("param"))


def ruler_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ruler, t, x, y, z: ``events`` of a user in time order, as integer positions."""
    e = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("ruler"), nth.cast("int").alias("t"), F.floor("value").cast("long").alias("x"), (F.col("event_id") % 97).alias("y"), (F.col("event_id") % 31).alias("z"))


def roi_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi, t, v: events' integer values summed by type and day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("roi"), F.dayofmonth("ts").alias("t")).agg(F.sum(F.floor("value").cast("long")).alias("v"))


# The same adapters as DuckDB SQL, for the oracles.
VOX = """vox0 AS (SELECT CAST(year(l_shipdate)-1995 AS INT) t, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END c,
  CAST(l_linenumber-1 AS INT) z, CAST(l_partkey % 32 AS INT) y, CAST(l_quantity-1 AS INT) x, max(l_extendedprice) p, max(l_discount) dsc FROM lineitem GROUP BY 1,2,3,4,5),
vox1 AS (SELECT t,c,z,y,x, CAST(CAST(floor(p) AS BIGINT) % 256 AS INT) v, CASE WHEN dsc>0.05 THEN 255 ELSE 0 END mask FROM vox0),
vox AS (SELECT *, CASE WHEN v<64 THEN 0 ELSE CAST(1+floor((x+2*t)/10)+7*floor(y/8) AS BIGINT) END AS label FROM vox1)"""
WIDE = """vox0 AS (SELECT CAST(year(l_shipdate)-1995 AS INT) t, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END c, CAST(l_linenumber-1 AS INT) z, CAST(l_orderkey % 2048 AS INT) y,
  CAST((l_orderkey % 2048 + l_partkey % 48) % 2048 AS INT) x, max(l_extendedprice) p, max(l_discount) dsc FROM lineitem GROUP BY 1,2,3,4,5),
vox1 AS (SELECT t,c,z,y,x, CAST(CAST(floor(p) AS BIGINT) % 256 AS INT) v, CASE WHEN dsc>0.05 THEN 255 ELSE 0 END mask FROM vox0),
vox AS (SELECT *, CASE WHEN v<64 THEN 0 ELSE CAST(1+x//16+128*(y//16) AS BIGINT) END AS label FROM vox1)"""
POINTS = """pts AS (SELECT vec_id AS id, CAST(round(CAST(embedding[1] AS DOUBLE)*1000) AS BIGINT) x, CAST(round(CAST(embedding[2] AS DOUBLE)*1000) AS BIGINT) y,
  CAST(round(CAST(embedding[3] AS DOUBLE)*1000) AS BIGINT) z, abs(CAST(round(CAST(embedding[4] AS DOUBLE)*1000) AS BIGINT)) w, label AS grp FROM embeddings)"""
RECORDS = "rec AS (SELECT vec_id AS rec_id, list_transform(embedding[1:8], lambda v: CAST(round(CAST(v AS DOUBLE)*2) AS BIGINT)) AS hist, label AS param FROM embeddings)"
RULERS = """rul AS (SELECT user_id AS ruler, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS t,
  CAST(floor(value) AS BIGINT) AS x, event_id % 97 AS y, event_id % 31 AS z FROM events)"""
ROI = "roi AS (SELECT event_type AS roi, CAST(dayofmonth(ts) AS INT) AS t, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1,2)"
