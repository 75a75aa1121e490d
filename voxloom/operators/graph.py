"""Connected components of an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  In local mode the warehouse serves where it is unset."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (top or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written below ``shared_folder``, which cuts its lineage.

    A checkpoint would carry the estimated sizes of its plan along; joins
    multiply these, so in a loop the planner alone would take twice as long
    each round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every end of ``edges`` (a, b): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks
    four steps and contracts the edges.  At most half of the nodes that still
    have edges outlast a round, and rounds work on what is left of the edges.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct()
    named = cut(ends.select("node", F.col("node").alias("root")))
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not left.isEmpty():
        both = left.union(left.select(F.col("b"), F.col("a")))
        up = cut(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")).select("x", F.least("x", "y").alias("y")))
        for _ in range(2):
            up = up.join(up.select(F.col("x").alias("y"), F.col("y").alias("top")), "y").select("x", F.col("top").alias("y"))
        up = cut(up)
        left = left.join(up.select(F.col("x").alias("a"), F.col("y").alias("na")), "a").join(up.select(F.col("x").alias("b"), F.col("y").alias("nb")), "b")
        left = cut(left.where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
        named = cut(named.join(up, named["root"] == up["x"], "left").select("node", F.coalesce("y", "root").alias("root")))
    return named
