"""The record store: inputs (arrays) with parameters, newest last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import squared_distance
from .graph import cut


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """A record with an equal input is replaced and takes the new one's place at the end (rec_id orders)."""
    both = old.unionByName(new)
    last = F.row_number().over(Window.partitionBy("hist").orderBy(F.desc("rec_id")))
    return both.withColumn("n", last).where("n = 1").drop("n")


def deleted(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("rec_id"), "rec_id", "left_anti")


def nearest(records: DataFrame, queries: DataFrame, block: int = 1000) -> DataFrame:
    """For each query (q_id, q_hist) the record with the least squared distance; of ties the last.

    ``queries`` is a stated set.  Equal inputs are compared once, on both
    sides.  Queries are taken in blocks of ``block`` rows, each broadcast; the
    records stream past, first for the least distance, then for the last record at it: both
    are plain numbers, so a task keeps one of each a query and sorts nothing.
    """
    queries = cut(queries.select("q_id", "q_hist"))
    asked = cut(queries.groupBy("q_hist").agg(F.min("q_id").alias("ask")))
    known = cut(records.groupBy("hist").agg(F.max("rec_id").alias("rec_id")))
    parts = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.hash("ask"), F.lit(parts)))
    dist = squared_distance(F.col("hist"), F.col("q_hist"))
    past = lambda rows, k: known.crossJoin(F.broadcast(rows.where(F.col("block") == k).drop("block"))).withColumn("dist", dist)
    least = cut(reduce(DataFrame.unionByName, [past(asked, k).groupBy("ask").agg(F.min("dist").alias("least")) for k in range(parts)]))
    asked = cut(asked.join(least, "ask"))
    last = [past(asked, k).where(F.col("dist") == F.col("least")).groupBy("ask", "least").agg(F.max("rec_id").alias("rec_id")) for k in range(parts)]
    best = asked.join(reduce(DataFrame.unionByName, last).drop("least"), "ask")
    return queries.join(best.select(F.col("q_hist").alias("hist"), "rec_id", "least"), F.col("q_hist").eqNullSafe(F.col("hist"))).select("q_id", "rec_id", F.col("least").alias("dist"))


def with_parameters(records: DataFrame, values: dict[str, float]) -> DataFrame:
    """``records`` (params: map of name to value) with the named parameters set; other names stay."""
    given = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    keep = F.map_filter("params", lambda k, _: ~k.isin(list(values)))
    return records.withColumn("params", F.map_concat(keep, given))


def parameter(name: str, default: float = 0.0) -> Column:
    """The value of a named parameter, ``default`` where a record has none."""
    return F.coalesce(F.element_at("params", name), F.lit(default))
