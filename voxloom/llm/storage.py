"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import gc
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key list is broadcast only when a count shows that it is no longer than this.
BROADCAST_KEYS = 300_000


#: Paths that the operator at work has written to so far.
_stored: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which a cluster must name; in local mode below the warehouse where it is unset."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    top = top or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _stored.get()
    if made is not None:
        made.append(path)
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator`` with the tables it has stored deleted at its end, but for those that its result reads.

    The driver's JVM then collects what it no longer holds, upon which Spark
    drops the shuffle files of finished work as well.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        made: list[str] = []
        outer = _stored.set(made)
        try:
            out = operator(*args, **kwargs)
        finally:
            _stored.reset(outer)
        read = out.inputFiles()
        for path in made:
            name = path.rsplit("/", 1)[1]
            if not any(f"/{name}/" in f for f in read):
                discard(out.sparkSession, path)
            elif _stored.get() is not None:
                _stored.get().append(path)
        gc.collect()
        out.sparkSession._jvm.System.gc()
        return out

    return run


def documents(df: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id (long), text (string) and row (long), a number of each row's own, whatever else the table holds.

    ``row`` names a column of stored, distinct longs; without it rows are
    numbered and stored here, so that a row has the same number whenever it is
    read again, also where doc_ids are null or repeated.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if row is not None:
        return df.select(*columns, F.col(row).cast("long").alias("row"))
    return stored(df.select(*columns, F.monotonically_increasing_id().alias("row")), "rows")


def fetch(docs: DataFrame, wanted: DataFrame, columns: list[str], narrow: bool = True) -> DataFrame:
    """The ``columns`` of ``docs`` joined by ``row`` to the rows of the stored table ``wanted``.

    When a count shows that few rows are wanted, ``wanted`` is broadcast and no
    text is shuffled; where its rows may be long (not ``narrow``) only their
    numbers are, and the wanted texts are shuffled.  Beyond the bound both sides are.
    """
    docs = docs.select("row", *columns)
    rows = wanted.select("row").distinct()
    if wanted.count() <= BROADCAST_KEYS:
        if narrow:
            return docs.join(F.broadcast(wanted), "row")
        docs = docs.join(F.broadcast(rows), "row", "left_semi")
    return docs.join(wanted, "row")
