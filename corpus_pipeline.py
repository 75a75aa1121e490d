"""The corpus pipeline: quality, exact copies, near copies, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import exact_dedup, language, mixing, near_dedup, packing, quality
from voxloom.llm.storage import stored, tidy

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


@tidy
def _kept(docs: DataFrame, decide: Callable[..., DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps, each by a number of its own: ids may be null or repeated."""
    rows = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    kept = decide(rows, row="_row").where("kept").select(F.col("row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").drop("_row")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns as in its own query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality.train(quality.labelled_sample(docs.where(~language.held_out(3, 1)), labels))
    return quality.score(docs, net, COLUMNS).where("score >= 0.5").drop("score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return _kept(docs, exact_dedup.exact_duplicates)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return _kept(docs, near_dedup.near_duplicates)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as their source's target takes them."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of what the mix holds, by length buckets; a document is in them once for each copy."""
    return packing.batches(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_lengths),
]

#: SQL cannot express a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
