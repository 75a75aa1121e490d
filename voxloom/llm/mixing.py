"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key.  Rows are cut by key range inside their
source, the ranges' word counts are summed, and a window over these few sums
gives each range the words before it; a second window, inside one range,
gives each row the words before it.  So no task ever holds a whole source.
Each source is then read in key order until its target is used up: whole
epochs first, then the rows before the cut, the row at the cut in part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored, tidy

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one key range holds on average in the largest group.
RANGE_ROWS = 8_000


def word_count(column: str = "text") -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: str = "mix") -> Column:
    """32 hex digits that order rows at random, the same in every run; only rows with equal id and text tie."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text))


def key_ranges(rows: DataFrame, keys: DataFrame, group: str, largest: int, range_rows: int) -> DataFrame:
    """Adds ``range``: rows have a ``key`` of uniform hex digits, leading digits of which name a range of about ``range_rows`` rows.

    ``largest`` is the row count of the largest group.  A key that more than
    ``range_rows`` rows of a group share (they are copies of each other; counted
    over ``keys``, the rows' group and key) comes after its range's other keys,
    dealt over ranges by the upper bits of ``row``.
    """
    digits = math.ceil(math.log(max(largest / range_rows, 1), 16))
    crowds = keys.groupBy(group, "key").agg(F.count("*").alias("_n")).where(f"_n > {range_rows}")
    crowds = stored(crowds.select(F.col(group).alias("_g"), F.col("key").alias("_k")), "crowds")
    rows = rows.join(crowds, F.col(group).eqNullSafe(F.col("_g")) & (F.col("key") == F.col("_k")), "left")
    part = F.concat("key", F.lpad(F.hex(F.shiftrightunsigned("row", 13)), 16, "0"))
    named = F.concat(F.substring("key", 1, digits), F.when(F.col("_k").isNull(), F.lit("")).otherwise(part))
    return rows.withColumn("range", named).drop("_g", "_k")


def prefix_sums(rows: DataFrame, group: str, value: str, largest: int) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the group that precede the row, range by range (see ``key_ranges``).

    Rows are stored and have a ``key`` and a ``row`` of their own.
    """
    rows = key_ranges(rows, rows, group, largest, RANGE_ROWS)
    sums = rows.groupBy(group, "range").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("range").alias("_r"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "range").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    rows = rows.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("range") == F.col("_r")))
    return rows.withColumn("before", (F.col("_start") + F.col("_inside")).cast("long")).drop("range", "_inside", "_g", "_r", "_start")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, n_rows, target: ``share`` of all words dealt out by weight, none above ``most`` times its source.

    Sources are numbered by code point, null last, and take the weights in
    turn.  What a capped source leaves is dealt out by weight again; the fixed
    point is min(cap, weight * level), and the level follows from one pass over
    the sources in order of cap / weight.  Windows run over one row a source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    totals = totals.withColumn("w", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    totals = totals.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    totals = totals.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open_w", F.sum("w").over(after))
    totals = totals.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("capped")) / F.col("open_w"))
    # The level is the first one that does not fill the source at which it is taken.
    totals = totals.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("level"), F.col("cap")))
    return totals.select("source", "source_size", "n_rows", target.alias("target"))


def _planned(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds source_size, target, before, taken to stored rows (row, key, source, size)."""
    targets = stored(source_targets(sized, weights, share, most), "targets")
    largest = targets.agg(F.max("n_rows")).first()[0] or 0
    rows = prefix_sums(sized, "source", "size", largest)
    # A target table has one row a source, and is joined as the optimizer sees fit.
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.withColumn("taken", taken.cast("long"))


@tidy
def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, before: one row per row of ``docs``.

    Null texts have no words; a null source is a source like others.  Equal
    doc_ids are ordered by a hash of their texts too; copies of a row alike in
    id, source and text are interchangeable.  ``taken`` never exceeds ``most``
    times the size, rounded up to epochs.  Other columns are ignored.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), random_key(seed).alias("key"), F.monotonically_increasing_id().alias("row"))
    return _planned(stored(sized, "sizes"), weights, share, most).select("doc_id", "source", "size", "source_size", "target", "taken", "before")


@tidy
def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns unchanged.

    Whole rows are repeated: the row at a source's cut is taken in the last
    epoch when at least half of it is before the cut.  Each row has its own
    count, whatever its doc_id; rows without words are not taken.
    """
    names = docs.columns
    inputs = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "size": word_count(), "key": random_key(seed)}
    kept = F.struct(*[F.col(f"`{n}`") for n in names]).alias("kept")
    rows = stored(docs.select(*[c.alias(k) for k, c in inputs.items()], F.monotonically_increasing_id().alias("row"), kept), "mixable")
    plan = _planned(rows.drop("kept"), weights, share, most).where("size > 0")
    times = plan.select("row", F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int").alias("times")).where("times > 0")
    return rows.select("row", "kept").join(times, "row").select("kept", F.explode(F.sequence(F.lit(1), F.col("times")))).select("kept.*")
