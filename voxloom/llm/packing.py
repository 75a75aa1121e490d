"""Optimal length buckets, and token-budget batches inside each bucket.

The global histogram of exact lengths is one aggregation; what reaches the
driver has one entry for each distinct length, so it is bounded by the longest
text, not by the number of texts.  A dynamic program over it finds the bucket
boundaries of least padding.  Texts then enter batches of their bucket in
hash-random order, each padded to the longest length of the bucket.  A text's
place in its bucket is a prefix sum: the rows of the key ranges before its own,
and its rank in its range.  So a bucket of any size fills its batches but the
last one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import WORD, key_ranges, random_key
from .storage import BROADCAST_KEYS, stored, tidy

#: Rows that one key range of a bucket holds on average at most.
RANGE_ROWS = 32_000


def words(text: Column) -> Column:
    """The default tokens: words, as an array of strings; null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the total of bound - length.

    ``lengths`` ascend.  The least padding of the first j lengths in k buckets
    is the least over i of that of the first i in k - 1 plus the padding of
    one bucket over i..j: a line in the bound, of slope -(texts before i).
    Slopes fall and bounds rise with the index, so the lower envelope of the
    lines is kept in one list and read in one walk: time in proportion to the
    distinct lengths, in exact integers.  Of equal choices the smallest i is taken.
    """
    n = len(lengths)
    if not n:
        return []
    length = [int(x) for x in lengths]
    c, w = [0], [0]
    for x, m in zip(length, counts, strict=True):
        c.append(c[-1] + int(m))
        w.append(w[-1] + int(m) * x)
    # One bucket first; then one more each round.
    best = [0] + [length[j - 1] * c[j] - w[j] for j in range(1, n + 1)]
    cuts = [[0] * (n + 1)]
    for k in range(1, min(buckets, n)):
        new, cut, hull, at = [0] * (n + 1), [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if i >= k:
                b = best[i] + w[i]
                # Drop the last line where this one is below it before it gets below the one ahead of it.
                while len(hull) > 1 and (b - hull[-2][1]) * (c[hull[-1][0]] - c[hull[-2][0]]) < (hull[-1][1] - hull[-2][1]) * (c[i] - c[hull[-2][0]]):
                    hull.pop()
                hull.append((i, b))
                at = min(at, len(hull) - 1)
            if j <= k:
                continue
            x = length[j - 1]
            while at + 1 < len(hull) and hull[at + 1][1] - x * c[hull[at + 1][0]] < hull[at][1] - x * c[hull[at][0]]:
                at += 1
            i, b = hull[at]
            new[j], cut[j] = b - x * c[i] + x * c[j] - w[j], i
        best = new
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(length[j - 1])
        j = cut[j]
    return sorted(bounds)


@tidy
def batches(docs: DataFrame, buckets: int = 16, budget: int = 16_384, seed: str = "pack", tokens: Callable[[Column], Column] = words) -> DataFrame:
    """bucket, batch, bucket_length, doc_ids, lengths, tokens: one row per batch of ``docs``.

    ``tokens`` holds the batch's texts one after the other, each padded with
    nulls to ``bucket_length``; ``lengths`` tells tokens from padding.  A batch
    holds texts of one bucket, as many as fit ``budget`` tokens with their
    padding (one at least, so a text longer than the budget is a batch of its
    own); only the last batch of a bucket may hold fewer.  Null and empty texts
    have no tokens and lie in the first bucket.  Repeated rows each take a slot;
    copies of a row alike in id and text are interchangeable.  Other columns
    are ignored; an empty table gives no batch.

    Texts are read twice, for the histogram and for the batches, and shuffled
    once, by key range; only those of batches that lie over the edge of two
    ranges move again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measured(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        sized = rows.withColumn("n_tokens", F.size(tokens(F.col("text"))).cast("long")).withColumn("key", random_key(seed))
        return sized, stored(sized.select("n_tokens", "key", "row"), "lengths")

    sized, keys = measured(rows.withColumn("row", F.monotonically_increasing_id()))
    if not keys.groupBy("n_tokens", "key").agg(F.count("*").alias("n")).where(f"n > {RANGE_ROWS}").isEmpty():
        # Rows alike in id and text that outnumber a range are dealt by their numbers, which must not change between two readings.
        sized, keys = measured(stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered"))
    # One entry for each distinct length.
    histogram = keys.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    lengths = np.array([r["n_tokens"] for r in histogram], np.int64)
    counts = np.array([r["n"] for r in histogram], np.int64)
    bounds = bucket_bounds(lengths, counts, buckets) or [0]
    members = [int(counts[(lengths <= b) & (lengths > a)].sum()) for a, b in zip([-1, *bounds], bounds, strict=False)]
    table, rooms = (F.array(*[F.lit(k).cast("long") for k in of]) for of in (bounds, [max(1, budget // max(1, b)) for b in bounds]))
    ranged = lambda df: key_ranges(df.withColumn("bucket", F.size(F.filter(table, lambda b: b < F.col("n_tokens")))), bucketed, "bucket", max(members), RANGE_ROWS)
    bucketed = keys.withColumn("bucket", F.size(F.filter(table, lambda b: b < F.col("n_tokens"))))
    of = lambda values: F.element_at(values, F.col("bucket") + 1)
    # One row a range: how many rows of its bucket come before it.
    over = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged(keys).groupBy("bucket", "range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    starts = stored(starts, "starts")
    rank = F.row_number().over(Window.partitionBy("bucket", "range").orderBy("key", "row")) - 1
    placed = ranged(sized).withColumn("rank", rank).drop("key", "row")
    placed = placed.join(F.broadcast(starts) if starts.count() <= BROADCAST_KEYS else starts, ["bucket", "range"])
    placed = placed.withColumn("before", F.col("start") + F.col("rank")).withColumn("batch", F.floor(F.col("before") / of(rooms)).cast("long"))
    # Batches inside a range are gathered where the window left them, and so are the pieces of those over an edge.
    held = F.collect_list(F.struct("before", "doc_id", "n_tokens", "text")).alias("held")
    pieces = placed.groupBy("bucket", "range", "batch").agg(held)
    full = F.least(of(rooms), of(F.array(*[F.lit(m).cast("long") for m in members])) - F.col("batch") * of(rooms))
    whole = pieces.where(F.size("held") == full).select("bucket", "batch", "held")
    torn = pieces.where(F.size("held") < full).groupBy("bucket", "batch").agg(F.flatten(F.collect_list("held")).alias("held"))
    made = whole.unionByName(torn) if max(members) > RANGE_ROWS else whole
    made = made.withColumn("held", F.array_sort("held")).withColumn("bucket_length", of(table))
    one = lambda r: F.concat(tokens(r["text"]), F.array_repeat(F.lit(None).cast("string"), (F.col("bucket_length") - r["n_tokens"]).cast("int")))
    return made.select(
        "bucket",
        "batch",
        "bucket_length",
        F.transform("held", lambda r: r["doc_id"]).alias("doc_ids"),
        F.transform("held", lambda r: r["n_tokens"]).alias("lengths"),
        F.flatten(F.transform("held", one)).alias("tokens"),
    )


def unpacked(batches: DataFrame) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch, slot, padding, tokens_md5: one row per text, read from its batch.

    ``tokens_md5`` is of the text's tokens (strings), joined by spaces.
    """
    each = F.posexplode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("lengths").alias("n"))).alias("slot", "one")
    rows = batches.select("bucket", "batch", "bucket_length", "tokens", each)
    mine = F.slice("tokens", (F.col("slot") * F.col("bucket_length") + 1).cast("int"), F.col("one.n").cast("int"))
    return rows.select(
        F.col("one.doc_id").alias("doc_id"),
        F.col("one.n").alias("n_tokens"),
        "bucket",
        "bucket_length",
        "batch",
        F.col("slot").cast("long").alias("slot"),
        (F.col("bucket_length") - F.col("one.n")).alias("padding"),
        F.md5(F.array_join(mine, " ").cast("binary")).alias("tokens_md5"),
    )
