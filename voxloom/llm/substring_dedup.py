"""Repeated passages by level-wise doubling of windows.

Level 0 works on windows of a quarter of the length.  Of the short windows
inside a full one, that with the smallest hash stands for it (all copies of a
full window choose the same one), so about a fourteenth of them are counted.
What is repeated at one length alone is extended to twice that length, inside
its full window, and counted again, until full windows are counted themselves
or no candidate survives: 9, 18, 35 words.  A full window repeats only if what
stands for it repeats at every level, so levels lose nothing.

The last level decides, by 96 bits for each window, from two independent lanes
over words whose hashes are two lanes as well: with 1e13 windows the chance
that any two different ones agree is below a thousandth.  Whole copies of a document
(equal SHA-256 of their words) are counted once, with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .storage import documents, fetch, stored, tidy

#: No level counts windows shorter than half of this.
SHORT = 16


def level_lengths(window: int) -> list[int]:
    """Window lengths of the levels, each at most twice the one before, the last ``window``."""
    lengths = [window]
    while lengths[0] >= SHORT:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


def smallest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, where its smallest (the last of equals) is."""
    at, span = np.arange(len(values)), 1

    def step(at: np.ndarray, by: int) -> np.ndarray:
        a, b = at[: len(at) - by], at[by:]
        return np.where(values[a] < values[b], a, b)

    while 2 * span <= width:
        at, span = step(at, span), 2 * span
    return step(at, width - span) if width > span else at


def _stand_ins(words: np.ndarray, window: int, level: int) -> np.ndarray:
    """For each full window, where the shorter window that stands for it at ``level`` starts."""
    n, lengths = len(words) - window + 1, level_lengths(window)
    if n <= 0:
        return np.zeros(0, np.int64)
    starts = np.arange(n)
    at = starts if len(lengths) == 1 else smallest_in_windows(kernels.window_hashes(words, lengths[0]), window - lengths[0] + 1)
    for length in lengths[1 : level + 1]:
        at = np.minimum(at, starts + window - length)
    return at


def _scanned(window: int):
    length = level_lengths(window)[0]
    kinds = {"doc_id": pa.int64(), "row": pa.int64(), "n_words": pa.int64(), "whole_sha256": pa.string(), "at": pa.list_(pa.int32()), "h1": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(k).to_pylist() for k in ("doc_id", "row")]
            for base, texts in kernels.slices(batch.column("text")):
                (words,), first = kernels.word_hashes(texts)
                hashes, at = kernels.window_hashes(words, length).view(np.int64), _stand_ins(words, window, 0)
                out = []
                for k, (a, b, text) in enumerate(zip(first[:-1], first[1:], texts, strict=True)):
                    starts = np.unique(at[a : b - window + 1]) if b - a >= window else at[:0]
                    out.append((*[x[base + k] for x in ids], int(b - a), sha256(b" ".join(text.split())).hexdigest(), starts - a, hashes[starts]))
                yield kernels.batch_of(out, kinds)

    return run


def _extended(window: int, level: int):
    """(row, copies, at, h1, h2) at ``level`` of every full window whose stand-in is repeated one level before."""
    length, last = level_lengths(window)[level], level + 1 == len(level_lengths(window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("row", "copies", "at")]
            for base, texts in kernels.slices(batch.column("text")):
                words, first = kernels.word_hashes(texts, lanes=2 if last else 1)
                before, now = _stand_ins(words[0], window, level - 1), _stand_ins(words[0], window, level)
                hashes = [kernels.window_hashes(w, length, seed).view(np.int64) for seed, w in enumerate(words)]
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    row, copies, repeated = (c[base + k] for c in columns)
                    wanted = np.zeros(b - a, bool)
                    wanted[repeated] = True
                    p = np.unique(now[a : b - window + 1][wanted[before[a : b - window + 1] - a]])
                    for column, values in zip(out, (np.full(len(p), row), np.full(len(p), copies), p - a, hashes[0][p], hashes[-1][p]), strict=True):
                        column.append(values)
                kinds = (np.int64, np.int64, np.int32, np.int64, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(out, kinds, strict=True)], names=["row", "copies", "at", "h1", "h2"])

    return run


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n_words`` words lie in a window that starts at one of ``starts``."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.asarray(starts) + window, -1)
    return np.cumsum(step)[:n_words] > 0


def _removed(window: int):
    kinds = {"row": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, at, raw in zip(*[batch.column(k).to_pylist() for k in ("row", "at")], kernels.raw_texts(batch.column("text")), strict=True):
                words = raw.split()
                gone = covered(len(words), np.array(at, np.int64), window)
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                out.append((row, int(gone.sum()), sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            yield kernels.batch_of(out, kinds)

    return run


@tidy
def _level(docs: DataFrame, scan: DataFrame, copies: DataFrame, alive: DataFrame | None, window: int, k: int) -> DataFrame:
    """(row, at), stored: where windows start that repeat at level ``k``, of those that ``alive`` says did one level before."""
    levels = len(level_lengths(window))
    key = ["h1", "h2"] if k + 1 == levels > 1 else ["h1"]
    if alive is None:
        level = scan.select("row", F.inline(F.arrays_zip("at", "h1"))).join(copies, "row")
    else:
        wanted = stored(alive.join(copies, "row"), "wanted")
        texts = fetch(docs, wanted, ["text"], narrow=False).select("row", "copies", "at", "text")
        level = texts.mapInArrow(_extended(window, k), "row long, copies long, at int, h1 long, h2 int")
        level = stored(level.select("row", "copies", "at", *key), "level")
    # Counted first and stored: a common window's rows can then be dealt out when they meet its count.
    repeated = stored(level.groupBy(*key).agg(F.sum("copies").alias("n")).where("n > 1").select(*key), "repeated")
    # Whole copies go with all their words, so their windows need no marks at the end.
    marked = level.where("copies = 1") if k + 1 == levels else level
    return stored(marked.join(repeated, key, "left_semi").groupBy("row").agg(F.collect_list("at").alias("at")), "alive")


@tidy
def repeated_passages(docs: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text where words went): one row per row of ``docs``.

    A word goes when it lies in a window of ``window`` words whose sequence also
    starts anywhere else, in the same text too.  Null and empty texts have no
    words; texts shorter than a window keep all; repeated rows repeat each
    other.  Other columns are ignored; an empty table gives an empty result.
    """
    docs = documents(docs)
    scan = docs.mapInArrow(_scanned(window), "doc_id long, row long, n_words long, whole_sha256 string, at array<int>, h1 array<long>")
    scan = stored(scan, "scan")
    classes = scan.groupBy("whole_sha256").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.min("n_words").alias("n_words"))
    classes = stored(classes, "copies")
    copies = classes.where(F.col("n_words") >= window).select("row", "copies")
    alive = None
    for k in range(len(level_lengths(window))):
        alive = _level(docs, scan, copies, alive, window, k)
        if alive.isEmpty():
            break
    cut = fetch(docs, alive, ["text"], narrow=False).select("row", "at", "text")
    cut = cut.mapInArrow(_removed(window), "row long, n_removed long, kept_sha256 string, kept_text string")
    cut = stored(cut if with_text else cut.drop("kept_text"), "cut")

    copied = (F.col("copies") > 1) & (F.col("n_words") >= window)
    out = scan.select("row", "doc_id", "n_words", "whole_sha256").join(classes.select("whole_sha256", "copies"), "whole_sha256").join(cut, "row", "left")
    columns = [
        "doc_id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    ]
    out = out.select(*columns, *([F.when(copied, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))
    return stored(out, "passages")
