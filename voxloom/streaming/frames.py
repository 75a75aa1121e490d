"""Frames as finite streams, and event-time windows (an addition of this library)."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def per_frame(frames: DataFrame, tasks: list[Callable[[DataFrame], DataFrame]], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs every task over each micro-batch of a frame stream and hands its rows to ``sink`` (idempotent by batch id)."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        for task in tasks:
            sink(task(df), number)
        df.unpersist()

    return frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, event_type, n, total of tumbling windows; works on streams (with the watermark) and tables alike."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def frame_changes(frames: DataFrame) -> DataFrame:
    """t, c, brick, n, kept, gone, new of a stream of frames (t, c, brick, place, label): labelled places against those of the frame before.

    The state of a brick is its last frame alone; frames come in order of t,
    and one that is not later than the last is left out.  ``kept`` places have
    the same label as before.  Append mode.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (-1, b"")
        before = pickle.loads(held) if held else {}
        rows = pd.concat(list(batches), ignore_index=True).sort_values("t")
        out = []
        for t, part in rows.groupby("t"):
            if t <= last:
                continue
            now = dict(zip(part["place"].tolist(), part["label"].tolist(), strict=True))
            kept = sum(before.get(p) == v for p, v in now.items())
            out.append((int(t), *key, len(now), kept, len(before.keys() - now.keys()), len(now.keys() - before.keys())))
            last, before = int(t), now
        state.update((last, pickle.dumps(before)))
        yield pd.DataFrame(out, columns=["t", "c", "brick", "n", "kept", "gone", "new"])

    shape = "t int, c int, brick int, n long, kept long, gone long, new long"
    return frames.groupBy("c", "brick").applyInPandasWithState(step, shape, "t int, held binary", "append", GroupStateTimeout.NoTimeout)


def results_by_frame(frames: DataFrame) -> DataFrame:
    """t, c, task, obj, value, n: the growing table of results, a row updated whenever its frame brings more (update mode).

    ``frames`` has t, c, task, obj and value; the last value by ``seq`` counts.
    """
    best = F.max_by("value", "seq").alias("value")
    return frames.groupBy("t", "c", "task", "obj").agg(best, F.count("*").alias("n"))
