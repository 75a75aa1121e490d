"""A byte-level convolutional quality classifier in numpy.

Bytes are embedded; filters eight bytes wide run over every second byte of overlapping
chunks that cover the whole text; each filter's largest response in a chunk
makes the chunk's features, and these its logit.  The text's logit combines
the mean and the least of its chunks' logits.  All weights are learned by Adam
on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

EMBED, FILTERS, STEP, TAPS = 6, 24, 2, 4
#: A chunk has so many positions; the next begins half a chunk later.
CHUNK = 256


@dataclass
class Network:
    table: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # TAPS x (STEP * EMBED) x FILTERS
    bias: np.ndarray  # FILTERS
    dense: np.ndarray  # FILTERS
    head: np.ndarray  # bias, weight of the mean, weight of the least logit

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.bias, self.dense, self.head]


def new_network(seed: int) -> Network:
    r = np.random.default_rng(seed)
    width = STEP * EMBED
    return Network(
        r.normal(0, 1.0, (256, EMBED)).astype(np.float32),
        r.normal(0, 1 / np.sqrt(TAPS * width), (TAPS, width, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        r.normal(0, 0.3, FILTERS).astype(np.float32),
        np.array([0.0, 0.5, 0.5], np.float32),
    )


def padded(raw: bytes) -> np.ndarray:
    """Bytes, zero-padded so that at least one chunk of positions exists and the end is covered."""
    half = CHUNK // 2
    positions = max(CHUNK, -(-len(raw) // STEP))
    positions = CHUNK + -(-(positions - CHUNK) // half) * half
    return np.frombuffer(raw.ljust((positions + TAPS - 1) * STEP, b"\0"), np.uint8)


def _responses(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of embedded bytes, and every filter at every position."""
    blocks = net.table[x].reshape(-1, STEP * EMBED)
    n = len(blocks) - TAPS + 1
    out = blocks[:n] @ net.filters[0]
    for k in range(1, TAPS):
        out += blocks[k : k + n] @ net.filters[k]
    return blocks, out


def chunk_logits(net: Network, x: np.ndarray) -> np.ndarray:
    """Logits of all overlapping chunks of a padded text, a bounded stretch at a time."""
    half, maxima = CHUNK // 2, []
    stretch = 64 * half
    for at in range(0, len(x) // STEP - TAPS + 1, stretch):
        _, out = _responses(net, x[at * STEP : (at + stretch + TAPS - 1) * STEP])
        maxima.append(out.reshape(-1, half, FILTERS).max(axis=1))
    halves = np.concatenate(maxima)
    pooled = np.maximum(np.maximum(halves[:-1], halves[1:]) + net.bias, 0)
    return pooled @ net.dense


def probability(net: Network, raw: bytes) -> float:
    z = chunk_logits(net, padded(raw))
    logit = float(net.head[0] + net.head[1] * z.mean() + net.head[2] * z.min())
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def _tops(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response in each half chunk and its place there, a bounded stretch at a time."""
    half, tops, places = CHUNK // 2, [], []
    stretch = 64 * half
    for at in range(0, len(x) // STEP - TAPS + 1, stretch):
        _, out = _responses(net, x[at * STEP : (at + stretch + TAPS - 1) * STEP])
        cells = out.reshape(-1, half, FILTERS)
        places.append(cells.argmax(axis=1))
        tops.append(np.take_along_axis(cells, places[-1][:, None], axis=1)[:, 0])
    return np.concatenate(tops), np.concatenate(places)


def _gradients(net: Network, x: np.ndarray, label: float, weight: float) -> tuple[list[np.ndarray], float]:
    half = CHUNK // 2
    tops, where = _tops(net, x)
    right = tops[1:] > tops[:-1]
    raw = np.where(right, tops[1:], tops[:-1]) + net.bias
    pooled = np.maximum(raw, 0)
    z = pooled @ net.dense
    low = int(z.argmin())
    logit = net.head[0] + net.head[1] * z.mean() + net.head[2] * z[low]
    p = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
    d = weight * (p - label)
    dz = np.full(len(z), d * net.head[1] / len(z), np.float32)
    dz[low] += d * net.head[2]
    d_raw = dz[:, None] * net.dense * (raw > 0)
    cell = np.arange(len(z))[:, None] + right
    at = cell * half + where[cell, np.arange(FILTERS)]
    g_filters, g_table = np.zeros_like(net.filters), np.zeros_like(net.table)
    f = np.broadcast_to(np.arange(FILTERS), at.shape)
    on = d_raw != 0
    at, f, d_on = at[on], f[on], d_raw[on]
    for k in range(TAPS):
        rows = net.table[x[(at + k)[:, None] * STEP + np.arange(STEP)]].reshape(-1, STEP * EMBED)
        part = np.zeros((FILTERS, STEP * EMBED), np.float32)
        np.add.at(part, f, rows * d_on[:, None])
        g_filters[k] = part.T
        back = d_on[:, None] * net.filters[k][:, f].T
        for s in range(STEP):
            np.add.at(g_table, x[(at + k) * STEP + s], back[:, s * EMBED : (s + 1) * EMBED])
    loss = -weight * (np.log(p + 1e-9) if label else np.log(1 - p + 1e-9))
    return [g_table, g_filters, d_raw.sum(axis=0), pooled.T @ dz, np.array([d, d * z.mean(), d * z[low]], np.float32)], float(loss)


def train(samples: list[tuple[bytes, int]], epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam over the samples; both labels weigh the same in all."""
    net = new_network(seed)
    if not samples:
        net.head[:] = 0
        return net
    r = np.random.default_rng(seed)
    ones = sum(y for _, y in samples)
    share = {1: 0.5 * len(samples) / max(1, ones), 0: 0.5 * len(samples) / max(1, len(samples) - ones)}
    xs = [(padded(t), y) for t, y in samples]
    first, second, turn = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    steps = epochs * -(-len(xs) // batch)
    for _ in range(epochs):
        order = r.permutation(len(xs))
        for i in range(0, len(order), batch):
            total = None
            picked = order[i : i + batch]
            for k in picked:
                g, _ = _gradients(net, xs[k][0], xs[k][1], share[xs[k][1]])
                total = g if total is None else [a + b for a, b in zip(total, g, strict=True)]
            turn += 1
            step = rate * (1 - turn / (steps + 1))
            for p, g, m, v in zip(net.parts(), total, first, second, strict=True):
                g = g / len(picked)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (step * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = 500) -> list[tuple[bytes, int]]:
    """At most ``per_label`` texts of each label, of the rows with the smallest MD5 of id and text.

    ``labels`` has doc_id and quality (0 or 1; of several the largest counts).
    ``per_label`` bounds the rows; their texts are learned whole.  Null texts are empty; rows with a null doc_id have no label; repeated rows
    are learned once; other columns are ignored.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.md5(F.col("text").cast("binary")))))
    keys = rows.select("doc_id", "key").join(marked, "doc_id").select("key", "label").distinct()
    picked = keys.where("label = 0").orderBy("key").limit(per_label).unionByName(keys.where("label = 1").orderBy("key").limit(per_label))
    # At most 2 * per_label rows; a key is of one id and text.
    found = rows.join(F.broadcast(picked), "key").dropDuplicates(["key"]).select("key", "text", "label").collect()
    return [(kernels.encode(r["text"]), int(r["label"])) for r in sorted(found, key=lambda r: r["key"])]


def _scored(net: Network, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([probability(net, t) for t in kernels.raw_texts(batch.column("text"))], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in extra], score], names=[*extra, "score"])

    return run


def score(docs: DataFrame, net: Network, keep: dict[str, str]) -> DataFrame:
    """The columns of ``docs`` named in ``keep`` (name -> type) and ``score``, 0 to 1, one row per row.

    Null and empty texts are scored as an empty text; nothing but ``text`` is
    an input.  ``docs`` may hold any other columns.
    """
    rows = docs.select(*[F.col(k).cast(t).alias(k) for k, t in keep.items()], *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))
    return rows.mapInArrow(_scored(net, list(keep)), ", ".join([*[f"`{k}` {t}" for k, t in keep.items()], "score double"]))
