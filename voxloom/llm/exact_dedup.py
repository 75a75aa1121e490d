"""Exact duplicates by composable polynomial fingerprints.

A chunk of bytes b_1..b_n has, in each of four lanes, the fingerprint
sum(b_i * r**(n-i)) modulo 2**31 - 1.  Fingerprints combine: that of two joined
runs is ``left * r**len(right) + right``, so chunks are hashed on their own and
the order of combining is free: a chunk's share of its text's fingerprint is its
own, shifted by the bytes that follow.  Texts of one chunk are hashed where they
are read; the chunks of longer ones are dealt to tasks and their shares summed.
Texts whose fingerprints and lengths agree are then compared byte by byte with
the text that stays, chunk rows again, so no task holds two whole texts.
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

PRIME, CHUNK = (1 << 31) - 1, 1 << 16
#: Members that are compared with one copy of the text that stays.
MEMBERS = 64
_BASES = [int(c >> np.uint64(34)) + 257 for c in kernels.constants(4, 31)]


def _tables() -> np.ndarray:
    rows = []
    for r in _BASES:
        row, x = np.empty(CHUNK, np.int64), 1
        for i in range(CHUNK - 1, -1, -1):
            row[i], x = x, x * r % PRIME
        rows.append(row)
    return np.stack(rows)


_weights: np.ndarray | None = None


def normalised(raw: bytes) -> bytes:
    """Each run of white space becomes one space."""
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[:1].isspace() else b"") + b" ".join(words) + (b" " if raw[-1:].isspace() else b"")


def chunk_fingerprint(chunk: bytes) -> tuple[int, ...]:
    """The four lanes of one chunk of at most CHUNK bytes."""
    global _weights
    if _weights is None:
        _weights = _tables()
    x = np.frombuffer(chunk, np.uint8).astype(np.int64)
    return tuple(int(v) % PRIME for v in _weights[:, CHUNK - len(x) :] @ x)


def combined(left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
    """Fingerprint of two joined runs from theirs and the length of the second."""
    return tuple((a * pow(r, right_length, PRIME) + b) % PRIME for a, b, r in zip(left, right, _BASES, strict=True))


def shifted(lanes: tuple[int, ...], after: int) -> tuple[int, ...]:
    """A chunk's share of its text's fingerprint, ``after`` bytes following it."""
    return tuple(a * pow(r, after, PRIME) % PRIME for a, r in zip(lanes, _BASES, strict=True))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, with its lanes when it is one chunk; else a row for each of its chunks as well."""
    for batch in batches:
        out, held = [], 0
        for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), kernels.raw_texts(batch.column("text")), strict=True):
            raw = normalised(text)
            whole = len(raw) <= CHUNK
            out.append((doc, row, len(raw), sha256(raw).hexdigest(), *(chunk_fingerprint(raw) if whole else [None] * 4), None, None))
            for i in range(0, 0 if whole else len(raw), CHUNK):
                part = raw[i : i + CHUNK]
                out.append((None, row, None, None, *[None] * 4, len(raw) - i - len(part), part))
                held += len(part)
                if held > kernels.SLICE_BYTES:
                    yield kernels.batch_of(out, _READ)
                    out, held = [], 0
        yield kernels.batch_of(out, _READ)


_READ = {"doc_id": pa.int64(), "row": pa.int64(), "n_bytes": pa.int64(), "text_sha256": pa.string(), **{f"l{k}": pa.int64() for k in range(4)}, "after": pa.int64(), "chunk": pa.binary()}
_LANES = [f"l{k}" for k in range(4)]


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = zip(batch.column("row").to_pylist(), batch.column("after").to_pylist(), batch.column("chunk"), strict=True)
        out = [(row, *shifted(chunk_fingerprint(part.as_buffer().to_pybytes()), after)) for row, after, part in parts]
        yield kernels.batch_of(out, {"row": pa.int64(), **dict.fromkeys(_LANES, pa.int64())})


@tidy
def fingerprinted(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_bytes, text_sha256, fp1, fp2 (two lanes each), stored, of every row of ``docs`` (doc_id, row, text)."""
    shape = "doc_id long, row long, n_bytes long, text_sha256 string, l0 long, l1 long, l2 long, l3 long, after long, chunk binary"
    read = stored(docs.mapInArrow(_read, shape), "fingerprints")
    chunks = read.where("chunk is not null").select("row", "after", "chunk").repartition("row", "after")
    shares = chunks.mapInArrow(_shares, "row long, l0 long, l1 long, l2 long, l3 long")
    sums = shares.groupBy("row").agg(*[(F.sum(k) % PRIME).alias(f"s{k}") for k in _LANES])
    rows = read.where("chunk is null").drop("after", "chunk").join(sums, "row", "left")
    lanes = [F.coalesce(k, f"s{k}") for k in _LANES]
    two = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b)
    return stored(rows.select("row", "doc_id", "n_bytes", "text_sha256", two(*lanes[:2]).alias("fp1"), two(*lanes[2:]).alias("fp2")), "rows")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The normalised text's chunks, one to a row; an empty text is one empty chunk."""
    kinds = {"row": pa.int64(), "first": pa.bool_(), "piece": pa.string(), "at": pa.int64(), "chunk": pa.binary()}
    for batch in batches:
        out, held = [], 0
        for row, first, piece, text in zip(*[batch.column(k).to_pylist() for k in ("row", "first", "piece")], kernels.raw_texts(batch.column("text")), strict=True):
            raw = normalised(text)
            for at in range(0, max(1, len(raw)), CHUNK):
                out.append((row, first, piece, at, raw[at : at + CHUNK]))
                held += len(out[-1][-1])
                if held > kernels.SLICE_BYTES:
                    yield kernels.batch_of(out, kinds)
                    out, held = [], 0
        yield kernels.batch_of(out, kinds)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows sorted by piece and place, the chunk of the text that stays first; only that one is held."""
    key, stays = None, b""
    for batch in batches:
        same = []
        for piece, at, first, cell in zip(*[batch.column(k).to_pylist() for k in ("piece", "at", "first")], batch.column("chunk"), strict=True):
            view = memoryview(cell.as_buffer()).cast("B")
            if first and key != (piece, at):
                key, stays = (piece, at), memoryview(bytes(view))
            same.append(key == (piece, at) and stays == view)
        yield batch.select(["row", "first"]).append_column("same", pa.array(same, pa.bool_()))


@tidy
def exact_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Of texts that are equal after white-space runs become one space, the row
    with the smallest doc_id stays (of rows that share that id, one).  Null
    counts as empty; a null doc_id stays only where its whole group has none.
    ``row`` names a column of stored, distinct longs, which comes back as ``row``.
    Other columns are ignored; an empty table gives an empty result.
    """
    docs = documents(docs, row)
    rows = fingerprinted(docs)
    key = ["fp1", "fp2", "n_bytes"]
    open_rows, settled = rows.select("row", "doc_id", *key), []
    while True:
        # One pass unless two different texts share all lanes; such texts take part in the next.
        best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("best")
        groups = stored(open_rows.groupBy(*key).agg(F.count("*").alias("n"), best).where("n > 1"), "groups")
        member = open_rows.join(groups, key).withColumn("first", F.col("row") == F.col("best.row"))
        pieces = F.ceil(F.col("n") / MEMBERS).cast("int")
        spread = F.when(F.col("first"), F.sequence(F.lit(0), pieces - 1)).otherwise(F.array(F.pmod(F.col("row"), pieces).cast("int")))
        member = member.withColumn("part", F.explode(spread)).withColumn("piece", F.concat_ws("|", *key, "part"))
        wanted = stored(member.select("row", "first", "piece"), "members")
        texts = fetch(docs, wanted, ["text"]).select("row", "first", "piece", "text")
        chunks = texts.mapInArrow(_chunks, "row long, first boolean, piece string, at long, chunk binary")
        chunks = chunks.repartition("piece", "at").sortWithinPartitions("piece", "at", F.col("first").desc())
        compared = chunks.mapInArrow(_compared, "row long, first boolean, same boolean")
        compared = stored(compared.groupBy("row").agg(F.min("same").alias("same")), "compared")
        settled.append(open_rows.join(groups, key).join(compared.where("same"), "row", "left_semi").select("row", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")))
        differ = compared.where("not same")
        if differ.isEmpty():
            break
        open_rows = stored(open_rows.join(differ, "row", "left_semi"), "open")
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    found = stored(found, "settled")
    sizes = stored(found.groupBy("keep_row").agg(F.count("*").alias("group_size")), "sizes")
    found = found.join(sizes, "keep_row")
    out = rows.select("row", "doc_id", "text_sha256").join(found, "row", "left")
    alone = F.col("keep_row").isNull()
    out = out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"),
        "text_sha256",
        *([] if row is None else ["row"]),
    )
    return stored(out, "exact_duplicates")
