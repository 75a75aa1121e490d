"""Language identification by compression with per-language raw-content dictionaries.

A lower-cased text is cut into pieces of ``PIECE`` bytes; each piece is compressed by
zstandard once with each language's dictionary, and the language whose sizes
sum to the least is chosen.  Where the runner-up is within ``margin`` of it,
the choice is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels

PIECE, LEVEL = 1024, 6
UNKNOWN = "und"


def learn_dictionaries(docs: DataFrame, per_language: int = 300, chunk_chars: int = 512, chunks: int = 220) -> dict[str, bytes]:
    """lang -> raw content, from ``docs`` (doc_id, lang, text).

    The sample is bounded: ``per_language`` rows for each language, those of
    the smallest MD5 of id and text, and of all chunks of ``chunk_chars``
    characters that make up their whole texts ``chunks``, those of the smallest
    MD5 again.  Rows with a null text or lang teach nothing; repeated rows
    teach once; null and repeated ids are rows like others; other columns are
    ignored.  A dictionary's size is bounded by ``chunks * chunk_chars`` alone:
    no language shortens another's, and one of few texts has a short one.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.where("text is not null and lang is not null").select("lang", F.col("text").cast("string").alias("text"), ident.alias("ident"))
    rows = rows.select("lang", "text", F.md5(F.concat("ident", F.lit("|"), F.md5(F.col("text").cast("binary")))).alias("key"))
    first = lambda key: F.row_number().over(Window.partitionBy("lang").orderBy(key))
    picked = rows.select("lang", "key").distinct().withColumn("n", first("key")).where(F.col("n") <= per_language).drop("n")
    # At most per_language rows for each language.
    texts = rows.join(F.broadcast(picked), ["lang", "key"]).dropDuplicates(["lang", "key"])
    last = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / chunk_chars).cast("int")
    parts = texts.select("lang", "key", "text", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    parts = parts.select("lang", F.md5(F.concat_ws("|", "key", "k")).alias("key"), F.expr(f"substring(text, k * {chunk_chars} + 1, {chunk_chars})").alias("part"))
    found: dict[str, list] = {}
    for r in parts.withColumn("n", first("key")).where(F.col("n") <= chunks).select("lang", "key", "part").collect():
        found.setdefault(r["lang"], []).append((r["key"], r["part"]))
    return {lang: b"\n".join(kernels.encode(t.lower()) for _, t in sorted(of)).ljust(8, b" ") for lang, of in sorted(found.items())}


def compressors(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries.values():
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def sizes(raw: bytes, tools: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Compressed bytes of the whole text with each dictionary."""
    total = np.zeros(len(tools))
    for i in range(0, len(raw), PIECE):
        part = raw[i : i + PIECE]
        total += [len(t.compress(part)) for t in tools]
    return total


def choose(raw: bytes, names: list[str], tools: list[zstandard.ZstdCompressor]) -> tuple[str, float, float]:
    """Language, score and margin (the runner-up's excess as a share of the best)."""
    size = sizes(raw, tools)
    best = int(np.argmin(size))
    others = np.delete(size, best)
    if not len(others):
        return names[best], 1.0, 1.0
    margin = float((others.min() - size[best]) / size[best])
    share = 1.0 / np.exp2(-np.minimum(60.0, (size - size[best]) / max(1.0, len(raw) / PIECE))).sum()
    return names[best], float(share), margin


def _predicted(dictionaries: dict[str, bytes], margin: float, reject: bool):
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(dictionaries)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                if not text or not names or not any(map(str.isalpha, text)):
                    rows.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                name, score, apart = choose(kernels.encode(text.lower()), names, tools)
                narrow = apart < margin
                rows.append((UNKNOWN if narrow and reject else name, score, apart, narrow))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("doc_id", "held_out")], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "held_out", "lang_pred", "score", "margin", "narrow"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01, reject: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, narrow: one row per row of ``docs`` (doc_id, text, held_out).

    ``und`` for null or empty texts and those without a letter (category L), and, with
    ``reject``, where the margin is narrower than ``margin`` (``narrow``).  The
    score is the softmax of the bytes saved on an average piece; ties take the
    first language by name.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    return rows.mapInArrow(_predicted(dictionaries, margin, reject), "doc_id long, held_out boolean, lang_pred string, score double, margin double, narrow boolean")


def held_out(mod: int, rest: int):
    """Whether crc32(doc_id as text) mod ``mod`` is ``rest``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest
