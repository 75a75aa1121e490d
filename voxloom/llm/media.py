"""Media columns: Netpbm and BMP bytes, numpy tiles and difference hashes.

``decode`` reads binary PGM and PPM (maxval below 256) and uncompressed 8- and
24-bit BMP; ``encode_pgm`` and ``encode_bmp`` write them.  ``area_resize``
averages over exact areas by an integral image.  Tiles are NPY bytes.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .storage import stored, tidy

WIDTH, TILE = 64, (8, 9)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey, rows from the bottom, each padded to four bytes."""
    h, w = image.shape
    rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
    rows[:, :w] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", 1078 + rows.size, 0, 0, 1078)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def _netpbm(raw: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    w, h, most = fields
    if most > 255:
        raise ValueError("only 8-bit Netpbm is read")
    shape = (h, w) if raw[:2] == b"P5" else (h, w, 3)
    return np.frombuffer(raw, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)


def _bmp(raw: bytes) -> np.ndarray:
    offset, w, h, _, bits, packed = struct.unpack_from("<I4xiiHHI", raw, 10)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP is read")
    line = -(-w * bits // 32) * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(h), offset).reshape(abs(h), line)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 24:
        return rows.reshape(abs(h), w, 3)[:, :, ::-1]
    colours = (offset - 14 - struct.unpack_from("<I", raw, 14)[0]) // 4
    palette = np.frombuffer(raw, np.uint8, 4 * colours, 14 + struct.unpack_from("<I", raw, 14)[0]).reshape(-1, 4)
    if colours == 256 and (palette[:, :3] == np.arange(256)[:, None]).all():
        return rows
    return palette[rows][:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) of unsigned bytes."""
    if raw[:2] in (b"P5", b"P6"):
        return _netpbm(raw)
    if raw[:2] == b"BM":
        return _bmp(raw)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Mean over each target cell's exact area, also where cells are smaller than a sample."""
    sums = image.astype(np.float64)
    for axis, (have, want) in enumerate(zip(image.shape, shape, strict=False)):
        total = np.insert(np.cumsum(sums, axis=axis), 0, 0.0, axis=axis)
        edge = np.arange(want + 1) * (have / want)
        low = np.minimum(edge.astype(int), have - 1)
        part = (edge - low).reshape([-1 if k == axis else 1 for k in range(sums.ndim)])
        at = np.take(total, low, axis=axis) + part * (np.take(total, low + 1, axis=axis) - np.take(total, low, axis=axis))
        sums = np.diff(at, axis=axis) / (have / want)
    return sums


def tile(image: np.ndarray) -> np.ndarray:
    grey = image if image.ndim == 2 else image.mean(axis=2)
    return np.floor(area_resize(grey, TILE) + 0.5).astype(np.uint8)


def difference_hash(small: np.ndarray) -> str:
    """16 hex digits: whether each sample is below its right neighbour, row by row."""
    bits = np.packbits(small[:, :-1] < small[:, 1:])
    return bits.tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def _stored_form(form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = encode_pgm if form == "pgm" else encode_bmp
        for batch in batches:
            for at, texts in kernels.slices(batch.column("text")):
                media = [to(np.frombuffer(raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0"), np.uint8).reshape(-1, WIDTH)) for raw in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary())]
    for batch in batches:
        rows = []
        for cell in batch.column("media"):
            raw = cell.as_buffer().to_pybytes()
            image = decode(raw)
            payload, small = image.tobytes(), tile(image)
            rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), sha256(raw).hexdigest(), difference_hash(small), npy(small)))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", *[n for n, _ in kinds]])


def text_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 as a grey image 64 samples wide, zero-padded to whole rows.

    Null and empty texts make one row of zeros; null and repeated ids are rows
    like others; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_stored_form(form), "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests, NPY tile and difference hash of each ``media`` cell, as read back."""
    return media.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")


@tidy
def stored_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """``text_media`` written as a table and read again, then ``media_features`` of it, stored; the media go at the end."""
    return stored(media_features(stored(text_media(docs, form), "media")), "features")
