"""PNG slices, TIFF stacks and DICOM images: scans by mapInArrow over binaryFile, and writers for one frame's bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dicom

# The PNG signature, samples of each PNG colour type, bytes of each TIFF field type.
PNG = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}


def _unfiltered(raw: bytes, height: int, line: int, step: int) -> np.ndarray:
    """Rows of a PNG with their filters undone."""
    rows = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
    out = np.zeros((height + 1, line), np.uint8)
    for y in range(height):
        kind, row, above = int(rows[y, 0]), rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = row
        elif kind == 1:
            # Sums along each sample's own byte.
            wide = np.pad(row, (0, -line % step)).reshape(-1, step)
            out[y + 1] = np.cumsum(wide, axis=0, dtype=np.uint8).reshape(-1)[:line]
        elif kind == 2:
            out[y + 1] = row + above
        else:
            here, up, left = row.astype(int).tolist(), above.astype(int).tolist(), [0] * (line + step)
            for x in range(line):
                a, b, c = left[x], up[x], up[x - step] if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                left[x + step] = (here[x] + guess) & 255
            out[y + 1] = left[step:]
    return out[1:]


def decode_png(raw: bytes) -> np.ndarray:
    """(y, x) samples of an 8- or 16-bit PNG that is not interlaced; of several channels the first."""
    if raw[:8] != PNG:
        raise ValueError("not PNG")
    at, packed, head = 8, [], None
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", raw, at + 8)
        elif kind == b"IDAT":
            packed.append(raw[at + 8 : at + 8 + size])
        at += size + 12
    width, height, bits, colour, _, _, interlaced = head
    if bits not in (8, 16) or colour not in SAMPLES or interlaced:
        raise ValueError("only 8- and 16-bit PNG without palette or interlacing is read")
    step = SAMPLES[colour] * bits // 8
    rows = _unfiltered(zlib.decompress(b"".join(packed)), height, width * step, step)
    return rows.view(">u2" if bits == 16 else "u1").reshape(height, width, SAMPLES[colour])[:, :, 0]


def encode_png(plane: np.ndarray) -> bytes:
    """A grey PNG of 8 or 16 bits."""
    bits = 8 * plane.dtype.itemsize
    rows = np.ascontiguousarray(plane, ">u2" if bits == 16 else "u1").view(np.uint8).reshape(len(plane), -1)
    body = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes())
    head = struct.pack(">IIBBBBB", plane.shape[1], plane.shape[0], bits, 0, 0, 0, 0)
    parts = [(b"IHDR", head), (b"IDAT", body), (b"IEND", b"")]
    return PNG + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def _lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes from 9 bits up, high bit first; 256 clears, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = table[:258], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last, width = word, 9 + (len(table) > 510) + (len(table) > 1022) + (len(table) > 2046)
    return bytes(out)


def _packbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def _directories(raw: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and whole-number fields of each page of a TIFF or BigTIFF."""
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    big = struct.unpack_from(order + "H", raw, 2)[0] == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    at = struct.unpack_from(order + word, raw, 8 if big else 4)[0]
    while at:
        n = struct.unpack_from(order + count, raw, at)[0]
        at += struct.calcsize("=" + count)
        fields = {}
        for k in range(n):
            tag, kind, size = struct.unpack_from(order + "HH" + word, raw, at + k * entry)
            if kind in FIELD:
                place, form = at + k * entry + (12 if big else 8), f"{order}{size}{FIELD[kind]}"
                if struct.calcsize(form) > (8 if big else 4):
                    place = struct.unpack_from(order + word, raw, place)[0]
                fields[tag] = list(struct.unpack_from(form, raw, place))
        yield order, fields
        at = struct.unpack_from(order + word, raw, at + n * entry)[0]


def tiff_pages(raw: bytes) -> Iterator[np.ndarray]:
    """(y, x) samples of each page: 8 or 16 bits in strips, plain, LZW, Deflate or PackBits; of several channels the first."""
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}
    for order, f in _directories(raw):
        width, height, bits, channels = f[256][0], f[257][0], f.get(258, [1])[0], f.get(277, [1])[0]
        if bits not in (8, 16) or 273 not in f or f.get(259, [1])[0] not in unpack or f.get(284, [1])[0] != 1:
            raise ValueError("only 8- and 16-bit TIFF in strips is read")
        body = b"".join(unpack[f.get(259, [1])[0]](raw[a : a + n]) for a, n in zip(f[273], f[279], strict=True))
        page = np.frombuffer(body, f"{order}u{bits // 8}", width * height * channels).reshape(height, width, channels)
        if f.get(317, [1])[0] == 2:
            page = np.cumsum(page, axis=1, dtype=page.dtype.newbyteorder("="))
        yield page[:, :, 0]


def encode_tiff(volume: np.ndarray, packed: bool = False) -> bytes:
    """A grey stack of 8 or 16 bits, one strip a page, plain or Deflate."""
    bits, out, links = 8 * volume.dtype.itemsize, bytearray(b"II*\0\0\0\0\0"), 4
    for plane in volume:
        body = np.ascontiguousarray(plane, f"<u{bits // 8}").tobytes()
        body = zlib.compress(body) if packed else body
        at = len(out)
        out += body + b"\0" * (len(body) % 2)
        struct.pack_into("<I", out, links, len(out))
        h, w = plane.shape
        fields = [(256, w), (257, h), (258, bits), (259, 8 if packed else 1), (262, 1), (273, at), (277, 1), (278, h), (279, len(body))]
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in fields)
        links = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def _planes(raw: bytes) -> tuple[int, Iterator[np.ndarray]]:
    """Number of the first plane and the planes of a PNG, DICOM or TIFF file."""
    if raw[:8] == PNG:
        return 0, iter([decode_png(raw)])
    return dicom.frames(raw) if dicom.is_dicom(raw) else (0, tiff_pages(raw))


def _voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, cell in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            first, planes = _planes(cell.as_buffer().to_pybytes())
            for page, plane in enumerate(planes, first):
                y, x = np.nonzero(plane)
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *[pa.array(np.asarray(a, np.int32)) for a in (np.full(n, page), y, x)], pa.array(plane[y, x].astype(np.int64))], names=["path", "page", "y", "x", "v"])


def read(spark: SparkSession, path: str, time: str = r"t(\d+)", channel: str = r"c(?:h)?(\d+)", depth: str = r"z(\d+)") -> DataFrame:
    """path, t, c, z, y, x, v of samples that are not zero, from the PNG, TIFF and DICOM files at ``path``.

    t, c and z are the numbers that the patterns find in a file's name, 0
    where they find none; z counts on over the pages of a stack, or from a
    DICOM file's instance number.  One file is one row of a task, and pages
    leave it one at a time.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_voxels, "path string, page int, y int, x int, v long")
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    number = lambda p: F.coalesce(F.regexp_extract(name, p, 1).try_cast("int"), F.lit(0))
    return rows.select("path", number(time).alias("t"), number(channel).alias("c"), (number(depth) + F.col("page")).alias("z"), "y", "x", "v")


def _encoded(form: str, dims: tuple[int, int, int], bits: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        volume = np.zeros(dims, f"u{bits // 8}")
        volume[pdf["z"], pdf["y"], pdf["x"]] = pdf["v"]
        if form == "tiff":
            return pd.DataFrame({"t": [key[0]], "c": [key[1]], "z": [0], "content": [encode_tiff(volume, packed=True)]})
        return pd.DataFrame({"t": key[0], "c": key[1], "z": range(dims[0]), "content": [encode_png(p) for p in volume]})

    return run


def encoded(vox: DataFrame, dims: tuple[int, int, int], form: str = "tiff", bits: int = 8) -> DataFrame:
    """t, c, z, content: one TIFF stack a frame and channel, or one PNG a slice."""
    rows = vox.select("t", "c", "z", "y", "x", "v")
    return rows.groupBy("t", "c").applyInPandas(_encoded(form, dims, bits), "t int, c int, z int, content binary")
