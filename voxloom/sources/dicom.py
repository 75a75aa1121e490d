"""Uncompressed DICOM images: fields and frames of one file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: transfer syntaxes that store plain little-endian
# samples, types with a long length field, and delimiters.
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
LONG = {b"OB", b"OD", b"OF", b"OL", b"OW", b"SQ", b"UC", b"UN", b"UR", b"UT"}
ITEM, ITEM_END, SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
SYNTAX, PIXELS = (0x0002, 0x0010), (0x7FE0, 0x0010)
SAMPLES, FRAMES, ROWS, COLUMNS, BITS, SIGNED, INSTANCE = (0x0028, 0x0002), (0x0028, 0x0008), (0x0028, 0x0010), (0x0028, 0x0011), (0x0028, 0x0100), (0x0028, 0x0103), (0x0020, 0x0013)
OPEN = 0xFFFFFFFF


def is_dicom(raw: bytes) -> bool:
    return raw[128:132] == b"DICM"


def _head(raw: bytes, at: int, explicit: bool) -> tuple[tuple[int, int], int, int]:
    """Tag, length and place of the value of the element at ``at``."""
    tag = struct.unpack_from("<HH", raw, at)
    if tag[0] == 0xFFFE or not explicit:
        return tag, struct.unpack_from("<I", raw, at + 4)[0], at + 8
    if raw[at + 4 : at + 6] in LONG:
        return tag, struct.unpack_from("<I", raw, at + 8)[0], at + 12
    return tag, struct.unpack_from("<H", raw, at + 6)[0], at + 8


def _skip_open(raw: bytes, at: int, explicit: bool, end: tuple[int, int]) -> int:
    """Place behind a sequence or item of open length."""
    while True:
        tag, size, at = _head(raw, at, explicit)
        if tag == end:
            return at
        if size == OPEN:
            at = _skip_open(raw, at, explicit, ITEM_END if tag == ITEM else SEQUENCE_END)
        else:
            at += size


def fields(raw: bytes) -> dict[tuple[int, int], bytes]:
    """Values of the top-level elements; sequences are passed over."""
    if not is_dicom(raw):
        raise ValueError("not DICOM")
    out, at, explicit = {}, 132, True
    while at + 8 <= len(raw):
        if struct.unpack_from("<H", raw, at)[0] != 2:
            syntax = out.get(SYNTAX, EXPLICIT.encode()).rstrip(b"\0 ").decode("ascii")
            if syntax not in (IMPLICIT, EXPLICIT):
                raise ValueError(f"transfer syntax {syntax} is not read")
            explicit = syntax == EXPLICIT
        tag, size, at = _head(raw, at, explicit)
        if size == OPEN:
            at = _skip_open(raw, at, explicit, SEQUENCE_END)
            continue
        out[tag] = raw[at : at + size]
        at += size
    return out


def frames(raw: bytes) -> tuple[int, Iterator[np.ndarray]]:
    """Number of the first frame (instance number less one) and (y, x) samples of each; of several samples a pixel the first."""
    f = fields(raw)
    short = lambda tag, default: struct.unpack("<H", f[tag])[0] if tag in f else default
    whole = lambda tag, default: int(f[tag].strip(b"\0 ") or default) if tag in f else default
    h, w, n, per = short(ROWS, 0), short(COLUMNS, 0), whole(FRAMES, 1), short(SAMPLES, 1)
    kind = np.dtype(f"<{'i' if short(SIGNED, 0) else 'u'}{short(BITS, 8) // 8}")
    a = np.frombuffer(f[PIXELS], kind, n * h * w * per).reshape(n, h, w, per)
    return max(0, whole(INSTANCE, 1) - 1), iter(a[..., 0])
