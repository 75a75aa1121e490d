"""Vectorised byte and word helpers that run inside Spark tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D.  Texts are
handled in slices of about ``SLICE_BYTES`` so a task's memory stays bounded
whatever the batch holds; one text longer than that forms its own slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants, the same on every machine."""
    x = mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))
    return x | _U(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def encode(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 of an Arrow string column's cells, one at a time; null is empty."""
    for cell in column:
        yield cell.as_buffer().to_pybytes() if cell.is_valid else b""


def batch_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as a batch of the columns named in ``kinds``."""
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as bytes) in slices of bounded size."""
    at, held, size = 0, [], 0
    for i, raw in enumerate(raw_texts(column)):
        if held and size + len(raw) > SLICE_BYTES:
            yield at, held
            at, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield at, held


def word_hashes(texts: list[bytes], lower: bool = False, lanes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (``lanes`` rows of 64 bits), and where each text's words begin (one more entry than texts).

    A word's hash adds up a mixed value of each letter and its place, so no
    algebra of letter patterns can make two words agree but by 64-bit chance;
    lanes are independent of each other.
    """
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    none = np.zeros((lanes, 0), _U)
    if not len(buf):
        return none, np.zeros(len(texts) + 1, np.int64)
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    if len(edge) % 2:
        edge = np.append(edge, len(buf))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    if not len(start):
        return none, first
    size = end - start
    at = np.flatnonzero(inside)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    letters = buf[at]
    if lower:
        letters = _LOWER[letters]
    place = (np.arange(len(at)) - np.repeat(begin, size)).astype(_U) << _U(8) | letters
    place *= _U(0x9E3779B97F4A7C15)
    out = np.empty((lanes, len(start)), _U)
    for lane in range(lanes):
        out[lane] = mix(np.add.reduceat(mix(place ^ constants(lanes, 17)[lane]), begin) + size.astype(_U))
    return out, first


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every window of ``width`` words; windows may span texts, so the caller picks starts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for k, c in enumerate(constants(width, 1000 + seed)):
        total += words[k : k + n] * c
    return mix(total)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; a shorter text is one shingle."""
    (words,), first = word_hashes(texts, lower=True)
    runs = window_hashes(words, width)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], int(b - a), seed=int(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out
