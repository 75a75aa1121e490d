"""NRRD volumes: scans by mapInArrow over binaryFile, and a writer for one frame's bytes."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# NRRD type names and their numpy types.
TYPES = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "uint": "u4", "unsigned int": "u4", "uint32": "u4"}


def decode(raw: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(z, y, x) samples and header fields of a raw or gzip NRRD."""
    head, body = raw.split(b"\n\n", 1)
    lines = head.decode("ascii").splitlines()
    if not lines[0].startswith("NRRD"):
        raise ValueError("not NRRD")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line and not line.startswith("#"))
    if fields["encoding"] in ("gzip", "gz"):
        body = gzip.decompress(body)
    order = ">" if fields.get("endian") == "big" else "<"
    shape = [int(n) for n in fields["sizes"].split()][::-1]
    return np.frombuffer(body, order + TYPES[fields["type"]], int(np.prod(shape))).reshape(shape), fields


def encode(volume: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), packed: bool = False) -> bytes:
    kind = {1: "uint8", 2: "uint16", 4: "uint32"}[volume.dtype.itemsize]
    sizes, steps = " ".join(str(n) for n in volume.shape[::-1]), " ".join(f"{s:g}" for s in spacing)
    head = f"NRRD0001\ntype: {kind}\ndimension: {volume.ndim}\nsizes: {sizes}\nspacings: {steps}\nencoding: {'gzip' if packed else 'raw'}\nendian: little\n\n"
    body = np.ascontiguousarray(volume, volume.dtype.newbyteorder("<")).tobytes()
    return head.encode("ascii") + (gzip.compress(body, mtime=0) if packed else body)


def _voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, cell in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            volume, _ = decode(cell.as_buffer().to_pybytes())
            for z, plane in enumerate(volume):
                y, x = np.nonzero(plane)
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *[pa.array(np.asarray(a, np.int32)) for a in (np.full(n, z), y, x)], pa.array(plane[y, x].astype(np.int64))], names=["path", "z", "y", "x", "v"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, t, z, y, x, v of samples that are not zero; t is the last number in the file's name.

    One file is one frame and one task; planes leave it one at a time.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_voxels, "path string, z int, y int, x int, v long")
    return rows.withColumn("t", F.coalesce(F.regexp_extract("path", r"(\d+)\D*$", 1).try_cast("int"), F.lit(0)))
