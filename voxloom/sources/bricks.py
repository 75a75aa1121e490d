"""Bricked volumes of several levels, listed by an XML file, as a Spark data source.

The XML's root BRK (nChannel, nFrame, nLevel) holds an element Level a level;
it lists its Bricks, with their places and sizes, and the Files that hold
them by frame, channel and brick.  Bricks are raw or zlib-packed
little-endian samples, x first, in files of their own or in ranges of larger ones.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import volumes

AXES = ("z", "y", "x")
NAMES = ("t", "c", *AXES)
#: Bytes of stored bricks that a partition takes, or one larger brick.
PART_BYTES = 32 << 20
# Fixed values of the format: names of elements, attributes and kinds of file.
SIZE = {"z": "depth", "y": "height", "x": "width"}
START = {"z": "st_z", "y": "st_y", "x": "st_x"}
IMAGE = {"z": "imageD", "y": "imageH", "x": "imageW"}
SPACING = {"z": "zspc", "y": "yspc", "x": "xspc"}
PATHS = ("filename", "filepath", "url")
KINDS = {8: "<u1", 16: "<u2", 32: "<f4"}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Brick(InputPartition):
    """Where a brick's samples are stored, and which box of them is its own (from low, to high excluded)."""

    t: int
    c: int
    path: str
    kind: str
    offset: int
    stored: int
    start: tuple[int, int, int]
    size: tuple[int, int, int]
    low: tuple[int, int, int]
    high: tuple[int, int, int]


@dataclass
class Bricks(InputPartition):
    bits: int
    bricks: list[Brick]


def listing(path: str, level: int) -> tuple[int, list[Brick]]:
    """Bits of a sample and the stored bricks of one level; other levels are skipped as they are read.

    Bricks may overlap: a sample belongs to the last brick that starts at or before it on every axis.
    """
    where, name = _opened(path)
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    with where.open_input_stream(name) as f:
        bits, places, files, number = None, {}, [], None
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start":
                number = int(e.get("lv")) if e.tag == "Level" else number
                continue
            if number == level and e.tag == "Brick":
                places[int(e.get("id"))] = (tuple(int(e.get(START[k])) for k in AXES), tuple(int(e.get(SIZE[k])) for k in AXES))
            elif number == level and e.tag == "File":
                files.append(dict(e.attrib))
            elif number == level and e.tag == "Level":
                bits = int(e.get("bitDepth"))
            e.clear()
    if bits not in KINDS:
        raise ValueError(f"{path} has no level {level} of 8, 16 or 32 bits")
    after = []
    for i in range(3):
        starts = sorted({s[i] for s, _ in places.values()})
        after.append(dict(zip(starts, [*starts[1:], None], strict=True)))
    found = []
    for a in files:
        start, size = places[int(a["brickID"])]
        file = next(a[k] for k in PATHS if k in a)
        whole = file if "://" in file or file.startswith("/") else folder + file
        kind = a.get("filetype") or {"zlib": "ZLIB", "jpg": "JPEG", "jpeg": "JPEG"}.get(file.rsplit(".", 1)[-1].lower(), "RAW")
        ends = [s + n if after[i][s] is None else min(s + n, after[i][s]) for i, (s, n) in enumerate(zip(start, size, strict=True))]
        found.append(Brick(int(a["frame"]), int(a["channel"]), whole, kind, int(a.get("offset", 0)), int(a.get("datasize", 0)), start, size, start, tuple(ends)))
    return bits, found


def decoded(brick: Brick, bits: int) -> np.ndarray:
    """The brick's samples (z, y, x), from its range of its file alone."""
    if brick.kind not in ("RAW", "ZLIB"):
        raise ValueError(f"{brick.path}: bricks of kind {brick.kind} cannot be read")
    where, name = _opened(brick.path)
    with where.open_input_file(name) as f:
        data = f.read_at(brick.stored or f.size() - brick.offset, brick.offset)
    data = zlib.decompress(data) if brick.kind == "ZLIB" else data
    kind = np.dtype(KINDS[bits])
    wanted = int(np.prod(brick.size)) * kind.itemsize
    if len(data) < wanted:
        raise ValueError(f"{brick.path}: {len(data)} bytes at {brick.offset} instead of {wanted}")
    return np.frombuffer(data[:wanted], kind).reshape(brick.size)


class BrickReader(DataSourceReader):
    """Reads bricks that meet the limits ``low`` to ``high`` (both included) of t, c, z, y, x, and of them only these samples."""

    def __init__(self, path: str, level: int):
        self.path, self.level = path, level
        self.low, self.high, self.sets = {}, {}, {}

    def _limit(self, name: str, low: int | None = None, high: int | None = None) -> None:
        if low is not None:
            self.low[name] = max(low, self.low.get(name, low))
        if high is not None:
            self.high[name] = min(high, self.high.get(name, high))

    def _wanted(self, b: Brick) -> Brick | None:
        for name, v in (("t", b.t), ("c", b.c)):
            if not self.low.get(name, v) <= v <= self.high.get(name, v) or v not in self.sets.get(name, {v}):
                return None
        low = tuple(max(a, self.low.get(k, a)) for k, a in zip(AXES, b.low, strict=True))
        high = tuple(min(a, self.high.get(k, a - 1) + 1) for k, a in zip(AXES, b.high, strict=True))
        if any(a >= z for a, z in zip(low, high, strict=True)):
            return None
        return Brick(b.t, b.c, b.path, b.kind, b.offset, b.stored, b.start, b.size, low, high)

    def partitions(self) -> list[InputPartition]:
        bits, found = listing(self.path, self.level)
        groups, held = [], 0
        for b in sorted(filter(None, map(self._wanted, found)), key=lambda b: (b.path, b.offset)):
            size = b.stored or int(np.prod(b.size)) * bits // 8
            if not groups or held + size > PART_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(b)
            held += size
        return [Bricks(bits, g) for g in groups] or [Bricks(bits, [])]

    def read(self, partition: Bricks) -> Iterator[pa.RecordBatch]:
        bits = partition.bits
        for b in partition.bricks:
            a = decoded(b, bits)
            lows = [p - s for p, s in zip(b.low, b.start, strict=True)]
            highs = [p - s for p, s in zip(b.high, b.start, strict=True)]
            y, x = (g.ravel() for g in np.meshgrid(np.arange(b.low[1], b.high[1], dtype=np.int32), np.arange(b.low[2], b.high[2], dtype=np.int32), indexing="ij"))
            for z in range(lows[0], highs[0]):
                v = a[z, lows[1] : highs[1], lows[2] : highs[2]].ravel().astype(np.float64 if bits == 32 else np.int32)
                same = lambda q: np.full(len(v), q, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in (same(b.t), same(b.c), same(b.start[0] + z), y, x, v)], names=[*NAMES, "v"])


class PushedBrickReader(BrickReader):
    """Takes its limits from the query's own conditions; Spark still tests them on what comes back."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in NAMES and not (isinstance(getattr(f, "value", None), (str, bool)) or getattr(f, "value", 0) is None):
                match f:
                    case EqualTo(value=v):
                        self._limit(name, v, v)
                    case GreaterThan(value=v):
                        self._limit(name, v + 1)
                    case GreaterThanOrEqual(value=v):
                        self._limit(name, v)
                    case LessThan(value=v):
                        self._limit(name, high=v - 1)
                    case LessThanOrEqual(value=v):
                        self._limit(name, high=v)
                    case In(value=v) if name in ("t", "c"):
                        self.sets[name] = set(v) & self.sets.get(name, set(v))
            yield f


class BrickSource(DataSource):
    """Options: path of the XML, level (0), pushdown (true where the session lets Python sources see conditions)."""

    @classmethod
    def name(cls) -> str:
        return "voxloom_bricks"

    def schema(self) -> str:
        bits, _ = listing(self.options["path"], int(self.options.get("level", 0)))
        return f"t int, c int, z int, y int, x int, v {'double' if bits == 32 else 'int'}"

    def reader(self, schema) -> DataSourceReader:
        kind = PushedBrickReader if self.options.get("pushdown") == "true" else BrickReader
        return kind(self.options["path"], int(self.options.get("level", 0)))


def load(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """t, c, z, y, x, v of one level of a bricked volume, zeros too.

    With spark.sql.python.filterPushdown.enabled, conditions on t, c, z, y, x
    choose the bricks that are read; only their ranges of their files are.
    """
    spark.dataSource.register(BrickSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("voxloom_bricks").option("level", str(level)).option("pushdown", push).load(path)


def _stored(folder: str, level: int, dims: tuple, brick: tuple, bits: int):
    """A function that stores one brick and tells where; done again, it stores the same."""
    where, top = _opened(folder)

    def store(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, c, *at = (int(k) for k in key)
        start = [n * s for n, s in zip(at, brick, strict=True)]
        size = [min(s, d - a) for s, d, a in zip(brick, dims, start, strict=True)]
        a = np.zeros(size, KINDS[bits])
        a[tuple(pdf[k].to_numpy() - s for k, s in zip(AXES, start, strict=True))] = pdf["v"]
        name = f"l{level}_t{t}_c{c}_{at[0]}_{at[1]}_{at[2]}.zlib"
        part = f"{top}/{name}.{uuid.uuid4().hex}"
        data = zlib.compress(a.tobytes())
        with where.open_output_stream(part) as f:
            f.write(data)
        where.move(part, f"{top}/{name}")
        return pd.DataFrame([(t, c, *at, name, len(data))], columns=["t", "c", "bz", "by", "bx", "name", "stored"])

    return store


def save(vox: DataFrame, folder: str, dims: tuple[int, int, int], brick: tuple[int, int, int], levels: int = 1, bits: int = 8, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> str:
    """Writes ``vox`` (one row a place) into a folder as zlib bricks of ``levels`` levels and returns the path of their XML.

    A brick is one group and one file; only the list of files passes through
    the driver, row by row.  Bricks without samples have no file and are read as absent.
    """
    where, top = _opened(folder)
    where.create_dir(top, recursive=True)
    frames, channels = (int(n or 0) + 1 for n in vox.agg(F.max("t"), F.max("c")).first())
    path = f"{folder}/volume.vvd"
    with where.open_output_stream(f"{top}/volume.vvd") as out:
        put = lambda text: out.write((text + "\n").encode())
        put(f'<BRK nChannel="{channels}" nFrame="{frames}" nLevel="{levels}">')
        for k in range(levels):
            size = tuple((d + (1 << k) - 1) >> k for d in dims)
            rows = (vox if k == 0 else volumes.level(vox, k)).select(*NAMES, "v")
            at = [F.floor(F.col(q) / s).cast("int").alias(f"b{q}") for q, s in zip(AXES, brick, strict=True)]
            done = rows.select("*", *at).groupBy("t", "c", "bz", "by", "bx").applyInPandas(_stored(folder, k, size, brick, bits), "t int, c int, bz int, by int, bx int, name string, stored long")
            counts = [-(-d // s) for d, s in zip(size, brick, strict=True)]
            image = " ".join(f'{IMAGE[q]}="{d}" {SPACING[q]}="{w * 2**k}"' for q, d, w in zip(AXES, size, spacing, strict=True))
            put(f'<Level lv="{k}" {image} bitDepth="{bits}">\n<Bricks brick_baseW="{brick[2]}" brick_baseH="{brick[1]}" brick_baseD="{brick[0]}">')
            for n, place in enumerate(np.ndindex(*counts)):
                start = [p * s for p, s in zip(place, brick, strict=True)]
                box = " ".join(f'{START[q]}="{a}" {SIZE[q]}="{min(s, d - a)}"' for q, a, s, d in zip(AXES, start, brick, size, strict=True))
                put(f'<Brick id="{n}" {box} offset="0" size="0"/>')
            put("</Bricks>\n<Files>")
            for r in done.toLocalIterator():
                n = (r["bz"] * counts[1] + r["by"]) * counts[2] + r["bx"]
                put(f'<File frame="{r["t"]}" channel="{r["c"]}" brickID="{n}" filepath={quoteattr(r["name"])} offset="0" datasize="{r["stored"]}" filetype="ZLIB"/>')
            put("</Files>\n</Level>")
        put("</BRK>")
    return path
