"""WARC archives: written as record-wise gzip by Spark's text writer, streamed back, assembled by concurrent-to.

Each page becomes three records: a request, a response (or a revisit of the
capture with the same payload) and metadata.  Every record is a gzip member of
its own.  A member ends with its length as four bytes, the last of them 0 for
less than 16 MB, and that byte is the text writer's line separator; a longer
record goes on in further members.  Files are bounded in bytes, and reading
inflates one member at a time, so neither needs a file's contents at once.
"""

from __future__ import annotations

import base64
import gzip
import zlib
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .storage import shared_path, stored, tidy

#: Bytes of pages that an archive holds on average; a larger page has an archive of its own.
FILE_BYTES = 1 << 25
#: Bytes of a record in one gzip member.
MEMBER = (1 << 24) - 1
_END = "\r\n\r\n"
_NAMES = ["request", "response", "metadata"]
# Digits of base 32 as Java writes them, and as RFC 4648 does.
_FROM, _TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(column: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column."""
    digest = F.upper(F.sha1(column))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _FROM, _TO)


def _payload_groups(rows: DataFrame, least_bytes: int) -> DataFrame:
    """row, response_id, response_row of rows whose payload others have too; only digests are grouped, not payloads."""
    narrow = rows.where(F.col("size") >= least_bytes).select("row", "page_id", "digest", "size")
    largest = F.max(F.struct("page_id", "row")).alias("largest")
    groups = stored(narrow.groupBy("digest", "size").agg(largest, F.count("*").alias("n")).where("n > 1"), "payloads")
    found = narrow.join(groups, ["digest", "size"])
    return stored(found.select("row", F.col("largest.page_id").alias("response_id"), F.col("largest.row").alias("response_row")), "repeats")


def numbered_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size and row of ``pages``, stored: identifiers differ where page_ids do not."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "pages")


def records(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """request, response, metadata: the three WARC records of a page, as strings.

    Pages are shuffled only where the repeated ones are too many to be broadcast.
    """
    rows = rows.join(repeats, "row", "left")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    uri = F.when(F.regexp_replace("url", r"[\x00-\x20\x7F]", "") == "", F.concat(F.lit("urn:page:"), name)).otherwise(F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20"))
    revisit = F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id"))
    numbered = F.concat(name, F.lit(":"), F.col("row").cast("string"), F.lit(">"))
    capture = F.concat(F.lit("<urn:capture:"), numbered)

    def record(kind: Column, ident: Column, extra: Column, block: Column) -> Column:
        head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), ident, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri, extra)
        return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block, F.lit(_END))

    other = lambda kind: F.concat(F.lit(f"<urn:{kind}:"), numbered)
    beside = F.concat(F.lit("\r\nWARC-Concurrent-To: "), capture)
    payload = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"))
    refers = F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:capture:"), F.col("response_id").cast("string"), F.lit(":"), F.col("response_row").cast("string"), F.lit(">"))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    http = F.lit("\r\nContent-Type: application/http; msgtype=")
    made = (
        record(F.lit("request"), other("request"), F.concat(beside, http, F.lit("request")), F.lit(f"GET / HTTP/1.1{_END}")),
        F.when(revisit, record(F.lit("revisit"), capture, F.concat(payload, refers, http, F.lit("response")), answer)).otherwise(
            record(F.lit("response"), capture, F.concat(payload, http, F.lit("response")), F.concat(answer, F.col("html")))
        ),
        record(F.lit("metadata"), other("metadata"), F.concat(beside, F.lit("\r\nContent-Type: application/warc-fields")), F.concat(F.lit("pageId: "), name, F.lit("\r\npayloadBytes: "), F.col("size").cast("string"), F.lit("\r\n"))),
    )
    return rows.select(*[r.alias(n) for r, n in zip(made, _NAMES, strict=True)])


def zipped(record: bytes) -> bytes:
    """The record's gzip members, one after the other; each ends with a byte 0."""
    return b"".join(gzip.compress(record[i : i + MEMBER], 6, mtime=0) for i in range(0, len(record), MEMBER))


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's members, without the last byte of all."""
    for batch in batches:
        out, held = [], 0
        for page in zip(*[kernels.raw_texts(batch.column(k)) for k in _NAMES], strict=True):
            out.append((b"".join(map(zipped, page))[:-1],))
            held += len(out[-1][0])
            if held > kernels.SLICE_BYTES:
                yield kernels.batch_of(out, {"page": pa.binary()})
                out, held = [], 0
        yield kernels.batch_of(out, {"page": pa.binary()})


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """WARC files below ``path``.

    Of pages whose payloads (of ``least_bytes`` or more) are equal, the one
    with the largest page_id is the response (all rows with that page_id are),
    the others revisit it; pages without any page_id are all responses.  A null
    html is an empty payload, a null url a urn of the page.  An archive holds
    about ``FILE_BYTES`` of pages, or one page that is larger.
    """
    rows = numbered_pages(pages)
    repeats = _payload_groups(rows, least_bytes)
    small, large = rows.where(F.col("size") <= FILE_BYTES), rows.where(F.col("size") > FILE_BYTES)
    total = small.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # A page adds about 1 kB of headers.  One row is one page, so a file ends with a whole page.
    mean = 1024 + total[0] / max(1, total[1])
    for part, most, name in ((small, max(1, int(FILE_BYTES / mean)), "archives"), (large, 1, "large")):
        lines = records(part, repeats).mapInArrow(_zipped, "page binary").select(F.col("page").cast("string").alias("value"))
        lines.write.option("lineSep", "\0").option("maxRecordsPerFile", most).text(f"{path}/{name}")


def headers(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def inflated(raw: memoryview) -> Iterator[bytes]:
    """The contents of a file, piece by piece: of its gzip members, or as it is."""
    feed, at, zipped = 1 << 14, 0, raw[:2] == b"\x1f\x8b"
    while at < len(raw):
        tool = zlib.decompressobj(31)
        while zipped and not tool.eof:
            part = raw[at : at + feed]
            if not part:
                raise ValueError("a gzip member is cut short")
            yield tool.decompress(part)
            at += len(part) - len(tool.unused_data)
        if not zipped:
            yield bytes(raw[at : at + feed])
            at += feed


def parse(raw: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file, found by its length; one record is held at a time."""
    pieces, held = inflated(memoryview(raw).cast("B")), bytearray()

    def fill(enough) -> bool:
        while not enough():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while fill(lambda: len(held) > 0) and held[:1] in (b"\r", b"\n"):
            del held[:1]
        if not held:
            return
        if not fill(lambda: b"\r\n\r\n" in held):
            raise ValueError("a record's header has no end")
        end = held.index(b"\r\n\r\n")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = headers(lines[1:])
        size = int(head["content-length"])
        if not fill(lambda: len(held) >= end + 4 + size):
            raise ValueError("a record is cut short")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


_RECORD = {"record_id": pa.string(), "capture_id": pa.string(), "type": pa.string(), "uri": pa.string(), "refers_to": pa.string(), "digest": pa.string(), "fields": pa.string(), "bytes": pa.int64(), "payload": pa.binary()}


def _row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A record's columns; a response's payload is what follows its HTTP header, or the block where there is none."""
    kind, ident = head.get("warc-type", "").lower(), head.get("warc-record-id")
    digest = size = fields = payload = None
    if kind == "response":
        at = block.find(b"\r\n\r\n") if block[:5] == b"HTTP/" else -4
        body = block[at + 4 :] if at != -1 else b""
        digest, size = base64.b32encode(sha1(body).digest()).decode(), len(body)
        payload = body if with_payload else None
    elif kind == "revisit":
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    return ident, head.get("warc-concurrent-to", ident), kind, head.get("warc-target-uri"), head.get("warc-refers-to"), digest, fields, size, payload


def _parsed(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("content"):
                rows, held = [], 0
                for head, block in parse(memoryview(cell.as_buffer())):
                    rows.append(_row(head, block, with_payload))
                    held += len(block)
                    if held > kernels.SLICE_BYTES:
                        yield kernels.batch_of(rows, _RECORD)
                        rows, held = [], 0
                yield kernels.batch_of(rows, _RECORD)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``, of whatever type."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(_parsed(with_payload), "record_id string, capture_id string, type string, uri string, refers_to string, digest string, fields string, bytes long, payload binary")


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata (structs; null where a record is missing).

    Records meet in their capture's identifier: a response's or revisit's own,
    the others' concurrent-to.  Of equal identifiers each kind keeps its
    largest record; other kinds of record make no capture.
    """
    kinds = {"request": ["request"], "response": ["response", "revisit"], "metadata": ["metadata"]}
    whole = F.struct("record_id", "type", "uri", "refers_to", "digest", "fields", "bytes", "payload")
    parts = [F.max(F.when(F.col("type").isin(found), whole)).alias(name) for name, found in kinds.items()]
    return records.where(F.col("type").isin(sum(kinds.values(), []))).groupBy("capture_id").agg(*parts)


@tidy
def page_captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of ``pages`` written and read back: one row per row.

    The archives go at the end; ``write`` keeps them.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, least_bytes)
    found = captures(read_records(spark, path))
    number = lambda column, pattern: F.regexp_extract(column, pattern, 1)
    ident = number("metadata.fields", r"(?m)^pageId: (-?\d+)\r?$")
    found = found.select(
        F.when(ident != "", ident.cast("long")).alias("page_id"),
        F.coalesce("response.bytes", number("metadata.fields", r"(?m)^payloadBytes: (\d+)\r?$").cast("long")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), number("response.refers_to", r"<urn:capture:(-?\d+):\d+>").cast("long")).alias("refers_to"),
    )
    return stored(found, "captures")
