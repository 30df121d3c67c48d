"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own.  The reader's tasks take byte ranges of the
archives.  A task searches its range for the gzip magic, takes a hit for a
record only if the member decodes to a WARC header, and owns the records that start inside
the range, reading past its end to finish the last.  Damaged members are passed over by
searching on.  A compressed payload that holds a whole raw archive again could be taken for
records where a range begins inside it; within a range, members are walked end to end.

Files lie in a folder that all tasks share and that an Arrow file system can open.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import raw, stored

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
RANGE_BYTES = 32 << 20
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
_HEAD_END = b"\r\n\r\n"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or local path."""
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def _urn(number: int | None) -> str:
    return f"<urn:page:{'' if number is None else number}>"


def _number(urn: str | None) -> int | None:
    digits = urn[len("<urn:page:") : -1] if urn else ""
    return int(digits) if digits else None


def encode_record(number: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One gzip member.  A revisit keeps the payload's digest and length, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(number)}", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + _HEAD_END + block + _HEAD_END) + packer.flush()


def write(df: DataFrame, number: str, url: str, text: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row; returns the files (path, bytes, records) as a stored table.

    Of rows with equal payloads (UTF-8 of ``text``; null: empty) of at least ``min_bytes``
    bytes the one with the smallest number is a response and the others are revisits that
    refer to it; null numbers come last, and of rows with that same number the first
    by url, then the first met.  Payloads are equal if their SHA-1 and length are.
    The list names the files of tasks that ended well, so that retries leave no
    doubles; its rows follow the number of files.
    """
    folder = shared_dir(df.sparkSession, "warc")
    rows = df.select(
        F.col(number).cast("long").alias("number"), F.col(url).alias("url"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    rank = F.struct(F.col("number").isNull().alias("no"), F.col("number").alias("n"), F.col("url").alias("u"), F.col("at").alias("at"))
    groups = rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size")
    groups = groups.agg(F.count(F.lit(1)).alias("copies"), F.min(rank).alias("first")).filter("copies > 1")
    groups = stored(groups.select(F.col("digest").alias("d"), F.col("size").alias("s"), "first"), "warc-copies")
    same = (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))
    rows = rows.join(groups, same, "left").select(
        "number", "url", "payload", F.coalesce(F.col("at") != F.col("first.at"), F.lit(False)).alias("revisit"), F.col("first.n").alias("refers")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, records = None, "", 0, 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for num, address, payload, revisit, refers in zip(*cols):
                if out is None:
                    name, size, records = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                data = encode_record(num, address, payload, refers, revisit)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    out.close()
                    done.append((name, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, records))
        yield pa.RecordBatch.from_pylist(
            [{"path": f"{folder}/{n}", "bytes": s, "records": r} for n, s, r in done],
            pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]),
        )

    return stored(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


def fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and named fields (lower-case) of a header."""
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


class _Window:
    """Bytes of a file from a moving position, read in blocks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(min(max(n, BLOCK), max(0, self.size - at)))
        return self.data[at - self.at : at - self.at + n]


def _next_magic(window: _Window, at: int, end: int) -> int | None:
    """The first gzip magic that starts in [at, end)."""
    while at < end:
        data = window.get(at, BLOCK)
        found = data.find(MAGIC)
        if found >= 0:
            return at + found if at + found < end else None
        if len(data) < BLOCK:
            return None
        at += len(data) - len(MAGIC) + 1
    return None


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The whole member at ``at`` and where it ends; None unless it decodes to a WARC record.

    A member that begins as a record is decoded to its end, however long its header is.
    """
    packer, out, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not packer.eof:
            data = window.get(pos, BLOCK // 4)
            if not data:
                return None
            out += packer.decompress(data)
            pos += len(data)
            if not b"WARC/".startswith(out[:5]):
                return None
    except zlib.error:
        return None
    return (bytes(out), pos - len(packer.unused_data)) if _HEAD_END in out else None


def records(path: str, start: int, end: int, size: int) -> Iterator[dict]:
    """Records whose member starts in [start, end) of a file of ``size`` bytes."""
    system, name = file_system(path)
    with system.open_input_file(name) as file:
        window, at = _Window(file, size), start
        while at < end:
            found = _next_magic(window, at, end)
            if found is None:
                return
            member = _member(window, found)
            if member is None:
                at = found + 1
                continue
            data, after = member
            head, _, body = data.partition(_HEAD_END)
            version, named = fields(head)
            length = int(named.get("content-length", "-1")) if named.get("content-length", "").isdigit() else -1
            if length < 0 or body[length:] != _HEAD_END:
                at = found + 1
                continue
            yield {"offset": found, "version": version, "fields": named, "block": body[:length]}
            at = after


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, end, bytes), dealt over tasks."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)).cast("long"), F.lit(range_bytes).cast("long"))
    out = files.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    out = out.withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))
    # one range is minutes of work at the default size: a task takes one where there are enough
    return out.repartition("path", "start")


SCHEMA = (
    "path string, offset long, record_type string, record_id string, uri string, refers_to string, date string, payload_digest string, "
    "declared_digest string, payload_bytes long"
)


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """One row per record of the files (path, bytes).

    payload_digest and payload_bytes are those of the payload as read; for revisits, which hold
    none, the declared digest and the Content-Length of the kept HTTP header.  With
    ``payload`` the bytes are returned as well (null for revisits).
    """
    schema = SCHEMA + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("offset", "payload_bytes") else pa.string()) for n in names])
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                for x in records(r["path"], r["start"], r["end"], r["bytes"]):
                    f = x["fields"]
                    http, _, body = x["block"].partition(_HEAD_END)
                    revisit = f.get("warc-type") == "revisit"
                    declared = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if revisit:
                        length = fields(http)[1].get("content-length", "")
                        digest, n = declared, int(length) if length.isdigit() else None
                    else:
                        body = body if f.get("content-type", "").startswith("application/http") else x["block"]
                        digest, n = base32(hashlib.sha1(body).digest()), len(body)
                    rows.append({
                        "path": r["path"], "offset": x["offset"], "record_type": f.get("warc-type"), "record_id": f.get("warc-record-id"),
                        "uri": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to"), "date": f.get("warc-date"),
                        "payload_digest": digest, "declared_digest": declared, "payload_bytes": n, "payload": None if revisit else body,
                    })
                    held += len(body) if payload else 200
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return ranges(files, range_bytes).mapInArrow(run, schema)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the .warc.gz files of a folder, listed by Spark without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def round_trip(pages: DataFrame, number: str = "page_id", url: str = "url", text: str = "html", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes a record per page and reads the archives back.

    Returns the number, payload_bytes, payload_digest, record_type, refers_to and uri of
    every record, and whether the digest read is the one declared.  Null numbers stay null.
    """
    got = read(write(pages, number, url, text), range_bytes)

    def num(c: str):
        return F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)

    def as_number(c: str):
        return F.when(num(c) != "", num(c).cast("long"))

    return got.select(
        as_number("record_id").alias(number), "payload_bytes", "payload_digest", "record_type", as_number("refers_to").alias("refers_to"),
        "uri", (F.col("payload_digest") == F.col("declared_digest")).alias("intact"),
    )
