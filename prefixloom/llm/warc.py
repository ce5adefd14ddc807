"""Operator 6: a splittable reader of gzipped WARC files, and the writer that goes with it.

A file is cut into byte ranges of `split` bytes, one task each at most. A task scans its range for the gzip magic, takes every hit for a candidate
and validates it by decoding: the member's header and the start of its content must inflate to a WARC version line. A member
belongs to the task in whose range its first byte lies, and is read to its end beyond the range. A validated member's end tells where
the next one starts; only where no member follows is the scan for the magic resumed. No index and no reading from the file's start.

A false candidate inside compressed data must survive both the gzip header's check and inflating to the version line, and bytes inside
a validated member are never scanned, save by the first search of a range that begins inside one.

Defined cases: an empty file gives no records. A truncated or corrupt member is skipped and the scan resumes after its magic; with
`errors` it is counted in a row of type `corrupt`. A member may hold several records. Members of any length are read whole. The writer
keeps nulls apart from empty strings by header fields, so pages round-trip exactly; rows that repeat are records of their own.
Paths go through pyarrow's file systems, so ranges are read from local, HDFS or object storage alike.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.shared import materialise, shared_folder

SPLIT = 16 << 20
CHUNK = 1 << 20
_MAGIC = re.compile(rb"\x1f\x8b\x08")
_VERSION = b"WARC/"
_BATCH = 512
SCHEMA = "path string, start long, length long, type string, record_id string, target_uri string, date string, headers map<string,string>, content binary"
_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("content", pa.binary())])


def _open(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class _Source:
    """A file read in chunks from wherever it is asked; keeps a window of bytes."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.data = f, size, 0, b""

    def get(self, start: int, length: int) -> bytes:
        """Bytes from start, `length` of them unless the file ends."""
        length = min(length, self.size - start)
        if length <= 0:
            return b""
        if start < self.at or start + length > self.at + len(self.data):
            self.f.seek(start)
            self.at, self.data = start, self.f.read(max(length, CHUNK))
        return self.data[start - self.at : start - self.at + length]


def header_length(b: bytes) -> int | None:
    """Length of a gzip header that b starts with, None if it isn't one; 0 if b is too short to tell."""
    if len(b) < 10:
        return 0
    if b[:3] != b"\x1f\x8b\x08" or b[3] & 0xE0:
        return None
    flags, n = b[3], 10
    if flags & 4:
        if len(b) < n + 2:
            return 0
        n += 2 + struct.unpack_from("<H", b, n)[0]
    for bit in (8, 16):
        if flags & bit:
            end = b.find(b"\0", n)
            if end < 0:
                return 0
            n = end + 1
    if flags & 2:
        n += 2
    return n if len(b) >= n else 0


def is_member(b: bytes) -> bool:
    """Whether b begins with a gzip member whose content begins with a WARC version line."""
    n = header_length(b)
    if not n:
        return False
    try:
        return zlib.decompressobj(-15).decompress(b[n:], len(_VERSION)) == _VERSION
    except zlib.error:
        return False


def inflate(source: _Source, start: int) -> tuple[bytes | None, int]:
    """(content, end) of the member at start; content is None if it is truncated or fails its checks."""
    d, at, out = zlib.decompressobj(31), start, []
    try:
        while not d.eof:
            b = source.get(at, CHUNK)
            if not b:
                return None, start
            out.append(d.decompress(b))
            at += len(b)
    except zlib.error:
        return None, start
    return b"".join(out), at - len(d.unused_data)


def records(content: bytes):
    """(headers, payload) of every record in a member's content; None for what can't be parsed."""
    at = 0
    while at < len(content):
        if content[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or content[at : at + 5] != _VERSION:
            yield None
            return
        headers: dict[str, str] = {}
        for line in content[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        try:
            n = int(headers.get("content-length", ""))
        except ValueError:
            n = -1
        start = end + 4
        if n < 0 or start + n > len(content):
            yield None
            return
        yield headers, content[start : start + n]
        at = start + n


def scan(f, size: int, lo: int, hi: int):
    """(start, length, content) of the members that start in [lo, hi)."""
    source, at, known = _Source(f, size), lo, False
    while at < hi:
        if known or is_member(source.get(at, 512)) or is_member(source.get(at, 1 << 17)):
            content, end = inflate(source, at)
            if content is not None and content[:5] == _VERSION:
                yield at, end - at, content
                at = end
                known = source.get(at, 3) == b"\x1f\x8b\x08" and is_member(source.get(at, 1 << 17))
                if known or at >= hi:
                    continue
            else:
                yield at, 0, None
                known, at = False, at + 1
        # the next magic in the range; two bytes more, as it may straddle the end of what is read
        known = False
        while at < hi:
            b = source.get(at, min(CHUNK, hi + 2 - at))
            m = _MAGIC.search(b)
            if m:
                at += m.start()
                if at < hi and (is_member(source.get(at, 512)) or is_member(source.get(at, 1 << 17))):
                    known = True
                    break
                at += 1
            else:
                at += max(1, len(b) - 2) if len(b) == min(CHUNK, hi + 2 - at) and at + len(b) < hi + 2 else max(1, hi - at)


def splits(spark: SparkSession, files: list[tuple[str, int]] | DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, size, lo, hi): the byte ranges of files, given as (path, size)."""
    files = files if isinstance(files, DataFrame) else spark.createDataFrame(files, "path string, size long")
    x = files.where("path is not null and size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {split}L"))).alias("k"))
    return x.select("path", "size", (F.col("k") * split).alias("lo"), F.least((F.col("k") + 1) * split, F.col("size")).alias("hi"))


def read(spark: SparkSession, files: list[tuple[str, int]] | DataFrame, split: int = SPLIT, errors: bool = False) -> DataFrame:
    """One row a record, columns as in SCHEMA; start and length are the member's bytes. Ranges are dealt out evenly to tasks."""
    ranges = splits(spark, files, split)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                fs, path = _open(r["path"])
                with fs.open_input_file(path) as f:
                    for start, length, content in scan(f, r["size"], r["lo"], r["hi"]):
                        for one in records(content) if content is not None else [None]:
                            if one is None:
                                if errors:
                                    rows.append((r["path"], start, length, "corrupt", None, None, None, None, None))
                                continue
                            h, payload = one
                            rows.append((r["path"], start, length, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), list(h.items()), payload))
                            held += len(payload)
                            if len(rows) >= _BATCH or held > 16 << 20:
                                yield _batch(rows)
                                rows, held = [], 0
        if rows:
            yield _batch(rows)

    n = max(1, ranges.count())
    return ranges.repartitionByRange(min(n, 100_000), "path", "lo").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _member(kind: str, fields: list[tuple[str, str]], payload: bytes) -> bytes:
    head = b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(payload)))])
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(head + b"\r\n" + payload + b"\r\n\r\n") + c.flush()


_ESCAPED = re.compile(r"[\x00-\x20%\x7f-\U0010ffff]")


def _quote(s: str) -> str:
    """A header value without spaces, controls or non-ASCII characters."""
    return _ESCAPED.sub(lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), s)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as one gzipped WARC a task; (path, size) of the files.

    A file's name holds the attempt, and only files named in the result count, so attempts that are lost or repeated do no harm.
    """
    x = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches):
        task = TaskContext.get()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        size = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            for b in batches:
                for page_id, url, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                    fields = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
                    fields += [("WARC-Target-URI", _quote(url))] if url is not None else []
                    fields += [("X-Page-ID", page_id)] if page_id is not None else []
                    fields += [("X-Null-Payload", "1")] if source is None else []
                    data = _member("resource", fields, (source or "").encode())
                    f.write(data)
                    size += len(data)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([size], pa.int64())], ["path", "size"])

    return materialise(x.mapInArrow(run, "path string, size long"), "files")


def pages(spark: SparkSession, files, split: int = SPLIT) -> DataFrame:
    """(page_id, url, html) of records that write() made, nulls and all."""
    raw = read(spark, files, split).select("target_uri", F.col("headers")["x-page-id"].cast("long").alias("page_id"), F.col("headers")["x-null-payload"].alias("none"), "content")
    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(unquote, na_action="ignore")

    url = F.when(F.col("target_uri").contains("%"), plain("target_uri")).otherwise(F.col("target_uri"))
    return raw.select("page_id", url.alias("url"), F.when(F.col("none").isNull(), F.decode("content", "UTF-8")).alias("html"))


def round_trip(table: DataFrame, split: int = SPLIT) -> DataFrame:
    """The whole table written as WARC files in the shared folder and read back by byte ranges."""
    spark = table.sparkSession
    folder = f"{shared_folder(spark)}/prefixloom/warc-{uuid.uuid4().hex}"
    return pages(spark, write(table, folder), split)


SQL = "SELECT page_id, url, html FROM {pages}"
