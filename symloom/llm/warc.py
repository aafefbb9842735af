"""WARC archives: writing with revisit records, and a salvage reader.

An archive is a run of gzip members, one record each. The reader checks every member (its
checksum, the record's version line, its Content-Length, its payload digest). Where a check
fails it searches for the next place at which a valid member, or a version line outside
compression, starts, goes on from there and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_at, saved, shared_dir

VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that the reader asks the file system for at a time.
READ_BYTES = 1 << 20
#: Bytes that are inflated at a time.
FEED_BYTES = 1 << 14
#: Rows of a batch that the reader hands on, at most, and their payload bytes, about.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: For record identifiers: the same page gives the same one whenever its task runs again.
NAMESPACE = uuid.UUID("00000000-0000-0000-0000-000000000000")
WROTE = "file string, n_records long"
READ = "file string, offset long, kind string, gap_bytes long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, block binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str | None = None) -> bytes:
    """One record, not compressed. A revisit has no block; both tell the full payload's size."""
    clean = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    block = b"" if revisit else payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": clean,
        "WARC-Payload-Digest": "sha1:" + (digest or base32_sha1(payload)),
        "Content-Type": "text/html; charset=utf-8",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()) + f"Content-Length: {len(block)}\r\n"
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """raw as a gzip member."""
    c = zlib.compressobj(level, wbits=31)
    return c.compress(raw) + c.flush()


@dataclass
class Record:
    offset: int
    head: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    n_bytes: int


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """(head, block, length) of the record at the start of raw, if all its checks hold."""
    if not raw.startswith(VERSION):
        return None
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    try:
        lines = raw[len(VERSION) : end].decode().split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(head["content-length"])
    except (UnicodeDecodeError, KeyError, ValueError):
        return None
    start = end + 4
    if n < 0 or raw[start + n : start + n + 4] != b"\r\n\r\n":
        return None
    block = raw[start : start + n]
    want = head.get("warc-payload-digest", "")
    if head.get("warc-type") != "revisit" and want.startswith("sha1:") and base32_sha1(block) != want[5:]:
        return None
    return head, block, start + n + 4


class Bytes:
    """A file's bytes by place. One piece is held, that which was read last."""

    def __init__(self, file):
        self._file, self._held, self._from = file, b"", 0
        self.size = file.seek(0, 2)

    def _read(self, start: int, n: int) -> bytes:
        self._file.seek(start)
        return self._file.read(n)

    def ahead(self, at: int) -> bytes:
        """Some bytes from a place on; none at the end."""
        if not self._from <= at < self._from + len(self._held):
            self._held, self._from = self._read(at, READ_BYTES), at
        return self._held[at - self._from :] if at > self._from else self._held

    def part(self, start: int, end: int) -> bytes:
        end = min(end, self.size)
        if start >= end:
            return b""
        if start < self._from or end > self._from + len(self._held):
            if end - start > READ_BYTES:
                return self._read(start, end - start)
            self._held, self._from = self._read(start, READ_BYTES), start
        return self._held[start - self._from : end - self._from]

    def peek(self, start: int, n: int) -> bytes:
        """A few bytes from anywhere; what is held stays."""
        held = self._from <= start and start + n <= self._from + len(self._held)
        return self.part(start, start + n) if held else self._read(start, n) if start < self.size else b""

    def find(self, marks: tuple[bytes, ...], at: int) -> int:
        """Where the first of marks begins from a place on; -1 for nowhere."""
        most = max(map(len, marks)) - 1
        while at < self.size:
            piece = self.ahead(at)
            if len(piece) <= most and at + len(piece) < self.size:
                self._held = b""  # the end of what is held, and too short: read from here
                piece = self.ahead(at)
            found = [i for m in marks if (i := piece.find(m)) >= 0]
            if found:
                return at + min(found)
            if at + len(piece) >= self.size:
                break
            at += len(piece) - most
        return -1


def inflated(source: Bytes, at: int) -> tuple[bytes, int] | None:
    """(content, length) of the gzip member at a place, if its checksum holds."""
    d = zlib.decompressobj(wbits=31)
    out, fed = [], 0
    while not d.eof:
        piece = source.part(at + fed, at + fed + FEED_BYTES)
        if not piece:
            return None
        try:
            out.append(d.decompress(piece))
        except zlib.error:
            return None
        fed += len(piece)
    return b"".join(out), fed - len(d.unused_data)


def plain(source: Bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The uncompressed record at a place. Its head can't go on beyond the next version line,
    and its block is read only if it ends where its length says, so that a wrong length costs a
    look at that place and not the rest of the file."""
    end = source.find((b"\r\n\r\n", b"\r\n" + VERSION), at)
    if end < 0 or source.part(end, end + 4) != b"\r\n\r\n":
        return None
    m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", source.part(at, end + 2))
    if not m:
        return None
    after = end + 4 + int(m[1])
    return parsed(source.part(at, after + 4)) if source.peek(after, 4) == b"\r\n\r\n" else None


def salvage(file) -> Iterator[Record | Gap]:
    """Every valid record of an archive (a file that can be read from any place), and a gap for
    each run of bytes that belongs to none.

    After a failed check, every later member start or version line is tried in turn."""
    source, at, gap_at = Bytes(file), 0, -1
    while 0 <= at < source.size:
        head, got = source.part(at, at + len(VERSION)), None
        if head.startswith(MEMBER):
            if (m := inflated(source, at)) and (p := parsed(m[0])) and p[2] == len(m[0]):
                got = (p[0], p[1], m[1])
        elif head == VERSION:
            got = plain(source, at)
        if got:
            if gap_at >= 0:
                yield Gap(gap_at, at - gap_at)
                gap_at = -1
            yield Record(at, got[0], got[1])
            at += got[2]
        else:
            gap_at = at if gap_at < 0 else gap_at
            at = source.find((MEMBER, VERSION), at + 1)
    if gap_at >= 0:
        yield Gap(gap_at, source.size - gap_at)


def deduplicated(pages: DataFrame, page_id: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload (string, not null), digest (hex SHA-1) and response (the page_id
    that the record with this payload has as response, null if none is looked for)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    keep = F.octet_length("payload") >= least_bytes
    firsts = rows.filter(keep).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Only payloads that repeat are joined; of rows with one, Spark can split a hot group.
    return rows.join(firsts, "digest", "left")


@dataclass(frozen=True)
class Archives:
    """Written archives: their folder and a table (file, n_records)."""

    folder: str
    files: DataFrame

    def read(self, files: DataFrame | None = None) -> DataFrame:
        """Every record and gap of the archives (or of other `files`), read by salvage():
        kind 'record' or 'gap', file, offset, gap_bytes, page_id, url, record_type, refers_to,
        payload_bytes, payload_digest, block. A folder without archives gives no rows."""

        def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for file in part.column("file").to_pylist():
                    yield from batches(file)

        return (files or self.files).select("file").mapInArrow(read, READ)


def batches(file: str) -> Iterator[pa.RecordBatch]:
    """The rows of Archives.read() of one file."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("kind", pa.string()), ("gap_bytes", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])
    number = lambda x: int(x) if x else None
    fs, path = file_at(file)
    rows, size = [], 0
    with fs.open_input_file(path) as file_:
        for x in salvage(file_):
            if isinstance(x, Gap):
                rows.append((file, x.offset, "gap", x.n_bytes, *[None] * 7))
            else:
                h = x.head
                length = number(h.get("x-payload-length"))
                rows.append((file, x.offset, "record", None, number(h.get("x-page-id")), h.get("warc-target-uri"), h.get("warc-type"), number(h.get("x-refers-to-page")), len(x.block) if length is None else length, h.get("warc-payload-digest", "").removeprefix("sha1:"), x.block))
                size += len(x.block)
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, level: int = 6) -> Archives:
    """Writes a record for each row, its payload in UTF-8 (null: empty), one archive a task.

    Of the records whose payloads are equal (same SHA-1, at least least_bytes long) that with
    the largest page_id is a response and the others are revisits of it; shorter payloads are
    all responses. Of rows that share payload and page_id each is a response: none is dropped.
    Null page_ids sort below all others; a null url is empty; control characters in a url are
    percent-encoded; other columns are ignored. An empty table gives no archives. A task that
    runs again writes a file of a new name; only the attempt that counted is in `files`."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    rows = deduplicated(pages, page_id, url, payload, least_bytes).select("page_id", "url", "payload", "response")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        file = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        fs, path = file_at(file)
        out, n = None, 0
        for part in parts:
            for page, link, text, response in zip(*(part.column(c) for c in ("page_id", "url", "payload", "response")), strict=True):
                if out is None:
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                page, response = page.as_py(), response.as_py()
                out.write(member(record(page, link.as_py(), text.as_py().encode(), response, response is not None and page != response), level))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64())], names=["file", "n_records"])

    return Archives(folder, saved(rows.mapInArrow(write, WROTE), "warc-files"))
