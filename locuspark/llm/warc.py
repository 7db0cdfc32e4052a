"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writer. Each row becomes a WARC/1.1 record in a gzip member of its own. Payloads are known
by SHA-256; of equal payloads of at least ``MIN_SHARED`` bytes the row with the smallest id
is a response and the others are revisit records that refer to it and carry no payload.
Tasks write files of about ``FILE_BYTES`` under a temporary name and rename them. The rows of
a task are sorted, so a task that runs twice cuts and names the same files with the same bytes.

Reader. Archives may hold gzip members, of one or more records, or plain records. They are
read in blocks, and one record is held at a time. Each member's checksum, the
version line, the headers, the length and the block digest are checked. After a failure the
reader goes to the next byte that starts a valid member or version line, goes on from there
and logs the gap (file, offset, bytes, reason) instead of a record. Inside a member of several
records it goes on at the next version line of the unpacked bytes; such gaps count those and
have their place in ``inner``. The last record before a member's failure is not trusted.
Records of over ``RECORD_BYTES`` become gaps.

Defined results: a null payload is empty; equal rows that share the smallest id are all
responses; a null id is written without one and read as null, and never referred to; a null
url is left out; control characters in a url are percent-encoded; an empty table writes no
file and reads back as no record.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, shared_path, slices

MIN_SHARED = 100
FILE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
START = b"WARC/1."
#: Bytes read or unpacked at a time; bytes that headers or one record may have.
BLOCK = 1 << 20
HEADER_BYTES = 1 << 20
RECORD_BYTES = 1 << 30

RECORD = "file string, offset long, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap_bytes long, gap_reason string, inner long"
_FIELDS = ["file", "offset", "record_type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest", "payload", "gap_bytes", "gap_reason", "inner"]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

Batches = Iterator[pa.RecordBatch]


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), value)


def record(record_type: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record; ``size`` and ``digest`` are those of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload
    lines = [
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {size}",
    ]
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or of a URI that Arrow knows."""
    at = urlsplit(path)
    return (fs.LocalFileSystem(), unquote(at.path) if at.scheme else path) if at.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _put(folder: str, name: str, data: bytes, attempt: str) -> None:
    """Write a file below the shared folder; one that is there already came from the same rows."""
    store, root = _store(folder)
    store.create_dir(posixpath.join(root, "_writing"), recursive=True)
    part, whole = posixpath.join(root, "_writing", f"{name}.{attempt}"), posixpath.join(root, name)
    with store.open_output_stream(part) as out:
        out.write(data)
    try:
        store.move(part, whole)
    except OSError:
        if store.get_file_info(whole).size != len(data):
            raise
        store.delete_file(part)


def writer(folder: str, file_bytes: int = FILE_BYTES) -> Callable[[Batches], Batches]:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to in; file, records out."""

    def write(batches: Batches) -> Batches:
        from pyspark import TaskContext

        task = TaskContext.get()
        buffer, held, n, seq = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{task.partitionId():05d}-{seq:05d}.warc.gz"
            _put(folder, name, b"".join(buffer), f"{task.taskAttemptId()}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

        for batch in batches:
            for low, high in slices(batch.column(2)):
                for page_id, url, payload, size, digest, kind, refers_to in zip(*(c.slice(low, high - low).to_pylist() for c in batch.columns), strict=True):
                    body = b"" if kind == "revisit" else (payload or "").encode()
                    buffer.append(member(record(kind, page_id, url, body, size, digest, refers_to)))
                    held, n = held + len(buffer[-1]), n + 1
                    if held >= file_bytes:
                        yield flush()
                        buffer, held, n, seq = [], 0, 0, seq + 1
        if buffer:
            yield flush()

    return write


def planned(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """The rows with payload_bytes, payload_digest, record_type and refers_to."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(F.encode(body, "UTF-8"), 256).alias("payload_digest"))
    shared = rows.where((F.col("payload_bytes") >= min_shared) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    both = attach(rows, shared, ["payload_digest"], ["page_id"], how="left")
    again = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("first") != F.col("page_id"))
    return both.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> int:
    """Write all rows to ``folder``; returns how many records were written."""
    rows = planned(pages)
    log = rows.sortWithinPartitions("page_id", "payload_digest", "record_type", "url").mapInArrow(writer(folder), "file string, records long")
    return log.agg(F.sum("records")).first()[0] or 0


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


class Source:
    """A file of any size, read in blocks; as a stream of plain bytes it keeps those from ``base`` on."""

    error: str | None = None

    def __init__(self, file: pa.NativeFile, at: int = 0):
        self.file, self.size = file, file.size()
        self.base, self.held, self.ended = at, bytearray(), False

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at)

    def find(self, at: int, *marks: bytes) -> int:
        """Where the first of the marks starts, from ``at`` on, or the end."""
        while at < self.size:
            block = self.read(at, BLOCK)
            if found := [k for m in marks if (k := block.find(m)) >= 0]:
                return at + min(found)
            at += max(1, len(block) - 6) if at + len(block) < self.size else len(block)
        return self.size

    def more(self) -> bytes:
        return self.read(self.base + len(self.held), BLOCK)

    def fill(self, upto: int) -> bool:
        """Hold the bytes up to ``upto`` if there are so many."""
        while self.base + len(self.held) < upto and not self.ended:
            block = self.more()
            self.held += block
            self.ended = self.ended or not block
        return self.base + len(self.held) >= upto

    def forget(self, upto: int) -> None:
        del self.held[: upto - self.base]
        self.base = upto


class Member(Source):
    """The unpacked bytes of the gzip member at an offset of a source; ``after`` is where the next one starts."""

    def __init__(self, source: Source, at: int):
        self.source, self.next, self.unpack = source, at, zlib.decompressobj(31)
        self.base, self.held, self.ended, self.after, self.size = 0, bytearray(), False, at, 1 << 62

    def more(self) -> bytes:
        out = b""
        while not out and not self.ended:
            packed = self.unpack.unconsumed_tail
            if not packed:
                packed = self.source.read(self.next, BLOCK)
                self.next += len(packed)
            try:
                out = self.unpack.decompress(packed, BLOCK)
            except zlib.error:
                self.error, self.ended = "gzip checksum or data", True
            if self.unpack.eof:
                self.ended, self.after = True, self.next - len(self.unpack.unused_data)
            elif not packed and not self.ended:
                self.error, self.ended = "gzip member cut off", True
        return out


def parse_record(data: Source, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and the offset after it; ValueError if a check fails."""
    data.fill(at + 10)
    if not re.match(rb"WARC/1\.[01]\r\n", data.held[at - data.base : at - data.base + 10]):
        raise ValueError("version line")
    end, known = -1, 10
    while end < 0:
        more = data.fill(at + known + BLOCK // 16)
        end = data.held.find(b"\r\n\r\n", at - data.base)
        known += BLOCK // 16
        if end < 0 and (not more or known > HEADER_BYTES):
            raise ValueError("headers cut off")
    head = _headers(bytes(data.held[at - data.base : end]))
    length = head.get("content-length", "")
    if not length.isdecimal() or len(length) > 18:
        raise ValueError("content length")
    start = data.base + end + 4
    stop = start + int(length)
    if int(length) > RECORD_BYTES or stop + 4 > data.size or not data.fill(stop + 4):
        raise ValueError("record cut off or too long")
    if data.held[stop - data.base : stop - data.base + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    block = bytes(data.held[start - data.base : stop - data.base])
    said = head.get("warc-block-digest")
    if said and said.lower() != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest")
    kind = head.get("warc-type")
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    own = hashlib.sha256(payload).hexdigest()
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or own
    if kind == "response" and digest != own:
        raise ValueError("payload digest")
    size = head.get("x-payload-length", "")
    found = {
        "record_type": kind,
        "page_id": _page(head.get("warc-record-id")),
        "url": head.get("warc-target-uri"),
        "refers_to": _page(head.get("warc-refers-to")),
        "payload_bytes": int(size) if size.isdecimal() and kind == "revisit" else len(payload),
        "payload_digest": digest,
        "payload": None if kind == "revisit" else payload,
    }
    return found, stop + 4


def unpacked(member: Member) -> Iterator[dict]:
    """The records of a member and the gaps between them; ValueError if it fails or holds no record."""
    at, gap, why, last, n = 0, None, "", None, 0
    while member.fill(at + 1):
        try:
            found, after = parse_record(member, at)
        except ValueError as e:
            gap, why = (at, str(e)) if gap is None else (gap, why)
            while True:
                k = member.held.find(START, at + 1 - member.base)
                if k >= 0:
                    at = member.base + k
                    break
                at = max(at, member.base + len(member.held) - len(START))
                member.forget(at)
                if not member.fill(at + BLOCK // 2) and member.held.find(START, 1) < 0:
                    at = member.base + len(member.held)
                    break
            continue
        if last:
            yield last
            n += 1
        if gap is not None:
            yield {"gap_bytes": at - gap, "gap_reason": why, "inner": gap}
            gap = None
        last, at = found, after
        member.forget(at)
    if member.error or (not n and not last):
        raise ValueError(member.error or why or "empty member")
    if last:
        yield last
    if gap is not None:
        yield {"gap_bytes": at - gap, "gap_reason": why, "inner": gap}


def salvage(data: bytes | pa.NativeFile) -> Iterator[tuple[int, dict]]:
    """Offset and record, or offset and gap (gap_bytes, gap_reason), over a whole archive."""
    file = pa.BufferReader(data) if isinstance(data, bytes) else data
    source, at, gap, why = Source(file), 0, None, ""
    while at < source.size:
        begun = at
        try:
            if source.read(at, 3) == MAGIC:
                member = Member(source, at)
                for x in unpacked(member):
                    if gap is not None:
                        yield gap, {"gap_bytes": begun - gap, "gap_reason": why}
                        gap = None
                    yield begun, x
                at = member.after
            else:
                x, at = parse_record(Source(file, at), at)
                if gap is not None:
                    yield gap, {"gap_bytes": begun - gap, "gap_reason": why}
                    gap = None
                yield begun, x
        except ValueError as e:
            if gap is None:
                gap, why = begun, str(e)
            at = source.find(begun + 1, MAGIC, START)
    if gap is not None:
        yield gap, {"gap_bytes": source.size - gap, "gap_reason": why}


def reader(with_payload: bool) -> Callable[[Batches], Batches]:
    def read(batches: Batches) -> Batches:
        for path in (p.as_py() for batch in batches for p in batch.column(0)):
            store, name = _store(path)
            rows, held = [], 0
            with store.open_input_file(name) as file:
                for offset, x in salvage(file):
                    row = {"file": os.path.basename(name), "offset": offset} | x
                    if not with_payload:
                        row["payload"] = None
                    held += len(row.get("payload") or b"")
                    rows.append(row)
                    if len(rows) >= 2000 or held > (4 << 20):
                        yield _rows(rows)
                        rows, held = [], 0
            if rows:
                yield _rows(rows)

    return read


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], t) for f, t in zip(_FIELDS, _TYPES, strict=True)], names=_FIELDS)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records and gaps of the ``*.warc.gz`` and ``*.warc`` files in ``folder``.

    Spark lists the files and deals them out by size; tasks open them through Arrow.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")
    return files.mapInArrow(reader(with_payload), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    if not write_archives(pages, folder):
        return spark.createDataFrame([], RECORD)
    return read_archives(spark, folder, with_payload=False)
