"""WARC records in ZIP-packaged archives: written by tasks, read back by byte ranges.

An archive is a ZIP file with stored (uncompressed) members ``archive/data.warc.gz`` (one gzip
member per record) and ``indexes/index.cdx`` (one line per record: sort key, time, JSON with the
record's offset and length inside the archive member). The reader finds the end-of-central-directory
record from the file's tail, follows it (and the ZIP64 locator and extra fields where sizes or
offsets need them) to the central directory, locates the stored members, reads the index and
then each record by its own byte range; no member is extracted.

Archives are written by Spark's own file writer and listed by its ``binaryFile`` source, so any
store that Spark reaches will do. An archive holds about ``ARCHIVE_BYTES`` of records (one
larger record makes a larger archive), so a task's memory is bounded.

Deduplication: records with equal payloads (SHA-1 of the UTF-8 bytes) of at least ``min_bytes``
keep the payload only in the one with the smallest page id (``response``); the others become
``revisit`` records that refer to it. The smallest id per digest is a map-side combined
aggregate; a digest that holds a third of all rows is split by the skew join.

Edge cases: a null payload is empty; a null url has a URN in its place. Rows that repeat the
smallest page id of a payload are all responses. A null page id sorts after all others and is
never referred to while another exists. No rows write one archive without records or none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.session import scratch_path

ARCHIVE_BYTES = 8 << 20
WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdx"
_DATE = "2024-01-01T00:00:00Z"

# Fixed values of the ZIP format.
_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


def digest(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing -----------------------------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 response record, or a revisit record (HTTP head only) where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else str(page_id)
    uri = (url or f"urn:page:{name}").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{sha}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Builds one archive in memory. ``zip64`` forces the 64-bit directory (else used where needed)."""

    def __init__(self, zip64: bool = False):
        self._warc = io.BytesIO()
        self._index: list[str] = []
        self._zip64 = zip64

    @property
    def size(self) -> int:
        return self._warc.tell()

    def add(self, url: str | None, raw: bytes) -> None:
        packed = gzip.compress(raw, compresslevel=1, mtime=0)
        fields = {"offset": self.size, "length": len(packed), "filename": WARC_MEMBER}
        self._index.append(f"{len(self._index):012d} {_DATE} {json.dumps(fields)}")
        self._warc.write(packed)

    def finish(self) -> bytes:
        """The archive. Its ZIP comment is one line feed: the text sink ends a row with it."""
        index = "".join(f"{line}\n" for line in self._index).encode()
        out, central = io.BytesIO(), b""
        members = ((WARC_MEMBER, self._warc.getvalue()), (INDEX_MEMBER, index))
        for name, data in members:
            at, crc, size = out.tell(), zlib.crc32(data), len(data)
            big = self._zip64 or size >= _MAX32 or at >= _MAX32
            extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
            short = _MAX32 if big else size
            out.write(_LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short,
                                           len(name), len(extra)) + name.encode() + extra)
            out.write(data)
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            central += _CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc,
                                              short, short, len(name), len(extra), 0, 0, 0, 0,
                                              _MAX32 if big else at) + name.encode() + extra
        start, size, n = out.tell(), len(central), len(members)
        out.write(central)
        if self._zip64 or start >= _MAX32:
            end = out.tell()
            out.write(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            out.write(_LOCATOR64 + struct.pack("<IQI", 0, end, 1))
            n, size, start = _MAX16, _MAX32, _MAX32
        out.write(_END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 1))
        return out.getvalue()  # the comment's line feed follows when the row is written


# Reading -----------------------------------------------------------------------------------

class Ranges:
    """Byte ranges of a file held in memory or open for reading; ``bytes_read`` counts what was read."""

    def __init__(self, source):
        self._source = memoryview(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
        if isinstance(self._source, memoryview):
            self.size = len(self._source)
        else:
            self.size = self._source.seek(0, io.SEEK_END)
        self.bytes_read = 0

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} is outside of {self.size} bytes")
        self.bytes_read += length
        if isinstance(self._source, memoryview):
            return bytes(self._source[offset: offset + length])
        self._source.seek(offset)
        return self._source.read(length)


@dataclass
class Member:
    """A stored member: its bytes are ``offset .. offset + size`` of the file."""

    name: str
    offset: int
    size: int


def central_directory(file: Ranges) -> tuple[int, int, int]:
    """Offset, size and entry count of the central directory, by ZIP64 records where needed."""
    tail = min(file.size, 22 + _MAX16)
    data = file.read(file.size - tail, tail)
    at = data.rfind(_END)
    while at >= 0:
        comment = struct.unpack_from("<H", data, at + 20)[0] if at + 22 <= tail else -1
        if comment >= 0 and at + 22 + comment == tail:
            break
        at = data.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file or cut short")
    n, size, offset = struct.unpack_from("<HII", data, at + 10)
    if _MAX16 in (n,) or _MAX32 in (size, offset):
        where = file.size - tail + at - 20
        locator = file.read(where, 20) if where >= 0 else b""
        if locator[:4] == _LOCATOR64:
            end = struct.unpack_from("<Q", locator, 8)[0]
            record64 = file.read(end, 56)
            if record64[:4] != _END64:
                raise ValueError("the ZIP64 locator points at no ZIP64 end record")
            n, size, offset = struct.unpack_from("<QQQ", record64, 32)
    return offset, size, n


def members(file: Ranges) -> list[Member]:
    """Stored members, in directory order. Compressed members are refused: they have no byte ranges."""
    offset, size, n = central_directory(file)
    data, at, out = file.read(offset, size), 0, []
    for _ in range(n):
        if data[at: at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", data, at + 10)
        packed, plain, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", data, at + 20)
        header, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46: at + 46 + name_len].decode()
        extra = data[at + 46 + name_len: at + 46 + name_len + extra_len]
        at += 46 + name_len + extra_len + comment_len
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values, only of the fields that are at their maximum
                values = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(values) if plain == _MAX32 else plain
                packed = next(values) if packed == _MAX32 else packed
                header = next(values) if header == _MAX32 else header
            extra = extra[4 + length:]
        if method != 0 or packed != plain:
            raise ValueError(f"member {name} is compressed")
        local = file.read(header, 30)
        if local[:4] != _LOCAL:
            raise ValueError(f"member {name} has no local header")
        out.append(Member(name, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed))
    return out


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """WARC headers and block of each indexed record of an archive, by range reads."""
    file = source if isinstance(source, Ranges) else Ranges(source)
    found = {m.name: m for m in members(file)}
    for name, index in found.items():
        if not name.startswith("indexes/"):
            continue
        for line in file.read(index.offset, index.size).decode().splitlines():
            fields = json.loads(line.split(" ", 2)[2])
            member = found[fields["filename"]]
            if fields["offset"] + fields["length"] > member.size:
                raise ValueError("an index line points outside its member")
            raw = zlib.decompress(file.read(member.offset + fields["offset"], fields["length"]), 31)
            head, _, rest = raw.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]


# On Spark ----------------------------------------------------------------------------------

def with_references(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                    html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, sha, refers_to) of each page; ``refers_to`` null for a response."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # The aggregate reads the table again rather than its payloads being kept: only digests are shuffled for it.
    first = (rows.filter(F.length("payload") >= min_bytes).groupBy("sha")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return (rows.join(first, "sha", "left")
            .withColumn("refers_to", F.expr("CASE WHEN first_id <=> page_id THEN NULL ELSE first_id END"))
            .select("page_id", "url", "payload", "refers_to"))


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> str:
    """Write rows of ``with_references`` as archives below ``path``; returns ``path``."""

    def run(batches):
        writer = ArchiveWriter(zip64)
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(url, record(page_id, url, payload, digest(payload), refers_to))
                if writer.size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], names=["value"])
                    writer = ArchiveWriter(zip64)
        if writer.size:
            yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], names=["value"])

    # A file per row: the text sink writes the bytes as they are and ends the row with the ZIP comment.
    (rows.mapInArrow(run, "value binary").select(F.expr("CAST(value AS STRING)").alias("value"))
     .write.option("maxRecordsPerFile", 1).mode("errorifexists").text(path))
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``: page_id, url, payload_bytes (of the full
    payload), payload_digest, record_type, refers_to and the payload (null for a revisit)."""
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, payload binary")
    names = [c.split()[0] for c in schema.split(", ")]

    def number(urn: str | None) -> int | None:
        value = urn[len("<urn:page:"):-1] if urn else "null"
        return None if value == "null" else int(value)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in read_records(memoryview(content.as_buffer())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                    response = headers["WARC-Type"] == "response"
                    rows.append((number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"],
                                 int(http["Content-Length"]), headers["WARC-Payload-Digest"].partition(":")[2],
                                 headers["WARC-Type"], number(headers.get("WARC-Refers-To")),
                                 payload if response else None))
                if rows:
                    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # Few archives a batch: each row is a whole archive.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives in the shared scratch folder and read them back."""
    spark = pages.sparkSession
    path = write_archives(with_references(pages, min_bytes), scratch_path(spark, f"wacz-{uuid.uuid4().hex[:8]}"),
                          archive_bytes)
    return read_archives(spark, path)
