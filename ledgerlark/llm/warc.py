"""WARC archives as a PySpark Python data source, and revisit records for repeated payloads.

Reads ordinary archives, plain or gzipped by record or as a whole, WARC/1.0 and 1.1. A partition is a file, read as a
stream. A record's headers are parsed first and tested against the pushed predicates; its payload is decoded only where
it is asked for and the record is wanted. Gzip members that tell their length (the writer's do, in an extra field of the
gzip header that other readers ignore) are passed over without being inflated. Tasks write under a temporary name and
commit moves their archives into place, so that retried tasks leave nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerlark.llm.common import discard, materialize, shared_dir
from ledgerlark.session import table

SCHEMA = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, record_id string, date string, payload binary"
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of a gzip header: flag for an extra field, and subfield "LL" with the length of the whole member.
_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00LL\x08\x00"
#: Bytes read at a time, and the most that a record's headers may take.
CHUNK, MOST_HEADERS = 1 << 20, 1 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store and path that a URI names; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int) -> bytes:
    """One gzip member that tells its own length."""
    squeezed = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeezed.compress(record) + squeezed.flush()
    return _HEAD + struct.pack("<Q", len(_HEAD) + 8 + len(body) + 8) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, digest_: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record without its payload when refers_to names the response."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(urllib.parse.quote(c) if c < " " or c == "\x7f" else c for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """Fields by lower-cased name; a line that starts with a space goes on with the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _number(value: str | None) -> int | None:
    text = (value or "").strip("<>")
    text = text.removeprefix(_ID) if text.startswith(_ID) else ""
    return int(text) if text.lstrip("-").isdigit() else None


def fields_of(h: dict[str, str]) -> dict:
    """The columns that a record's headers give."""
    named = h.get("warc-payload-digest", "")
    return {
        "page_id": _number(h.get("warc-record-id")), "url": h["warc-target-uri"].strip("<>") if "warc-target-uri" in h else None, "record_type": h.get("warc-type"), "payload_digest": named.partition(":")[2] if named.lower().startswith("sha1:") else named or None,
        "refers_to": _number(h.get("warc-refers-to")), "record_id": h["warc-record-id"].strip("<>") if "warc-record-id" in h else None, "date": h.get("warc-date"),
    }


def unchunked(body: bytes) -> bytes:
    """A body without its chunked transfer encoding; as it is where that is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return body
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


class _Stream:
    """The bytes of a plain or gzipped file, some at a time."""

    def __init__(self, file) -> None:  # noqa: ANN001
        self.file, self.buffer, self.raw, self.ended = file, bytearray(), b"", False
        self.raw = file.read(CHUNK)
        self.zipped, self.inflate, self.next_member = self.raw[:2] == b"\x1f\x8b", None, None

    def _more(self) -> bool:
        """Adds some bytes; False at the end."""
        if not self.raw:
            self.raw = self.file.read(CHUNK)
            if not self.raw:
                if self.inflate is None:
                    return False
                rest = self.inflate.decompress(b"", CHUNK)  # what the limit held back
                if not rest:
                    raise ValueError("an archive ends within a gzip member")
                self.buffer += rest
                if self.inflate.eof:
                    self.inflate = None
                return True
        if not self.zipped:
            self.buffer += self.raw
            self.raw = b""
            return True
        if self.inflate is None:
            self._begin()
        self.buffer += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None
        return True

    def _begin(self) -> None:
        """Starts a member, and notes where the next one is if it tells its length."""
        while len(self.raw) < len(_HEAD) + 8 and (more := self.file.read(CHUNK)):
            self.raw += more
        told = not self.buffer and self.raw.startswith(_HEAD)
        at = self.file.tell() - len(self.raw)
        self.next_member = at + struct.unpack_from("<Q", self.raw, len(_HEAD))[0] if told else None
        self.inflate = zlib.decompressobj(31)

    def skip_blank(self) -> bool:
        """Passes over line ends between records; False at the end of the file."""
        while True:
            n = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            del self.buffer[:n]
            if self.buffer:
                return True
            if not self._more():
                return False

    def head(self, start: int, most: int) -> int:
        """The end of the header block that begins at start of the buffer, its blank line included; -1 if there is none
        within most bytes."""
        while True:
            ends = [(i, len(e)) for e in (b"\r\n\r\n", b"\n\n") if (i := self.buffer.find(e, start, start + most)) >= 0]
            if ends:
                i, n = min(ends)
                return i + n
            if len(self.buffer) >= start + most or not self._more():
                return -1

    def fill(self, n: int) -> None:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError("an archive ends within a record")

    def drop(self, n: int) -> None:
        """Passes over n bytes, without inflating them where the member's end is known."""
        if self.next_member is not None and self.inflate is not None:
            self.file.seek(self.next_member)
            self.raw, self.inflate, self.next_member = b"", None, None
            self.buffer.clear()
            return
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer.clear()
            if not self._more():
                raise ValueError("an archive ends within a record")
        del self.buffer[:n]


@dataclass
class _Written(WriterCommitMessage):
    name: str
    size: int


@dataclass
class _File(InputPartition):
    path: str


class WarcWriter(DataSourceArrowWriter):
    """One archive for each task, moved into place when all have been written."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.level, self.date = options["path"], int(options.get("level", "1")), options.get("date", "2024-01-01T00:00:00Z")
        self.under = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = filesystem(self.path)
        store.create_dir(f"{root}/{self.under}", recursive=True)
        name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{root}/{self.under}/{name}", compression=None) as out:
            for batch in iterator:
                ids, urls, digests, refers = (batch.column(x).to_pylist() for x in ("page_id", "url", "payload_digest", "refers_to"))
                for i, payload in enumerate(batch.column("payload")):
                    data = member(record(ids[i], urls[i], payload.as_py() or b"", digests[i], refers[i], self.date), self.level)
                    out.write(data)
                    size += len(data)
        return _Written(name, size)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        for m in messages:
            if m and m.size:
                store.move(f"{root}/{self.under}/{m.name}", f"{root}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:  # noqa: ARG002
        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/{self.under}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.under}")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.names, self.verify = options["path"], [f.name for f in schema.fields], options.get("verify", "true").lower() == "true"
        self.equal: list[tuple[str, frozenset]] = []
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes equality, membership and prefix tests of what a record's headers tell; gives the others back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name is None or name in ("payload", "payload_bytes", "payload_digest"):
                yield f
            elif isinstance(f, EqualTo):
                self.equal.append((name, frozenset([f.value])))
            elif isinstance(f, In):
                self.equal.append((name, frozenset(f.value)))
            elif isinstance(f, StringStartsWith):
                self.prefix.append((name, f.value))
            else:
                yield f

    def partitions(self) -> list[_File]:
        store, root = filesystem(self.path)
        here = store.get_file_info(root)
        found = [here] if here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")))
        scheme = self.path[: self.path.index(root)] if root in self.path else ""
        return [_File(f"{scheme}{x}") for x in names] or [_File("")]

    def wanted(self, row: dict) -> bool:
        return all(row[n] is not None and row[n] in v for n, v in self.equal) and all(row[n] is not None and row[n].startswith(v) for n, v in self.prefix)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in self.names], names=self.names)

        for row in self.records(partition):
            rows.append(row)
            held += len(row.get("payload") or b"") + 200
            if held > 8 << 20:
                yield batch()
                rows, held = [], 0
        yield batch()

    def records(self, partition: _File) -> Iterator[dict]:
        if not partition.path:
            return
        store, path = filesystem(partition.path)
        with store.open_input_file(path) as file:
            stream = _Stream(file)
            while stream.skip_blank():
                end = stream.head(0, MOST_HEADERS)
                if end < 0 or stream.buffer[:5] != b"WARC/":
                    raise ValueError(f"no record where one should begin in {partition.path}")
                h = parse_headers(bytes(stream.buffer[:end]))
                length = int(h["content-length"])
                row = fields_of(h)
                if self.wanted(row):
                    yield self._told(stream, end, length, h, row, partition)
                else:
                    stream.drop(end + length)

    def _told(self, stream: _Stream, end: int, length: int, h: dict[str, str], row: dict, partition: _File) -> dict:
        """The row with what the block tells, and the stream moved past the record."""
        http = {}
        body = end
        is_http = h.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        if is_http and length:
            cut = stream.head(end, min(length, MOST_HEADERS))
            if end < cut <= end + length:
                body, http = cut, parse_headers(bytes(stream.buffer[end:cut]))
        chunks = "chunked" in http.get("transfer-encoding", "").lower()
        revisit = row["record_type"] == "revisit"
        told = http.get("content-length", "")
        row["payload_bytes"] = (int(told) if told.isdigit() else None) if revisit or chunks else end + length - body
        if "payload" in self.names and not revisit:
            stream.fill(end + length)
            payload = bytes(stream.buffer[body : end + length])
            payload = unchunked(payload) if chunks else payload
            found = digest(payload)
            if self.verify and h.get("warc-payload-digest", "").lower().startswith("sha1:") and "warc-truncated" not in h and found != row["payload_digest"].upper():
                raise ValueError(f"the payload of {row['record_id']} in {partition.path} has another digest than its header says")
            row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}
            del stream.buffer[: end + length]
        else:
            stream.drop(end + length)
        return row


class WarcDataSource(DataSource):
    """Format "warc"; options path (a folder or file), level (of compression), date (of written records) and verify (of
    SHA-1 payload digests, where payloads are read; true unless it says false)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes a record for each row of pages (page_id, url, html) under path.

    Of rows with equal payloads of at least least_bytes bytes, that with the smallest page_id is a response record and
    the others revisit it; rows that repeat that id are responses too. Smaller payloads, and rows with a null id, are
    responses. A null html is an empty payload, a null url has no target header, extra columns are ignored, and an empty
    table gives an archive without records.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload")).withColumns({"sha1": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    # Only digests and sizes are grouped. What repeats is a table of known size, so payloads are moved only where it is
    # too large to be broadcast; then it is joined on the size too, so that both sides are dealt anew and a hot payload is split.
    first = rows.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("size").alias("size"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "repeated")
    told = rows.join(first, ["sha1", "size"], "left").select("page_id", "url", "payload", "sha1", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    told.mapInArrow(_with_digest, SCHEMA).write.format("warc").mode("append").option("path", path).save()
    discard(first)


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        strings, numbers = pa.nulls(len(b), pa.string()), pa.nulls(len(b), pa.int64())
        digests = pa.array([base64.b32encode(x).decode() for x in b.column("sha1").to_pylist()], pa.string())
        columns = {"page_id": b.column("page_id"), "url": b.column("url"), "record_type": strings, "payload_digest": digests, "payload_bytes": numbers, "refers_to": b.column("refers_to"), "record_id": strings, "date": strings, "payload": b.column("payload")}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def read_archive(spark: SparkSession, path: str, payload: bool = True, verify: bool = True) -> DataFrame:
    """The records of a folder of archives or of one; without payload none is decoded, and digests are those that the
    headers tell. With payloads, digests and lengths are the payloads' own."""
    register(spark)
    return spark.read.format("warc").schema(SCHEMA if payload else SCHEMA.rpartition(",")[0]).option("path", path).option("verify", str(verify).lower()).load()


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(table(spark, sf_dir, "pages"), path)
    # Payloads are read, so that digests and lengths are found and not taken from headers.
    read = read_archive(spark, path).withColumn("read", F.octet_length("payload"))
    return read.select("page_id", F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(F.col("read")).cast("bigint").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc_revisits": op9_warc_revisits}

#: Base32 takes five bits a character: five hexadecimal digits are four of them.
ORACLE_SQL = {
    "op9_warc_revisits": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
        ), h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS sha, min(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p
        )
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM h
    """,
}
