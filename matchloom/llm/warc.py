"""WARC archives: written as one gzip member per record, read sequentially.

An archive is a byte stream. As executors share no local folders, the stream is kept as a Parquet table of chunks
(archive, seq, data) in the shared folder; the chunks of an archive, concatenated, are a regular ``.warc.gz`` file.

The reader (``RecordReader``) takes the stream in pieces of any size: it decompresses member by member with one
incremental zlib object, parses the header block, frames the block by Content-Length, and hashes block and payload as the
bytes pass, so that no record need fit in memory unless its payload is asked for. Digests are compared with those in
the header, as far as it states any. Records of every type are read: where the Content-Type is ``application/http``, the
payload is what follows the HTTP header, elsewhere (warcinfo, metadata, resource, plain responses) the whole block. A member that
cannot be decompressed or framed is reported as a damaged record; reading goes on at the next member.

Among pages with equal payloads the one with the smallest page_id is written as a response and the others as revisit
records (identical-payload-digest), which carry the original HTTP header block and refer to the response.

Defined cases: null html is the empty payload; null url is written as ``about:blank``; a null page_id is never chosen as
the response while another page has the same payload; rows repeated in full are all of the kind of the first; payloads
shorter than ``least_bytes`` are all responses; an empty table writes no archive and gives an empty result; an archive that ends
inside a record gives a damaged record for it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable
from .common import materialise, read_table, shared_dir

CHUNK = 1 << 14
ARCHIVE_BYTES = 1 << 23
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member; ``refers_to`` is the page of the response if this is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


@dataclass
class Record:
    """What the reader keeps of a record once it has passed."""

    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_digest: str = ""
    verified: bool = False
    payload: bytes | None = None
    damage: str | None = None


_MAGIC = b"\x1f\x8b\x08"
_LONGEST_HEAD = 1 << 20


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _sha1_text(value: bytes) -> str:
    return "sha1:" + base64.b32encode(value).decode()


class RecordReader:
    """Feed pieces of an archive, get its records in order; ``close`` reports a stream that ends inside a record."""

    def __init__(self, with_payload: bool = False) -> None:
        self.with_payload = with_payload
        self.zip = zlib.decompressobj(31)
        self.fresh = True
        self.lost = False  # looking for the next member behind damage
        self.again = False
        self.tail = b""
        self._reset()

    def _reset(self) -> None:
        self.buffer = b""
        self.record: Record | None = None
        self.left = 0
        self.in_http = False
        self.block_hash, self.payload_hash = hashlib.sha1(), hashlib.sha1()
        self.kept: list[bytes] = []
        self.size = 0
        self.bad: str | None = None

    def feed(self, data: bytes) -> Iterator[Record]:
        while data:
            if self.lost:
                data = self._found(data)
                continue
            self.fresh = False
            try:
                plain = self.zip.decompress(data)
            except zlib.error as error:
                # Bytes that only look like a member's beginning end here again and again: one report until a record's header is read.
                if self.record is not None or not self.again:
                    yield self._damaged(f"not a gzip member: {error}")
                self._reset()
                self.lost = self.fresh = self.again = True
                data = data[1:] if data.startswith(_MAGIC) else data
                continue
            try:
                if self.bad is None:
                    self._take(plain)
                if not self.zip.eof:
                    return
                done = self._finish() if self.bad is None else self._damaged(self.bad)
            except ValueError as error:
                self.bad = str(error)
                if not self.zip.eof:
                    return  # the rest of the member is passed over
                done = self._damaged(self.bad)
            data = self.zip.unused_data
            self.zip = zlib.decompressobj(31)
            self.fresh, self.again = True, False
            yield done

    def close(self) -> Iterator[Record]:
        if not self.fresh:
            self.fresh = True
            yield self._damaged("the archive ends inside a record")

    def _found(self, data: bytes) -> bytes:
        """What follows from the next member's first bytes on (nothing yet, if there is none)."""
        data = self.tail + data
        at = data.find(_MAGIC)
        if at < 0:
            self.tail = data[1 - len(_MAGIC) :]
            return b""
        self.tail, self.lost = b"", False
        self.zip = zlib.decompressobj(31)
        return data[at:]

    def _damaged(self, reason: str) -> Record:
        headers = self.record.headers if self.record else {}
        self._reset()
        return Record(headers, damage=reason)

    def _take(self, plain: bytes) -> None:
        self.buffer += plain
        if self.record is None:
            end = self.buffer.find(b"\r\n\r\n")
            if end < 0:
                if len(self.buffer) > _LONGEST_HEAD or not self.buffer.startswith(b"WARC/"[: len(self.buffer)]):
                    raise ValueError("not a WARC record")
                return
            headers = _fields(self.buffer[:end])
            if not self.buffer.startswith(b"WARC/") or not headers.get("content-length", "").isdigit():
                raise ValueError("not a WARC record")
            self.record = Record(headers)
            self.left = int(headers["content-length"])
            self.in_http = headers.get("content-type", "").lower().startswith("application/http")
            self.buffer = self.buffer[end + 4 :]
        if self.left and self.in_http:
            end = self.buffer.find(b"\r\n\r\n", 0, self.left)
            if end < 0:
                if len(self.buffer) >= min(self.left, _LONGEST_HEAD):
                    raise ValueError("an HTTP block without the end of its header")
                return
            head = self.buffer[: end + 4]
            self.record.http = _fields(head)
            self.block_hash.update(head)
            self.left -= len(head)
            self.buffer = self.buffer[end + 4 :]
            self.in_http = False
        if self.left and not self.in_http:
            piece = self.buffer[: self.left]
            self.block_hash.update(piece)
            self.payload_hash.update(piece)
            self.size += len(piece)
            self.left -= len(piece)
            self.buffer = self.buffer[len(piece) :]
            if self.with_payload:
                self.kept.append(piece)

    def _finish(self) -> Record:
        record = self.record
        if record is None or self.left or self.buffer != b"\r\n\r\n":
            raise ValueError("a record does not fill its Content-Length")
        stated = {k: record.headers.get(f"warc-{k}-digest", "") for k in ("block", "payload")}
        own = {"block": _sha1_text(self.block_hash.digest()), "payload": _sha1_text(self.payload_hash.digest())}
        record.payload_bytes = self.size
        record.payload_digest = own["payload"].removeprefix("sha1:")
        record.payload = b"".join(self.kept) if self.with_payload else None
        compared = ["block", "payload"]
        if record.headers.get("warc-type") == "revisit":
            # The payload is elsewhere: its size and digest are what the record says of it.
            compared = ["block"]
            length = record.http.get("content-length", "")
            record.payload_bytes = int(length) if length.isdigit() else 0
            record.payload_digest = stated["payload"].removeprefix("sha1:")
            record.payload = None
        record.verified = all(own[k] == stated[k] for k in compared if stated[k].startswith("sha1:"))
        self._reset()
        return record


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): for each page the page whose response it revisits, else null."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    groups = (
        rows.select("page_id", "sha1", F.octet_length("html").alias("bytes"))
        .where(F.col("bytes") >= least_bytes)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select(F.col("sha1").alias("same"), "first_id")
    )
    # Written out, so that the join below meets plain exchanges and adaptive execution can split a payload with many copies.
    groups = materialise(groups, "payload-groups")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))
    return rows.join(groups, F.col("sha1") == F.col("same"), "left").select("page_id", "url", "html", F.when(F.col("first_id").isNotNull() & other, F.col("first_id")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``plan_records`` rows as archives, a new one in each task after ``archive_bytes``, as a table of chunks."""
    ensure_importable(records.sparkSession)
    schema = pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = seq = written = 0
        pending = bytearray()

        def chunks(all_of_it: bool) -> pa.RecordBatch | None:
            nonlocal seq
            parts = []
            upto = len(pending) if all_of_it else len(pending) // CHUNK * CHUNK
            for k in range(0, upto, CHUNK):
                parts.append(bytes(pending[k : min(upto, k + CHUNK)]))
            del pending[:upto]
            if not parts:
                return None
            out = pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:04d}"] * len(parts)), pa.array(range(seq, seq + len(parts)), pa.int64()), pa.array(parts, pa.binary())], schema=schema)
            seq += len(parts)
            return out

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c for c in batch.columns)):
                member = write_record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "replace"), refers_to.as_py())
                pending += member
                written += len(member)
                full = written >= archive_bytes
                if full or len(pending) >= 64 * CHUNK:
                    out = chunks(full)
                    if out is not None:
                        yield out
                if full:
                    number, seq, written = number + 1, 0, 0
        out = chunks(True)
        if out is not None:
            yield out

    records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, seq long, data binary").write.option("compression", "none").parquet(path)


def read_archives(chunks: DataFrame) -> DataFrame:
    """One row per record of a table of chunks: page_id, record_type, refers_to, payload_bytes, payload_digest, verified, damage (null if none)."""
    ensure_importable(chunks.sparkSession)
    schema = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("damage", pa.string())])

    def page(value: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(found[1]) if found else None

    def row(name: str, r: Record) -> tuple:
        h = r.headers
        return name, page(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), page(h.get("warc-refers-to")), r.payload_bytes, r.payload_digest, r.verified, r.damage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, archive = RecordReader(), None
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != archive:
                    rows += [row(archive, r) for r in reader.close()]
                    reader, archive = RecordReader(), name
                rows += [row(name, r) for r in reader.feed(data.as_py())]
            if rows:
                yield table(rows)
        rows = [row(archive, r) for r in reader.close()]
        if rows:
            yield table(rows)

    ordered = chunks.repartition("archive").sortWithinPartitions("archive", "seq").select("archive", "data")
    return ordered.mapInArrow(run, "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, damage string")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(read_table(spark, sf_dir, "pages")), path)
    chunks = spark.read.schema("archive string, seq long, data binary").parquet(path)
    return read_archives(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified", "damage")
