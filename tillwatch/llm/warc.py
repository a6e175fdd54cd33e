"""Legacy archives to WARC: write and parse ARC, convert, write and read WARC.

An ARC file starts with a version block whose header line declares the fields of
every record line after it:

    version 1   URL IP-address Archive-date Content-type Archive-length
    version 2   URL IP-address Archive-date Content-type Result-code Checksum
                Location Offset Filename Archive-length

Each record is that line and as many bytes as the line declares (the HTTP
response), then a line feed. The converter follows the declared lengths only, so
a payload may hold anything, and synthesises for each record a WARC record id
(name-based, from the ARC record's own facts), the timestamp, the type and the
SHA-1 digests of block and payload. Of records with equal payloads one stays a
response, the others become revisits that name it and carry the HTTP header alone.

Spark's text writer makes the files: a row is a record, the separator is what
the format puts between records. Any store works, and lost executors are covered
by the commit protocol. Files are gzip-compressed and read as a stream.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm.common import steps
from tillwatch.session import Scratch, settle

#: Fixed values of the formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
ARC_BETWEEN, WARC_BETWEEN = "\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes may become revisits.
REVISIT_FROM = 0
_PAGE = "X-Page-Id"


def digest(raw: bytes) -> str:
    return base64.b32encode(sha1(raw).digest()).decode()


def _field(text: str | None, none: str = "-") -> str:
    """A value fit for a space-separated header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text) if text else none


# --- writing ARC ---------------------------------------------------------------

def arc_rows(pages: DataFrame, version: Column) -> DataFrame:
    """(value): per partition and version the version block, then a record per page.

    ``pages`` needs page_id, url and html; the HTTP response is synthesised and
    carries the page id. Null html is an empty payload, a null url is ``-``.
    """
    stamp = datetime(2000, 1, 1, tzinfo=UTC).strftime("%Y%m%d%H%M%S")

    def run(batches):
        begun = None
        for batch in steps(batches, "html"):
            rows = []
            for page, url, html, v in zip(*(c.to_pylist() for c in batch.columns)):
                if v != begun:  # a new file section declares its fields
                    begun = v
                    body = f"{v} 0 tillwatch\n{ARC_FIELDS[v]}\n".encode()
                    tail = f"text/plain {len(body)}" if v == 1 else f"text/plain 200 - - 0 pages.arc {len(body)}"
                    rows.append(f"filedesc://pages.arc 0.0.0.0 {stamp} {tail}\n".encode() + body)
                payload = (html or "").encode("utf-8")
                name = "" if page is None else f"{_PAGE}: {page}\r\n"
                head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}"
                        f"Content-Length: {len(payload)}\r\n\r\n").encode()
                size = len(head) + len(payload)
                tail = (f"text/html {size}" if v == 1 else
                        f"text/html 200 {digest(payload)} - 0 pages.arc {size}")
                rows.append(f"{_field(url)} 0.0.0.0 {stamp} {tail}\n".encode() + head + payload)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    base = pages.select("page_id", "url", "html").withColumn("version", version)
    return base.sortWithinPartitions("version").mapInArrow(run, "value binary")


def write_rows(rows: DataFrame, folder: str, between: str) -> None:
    """Write the ``value`` bytes of each partition as one gzip file."""
    (rows.selectExpr("CAST(value AS STRING) AS value").write.option("lineSep", between)
     .option("compression", "gzip").option("zlib.compress.level", "THREE").text(folder))


def write_arc(pages: DataFrame, folder: str) -> None:
    """Archive the pages; even pages in version 1, odd ones (and null ids) in version 2."""
    write_rows(arc_rows(pages, F.expr("IF(page_id % 2 = 0, 1, 2)").cast("int")), folder, ARC_BETWEEN)


# --- streams --------------------------------------------------------------------

class Stream:
    """Bytes of a plain or gzip (any number of members) file, decompressed as needed."""

    def __init__(self, raw: bytes):
        self._raw, self._at, self._zip = memoryview(raw), 0, raw[:2] == b"\x1f\x8b"
        self._buffer, self._start = bytearray(), 0
        self._unzip = zlib.decompressobj(31) if self._zip else None

    def _more(self) -> bool:
        if self._start > 1 << 20:
            del self._buffer[:self._start]
            self._start = 0
        while self._at < len(self._raw):
            part = self._raw[self._at:self._at + (1 << 18)]
            self._at += len(part)
            if not self._zip:
                self._buffer += part
                return True
            out = self._unzip.decompress(part)
            if self._unzip.eof:
                self._at -= len(self._unzip.unused_data)
                self._unzip = zlib.decompressobj(31)
            if out:
                self._buffer += out
                return True
        return False

    def line(self) -> bytes | None:
        """The next line without its line feed; None at the end."""
        seek = self._start
        while (stop := self._buffer.find(b"\n", seek)) < 0:
            seek = len(self._buffer)
            before = self._start
            if not self._more():
                rest = bytes(self._buffer[self._start:])
                self._start = len(self._buffer)
                return rest or None
            seek -= before - self._start
        out = bytes(self._buffer[self._start:stop])
        self._start = stop + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self._buffer) - self._start < n and self._more():
            pass
        out = bytes(self._buffer[self._start:self._start + n])
        if len(out) < n:
            raise ValueError(f"record declares {n} bytes, {len(out)} are left")
        self._start += n
        return out


def arc_records(stream: Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; the version block in force names the fields."""
    fields: list[str] | None = None
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        block = stream.take(int(parts[-1]))
        if parts[0].startswith("filedesc:"):
            declared = block.decode("utf-8", "replace").split("\n")
            fields = declared[1].strip().split(" ")
            if fields not in [x.split(" ") for x in ARC_FIELDS.values()]:
                raise ValueError(f"unknown ARC fields {fields}")
            continue
        if fields is None:
            raise ValueError("ARC file without a version block")
        if len(parts) != len(fields):  # some writers left spaces in URL or type
            spare = len(parts) - len(fields)
            parts = ["%20".join(parts[:spare + 1]), *parts[spare + 1:]]
        yield dict(zip(fields, parts)), block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its blank line) and payload; a block without one is all payload."""
    at = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or at < 0:
        return b"", block
    return block[:at + 4], block[at + 4:]


def page_of(head: bytes) -> int | None:
    found = re.search(rb"(?im)^" + _PAGE.encode() + rb": (-?\d+)\r?$", head)
    return int(found.group(1)) if found else None


# --- ARC to WARC ------------------------------------------------------------------

def record_id(url: str, date: str, page: int | None, payload: str, size: int) -> str:
    """A name-based id: the same ARC record always gets the same one."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {page} {payload} {size}"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def arc_facts(spark: SparkSession, folder: str, blocks: bool) -> DataFrame:
    """One row per ARC record: page_id, url, date, mime, record id, digest, sizes (and the block)."""
    schema = ("page_id bigint, url string, date string, mime string, id string, payload string, size bigint"
              + (", block binary" if blocks else ""))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        def flush(rows):
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for fields, block in arc_records(Stream(raw.as_py())):
                    head, body = split_http(block)
                    page, name = page_of(head), digest(body)
                    when = datetime.strptime(fields["Archive-date"][:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
                    row = (page, fields["URL"], when, fields["Content-type"],
                           record_id(fields["URL"], when, page, name, len(body)), name, len(body))
                    rows.append(row + ((block,) if blocks else ()))
                    held += len(block)
                    if held > 8_000_000 or len(rows) >= 10_000:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return files(spark, folder).mapInArrow(run, schema)


def warc_rows(records: DataFrame) -> DataFrame:
    """(value): WARC records of rows from :func:`arc_facts` with ``first_id``, ``first_url``, ``first_date``.

    A row whose ``first_id`` is null is a response, any other a revisit of it.
    """
    def run(batches):
        for batch in steps(batches, "block"):
            rows = []
            for r in batch.to_pylist():
                head, _ = split_http(r["block"])
                revisit = r["first_id"] is not None
                block = head if revisit else r["block"]
                lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{r['id']}>",
                         f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}",
                         f"WARC-Payload-Digest: sha1:{r['payload']}", f"WARC-Block-Digest: sha1:{digest(block)}",
                         "Content-Type: application/http; msgtype=response"]
                if revisit:
                    lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{r['first_id']}>",
                              f"WARC-Refers-To-Target-URI: {r['first_url']}", f"WARC-Refers-To-Date: {r['first_date']}"]
                lines.append(f"Content-Length: {len(block)}")
                rows.append(("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    return records.mapInArrow(run, "value binary")


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, revisit_from: int = REVISIT_FROM) -> None:
    """Convert every ARC file of a folder; equal payloads beyond ``revisit_from`` bytes are stored once.

    The response of a group is the record with the largest page id (then record
    id; records without a page id come last). An exact repeat of that page row has
    the same record id and is a response too. Only facts are grouped, combined
    before the shuffle; the groups of two or more records are written before the
    left join, as beside a plain table Spark can split the records of a hot payload.
    """
    facts = arc_facts(spark, arc_folder, blocks=False).where(F.col("size") >= revisit_from)
    place = "named_struct('known', page_id IS NOT NULL, 'page', page_id, 'id', id, 'url', url, 'date', date)"
    groups = facts.groupBy("payload").agg(F.expr(f"max({place})").alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").selectExpr("payload", "first.id AS first_id", "first.url AS first_url", "first.date AS first_date")
    whole = arc_facts(spark, arc_folder, blocks=True)
    with Scratch(spark) as scratch:
        write_rows(warc_rows(with_first(whole, scratch.settle(groups), revisit_from)), warc_folder, WARC_BETWEEN)


def with_first(records: DataFrame, groups: DataFrame, revisit_from: int) -> DataFrame:
    """Records and, for all but the response of a group, what the revisit refers to."""
    return records.join(groups, "payload", "left").selectExpr(
        "page_id", "url", "date", "mime", "id", "payload", "size", "block",
        *[f"IF(size >= {revisit_from} AND id <> first_id, {c}, NULL) AS {c}" for c in ("first_id", "first_url", "first_date")])


# --- reading WARC -------------------------------------------------------------------

def warc_records(stream: Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record, by declared lengths."""
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.take(int(fields["content-length"]))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(id, record_type, page_id, payload_bytes, payload_digest, refers): one row per record.

    ``payload_bytes`` and the digest of a response are taken from its block and
    checked against the declared digest; a revisit has the declared digest only.
    """
    def run(batches):
        def flush(rows):
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              ["id", "record_type", "page_id", "payload_bytes", "payload_digest", "refers"])

        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for fields, block in warc_records(Stream(raw.as_py())):
                    head, body = split_http(block)
                    name, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and digest(body) != name:
                        raise ValueError(f"digest of {fields['warc-record-id']} does not match")
                    rows.append((fields["warc-record-id"], kind, page_of(head), len(body) if kind == "response" else None,
                                 name, fields.get("warc-refers-to")))
                    if len(rows) >= 10_000:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    return files(spark, folder).mapInArrow(
        run, "id string, record_type string, page_id bigint, payload_bytes bigint, payload_digest string, refers string")


def page_report(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record of the archives.

    Revisits get size and page of the response they refer to. The join goes by
    record id; the responses are written first, so that Spark can split the many
    records that refer to one of them. An empty folder gives no rows.
    """
    records = read_warc(spark, folder)
    held = settle(records.where("record_type = 'response'").groupBy("id").agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("held_bytes")).withColumnRenamed("id", "refers"))
    return records.join(held, "refers", "left").selectExpr(
        "page_id", "coalesce(payload_bytes, held_bytes) AS payload_bytes", "payload_digest", "record_type", "refers_to")
