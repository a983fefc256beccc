"""Legacy ARC archives and their conversion to WARC.

``write_arc`` stores pages as ARC files, ``convert`` reads ARC files of either
version and writes the equivalent WARC files, and ``read_warc`` reads those.
Files are written by Spark's text writer, so that they reach any store: with the
blank lines that end a WARC record as line separator, its output is a WARC file
byte for byte. Blocks are bytes throughout; where they pass through string
columns it is without decoding, so any charset comes out as it went in. An
archive holds RECORDS records of up to SMALL_BYTES; larger ones stand in archives
of their own of about ARCHIVE_BYTES, which bounds what a task reads.

ARC: a version block, then records of one header line and as many bytes as its
last field declares. Version 1 lines have five fields (URL, IP, date, type,
length), version 2 lines ten (with result code, checksum, location, offset and
file name before the length). The converter derives a record id (a UUID from
SHA-1 of the URL, date, place and payload), the ISO date, the record type and
SHA-1 digests of payload and block. A record with an HTTP header becomes a
response; one without (DNS, FTP and the like) a resource with the ARC's own
content type. Of records with equal payloads of at least
REVISIT_BYTES that with the largest page id is the response; the others become
revisits, which keep the HTTP header and refer to it.

Defined cases: null html is an empty payload; a null url is written as '-' and
white space in one as %20; a null page id stays null and is never referred to;
bytes of an ARC URL that are no UTF-8 become %XX;
rows with the same page id and payload are responses alike; an empty table gives
no archives and no rows; extra columns are ignored; a length that overruns the
file or a digest that does not match raises ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote_from_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch

RECORDS = 5000
SMALL_BYTES, ARCHIVE_BYTES = 100_000, 500_000_000
REVISIT_BYTES = 1000
#: Groups of equal payloads (about 250 bytes each) up to so many are broadcast to the rows they mark.
BROADCAST_GROUPS = 100_000
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    offset: int


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of an uncompressed ARC stream, without the version block."""
    offset, fields = 0, None
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        try:
            text = line.decode()
        except UnicodeDecodeError:
            text = quote_from_bytes(line, safe=bytes(range(128)))
        parts = text.rstrip("\r\n").split(" ")
        length = int(parts[-1])
        content = stream.read(length)
        offset += len(content)
        if len(content) < length:
            raise ValueError(f"ARC record at {start} declares {length} bytes; {len(content)} follow")
        if parts[0].startswith("filedesc:"):
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            fields = len(ARC_FIELDS[version].split(" "))
            continue
        if fields is None or len(parts) != fields:
            raise ValueError(f"ARC header line at {start} has {len(parts)} fields, not {fields}")
        yield ArcRecord(parts[0], parts[1], parts[2], parts[3], content, start)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload."""
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if block.startswith(b"HTTP/") and at >= 0 else (b"", block)


def http_field(header: bytes, name: str) -> str | None:
    for line in header.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("latin-1")
    return None


def read_warc_stream(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"WARC record declares {length} bytes; {len(block)} follow")
        yield head, block


def opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def _place() -> Column:
    """The number of a row within its partition."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)


def _bytes(c: Column | str) -> Column:
    return F.octet_length(c)


def _by_size(rows: DataFrame, size: Column, most: int, records: int, write) -> None:
    """Call write(rows, records an archive, name) for small records, and for large ones where there are any; most: the largest size."""
    write(rows.where(size <= SMALL_BYTES) if most > SMALL_BYTES else rows, records, "small")
    if most > SMALL_BYTES:
        write(rows.where(size > SMALL_BYTES), max(1, min(records, ARCHIVE_BYTES // most)), "large")


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", records: int = RECORDS) -> None:
    """Store pages(page_id, url, html) as gzipped ARC files, of version 1 and 2 by turns of partitions."""
    version = F.pmod(F.spark_partition_id(), F.lit(2)) + 1
    html = F.coalesce("html", F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.lit("-")), r"\s", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), _bytes(html).cast("string"),
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("page_id").cast("string")), F.lit("")), F.lit("\r\n\r\n"),
    )
    made = [html.alias("html"), F.when(url == "", "-").otherwise(url).alias("url"), http.alias("http"), version.alias("version")]
    length = (_bytes("http") + _bytes("html")).cast("string")
    line = F.when(
        F.col("version") == 1, F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), length)
    ).otherwise(F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages.arc"), length))
    heads = {}
    for v, fields in ARC_FIELDS.items():
        body = f"{v} 0 deltaweave\n{fields}\n"
        more = "" if v == 1 else " 200 - - 0 pages.arc"
        heads[v] = f"filedesc://pages.arc 0.0.0.0 {date} text/plain{more} {len(body)}\n{body}\n"
    first = F.when(F.col("place") == 0, F.when(F.col("version") == 1, heads[1]).otherwise(heads[2])).otherwise("")
    value = F.concat(first, line, F.lit("\n"), F.col("http"), F.col("html"))

    def write(rows: DataFrame, each: int, name: str) -> None:
        placed = rows.select(*made, (_place() % each).alias("place"))
        placed.select(value.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", each).text(f"{path}/{name}")

    _by_size(pages, _bytes(html), pages.agg(F.max(_bytes(html))).first()[0] or 0, records, write)


CONVERTED = "page_id bigint, url string, ip string, date string, mime string, record_id string, http binary, payload binary, payload_bytes bigint, digest string, block_digest string"


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            size = 0
            for r in read_arc(opened(content.as_py())):
                http, payload = split_http(r.content)
                digest = hashlib.sha1(payload).hexdigest()
                seed = hashlib.sha1(f"{r.url} {r.date} {http_field(http, 'X-Page-Id')} {digest}".encode()).hexdigest()
                uid = f"<urn:uuid:{seed[:8]}-{seed[8:12]}-5{seed[13:16]}-a{seed[17:20]}-{seed[20:32]}>"
                d = r.date
                page = http_field(http, "X-Page-Id")
                rows.append((
                    int(page) if page else None, r.url, r.ip, f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
                    r.mime, uid, http, payload, len(payload), digest, hashlib.sha1(r.content).hexdigest(),
                ))
                size += len(payload)
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


_TYPES = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in CONVERTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")


def convert(spark: SparkSession, arc: str, warc: str, records: int = RECORDS) -> None:
    """Write the WARC files equivalent to the ARC files below ``arc``."""
    scratch = Scratch(spark, "arc")
    rows = scratch.keep(_files(spark, arc).mapInArrow(_convert, CONVERTED), "converted")
    groups = (
        rows.where((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
        .groupBy("digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "record_id", "url", "date")).alias("kept"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    groups = scratch.keep(groups, "groups")
    if groups.count() <= BROADCAST_GROUPS:  # else payloads are shuffled by digest
        groups = F.broadcast(groups)
    marked = rows.join(groups, ["digest", "payload_bytes"], "left").withColumn("revisit", F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept.page_id")))
    http, payload = (F.col(c).cast("string") for c in ("http", "payload"))  # the same bytes
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, payload))
    bare = F.octet_length("http") == 0
    kind = F.when(F.col("revisit"), "revisit").when(bare, "resource").otherwise("response")
    mime = F.when(bare, F.when(F.col("mime").rlike("/"), F.col("mime")).otherwise("application/octet-stream")).otherwise("application/http; msgtype=response")
    refers = F.when(
        F.col("revisit"),
        F.concat(
            F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), F.col("kept.record_id"), F.lit("\r\nWARC-Refers-To-Target-URI: "), F.col("kept.url"),
            F.lit("\r\nWARC-Refers-To-Date: "), F.col("kept.date"), F.lit("\r\nX-Refers-To-Page-Id: "), F.col("kept.page_id").cast("string"),
            F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"),
        ),
    ).otherwise(F.concat(F.lit("WARC-Block-Digest: sha1:"), F.col("block_digest"), F.lit("\r\n")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: "), F.col("record_id"), F.lit("\r\nWARC-Date: "), F.col("date"), F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-IP-Address: "), F.col("ip"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"), refers,
        F.lit("Content-Type: "), mime, F.lit("\r\nContent-Length: "), _bytes(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    info = "software: deltaweave\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-5000-a000-000000000000>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}\r\n\r\n"

    def write(rows: DataFrame, each: int, name: str) -> None:
        value = F.concat(F.when(_place() % each == 0, head).otherwise(""), record)
        rows.select(value.alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", each).text(f"{warc}/{name}")

    most = rows.agg(F.max("payload_bytes")).first()[0] or 0
    _by_size(marked, F.col("payload_bytes"), most, records, write)
    scratch.drop()


READ = "page_id bigint, url string, record_id string, date string, record_type string, payload_bytes bigint, payload_digest string, refers_to_id string, refers_to bigint, payload binary"


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), *[pa.string()] * 4, pa.int64(), *[pa.string()] * 2, pa.int64(), pa.binary()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in read_warc_stream(opened(content.as_py())):
                    kind = head["warc-type"]
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    http, payload = (b"", block) if kind == "resource" else split_http(block)
                    declared = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and hashlib.sha1(payload).hexdigest() != declared:
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    page, to = http_field(http, "X-Page-Id"), head.get("x-refers-to-page-id")
                    rows.append((
                        int(page) if page else None, head["warc-target-uri"], head["warc-record-id"], head["warc-date"], kind,
                        len(payload) if kind != "revisit" else int(head.get("x-payload-length") or http_field(http, "Content-Length") or 0), declared,
                        head.get("warc-refers-to"), int(to) if to else None, payload if payloads and kind != "revisit" else None,
                    ))
                    size += len(payload) * payloads
                    if size > 8 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each response, resource and revisit below ``path``; payloads (bytes) are checked against their digests."""
    return _files(spark, path).mapInArrow(_read(payloads), READ)
