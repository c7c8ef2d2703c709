"""Operator 2: from ARC, the archive format before WARC, to WARC records.

An ARC file begins with a version block, whose second line names the version, and goes on with
records: a header line, then as many bytes as its last field says.  Header lines have 5 fields
in version 1 (URL, IP, date, type, length) and 10 in version 2 (result code, checksum, location,
offset and file name come before the length).  URLs may hold spaces, so fields are counted from
the end.  Files compressed record by record are unpacked.

Every record becomes a WARC record: its identifier is a name-based UUID of URL, date and block,
so a conversion that is run again gives the same identifiers; the date is in ISO form; the type
is warcinfo for the version block, response for blocks that begin with an HTTP status line,
and resource for others; the digests are SHA-1 in base 32 of the block and, for responses, of
what follows the HTTP header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = 1 << 14
_V1 = re.compile(rb"(?P<url>\S.*) (?P<ip>[0-9A-Fa-f.:-]+) (?P<date>\d{8,14}) (?P<type>\S+) (?P<length>\d+)\r?\Z")
_V2 = re.compile(
    rb"(?P<url>\S.*) (?P<ip>[0-9A-Fa-f.:-]+) (?P<date>\d{8,14}) (?P<type>\S+) (?P<code>\d+|-) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)\r?\Z"
)
_STATUS = re.compile(rb"HTTP/\d\.\d (\d{3})")
_TYPE = re.compile(rb"^content-type:[ \t]*([^\r\n;]*)", re.IGNORECASE | re.MULTILINE)

SCHEMA = (
    "arc_name string, arc_offset bigint, warc_type string, record_id string, warc_date string, target_uri string, ip_address string, content_type string, "
    "http_status int, payload_type string, block_digest string, payload_digest string, content_length bigint, truncated boolean, warc_header string, block binary"
)


class ArcRecord(NamedTuple):
    offset: int
    url: str
    ip: str
    date: str
    type: str
    block: bytes
    truncated: bool
    version_block: bool


def unpacked(content: bytes) -> bytes:
    """``content``, decompressed if it is a series of gzip members; of a member that breaks off, what can be unpacked."""
    if content[:2] != b"\x1f\x8b":
        return content
    # a member's end is only known when it is reached, so little is read beyond it
    out, view, at = [], memoryview(content), 0
    while view[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            while at < len(view) and not member.eof:
                chunk = view[at : at + _CHUNK]
                out.append(member.decompress(chunk))
                at += len(chunk)
        except zlib.error:
            break
        if not member.eof:
            break
        at -= len(member.unused_data)
    return b"".join(out)


def arc_records(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file.

    Lines that are no header of the file's version are skipped, so reading goes on behind a
    damaged record.  A block that ends before its declared length is truncated.  Without a
    version block the version is told by each header line.
    """
    data, at, version = unpacked(content), 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        match = (None if version == 1 else _V2.match(line)) or (None if version == 2 and not line.startswith(b"filedesc:") else _V1.match(line))
        if not match:
            at = end + 1
            continue
        length = int(match["length"])
        block = data[end + 1 : end + 1 + length]
        described = match["url"].startswith(b"filedesc:")
        if described:
            head = block.split(b"\n", 1)[0].split()
            version = int(head[0]) if head and head[0] in (b"1", b"2") else version
        text = {k: match[k].decode("utf-8", "replace") for k in ("url", "ip", "date", "type")}
        yield ArcRecord(at, text["url"], text["ip"], text["date"].ljust(14, "0"), text["type"], block, len(block) < length, described)
        at = end + 1 + length


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _iso(date: str) -> str:
    month, day = (x if x != "00" else "01" for x in (date[4:6], date[6:8]))
    return f"{date[:4]}-{month}-{day}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(name: str | None, record: ArcRecord) -> tuple:
    """The fields of SCHEMA for one ARC record."""
    block_digest = digest(record.block)
    h = hashlib.md5(f"{record.url}|{record.date}|{block_digest}".encode()).hexdigest()
    record_id = f"<urn:uuid:{h[:8]}-{h[8:12]}-3{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:]}>"
    status = payload_type = payload_digest = None
    content_type = record.type
    if record.version_block:
        kind, content_type = "warcinfo", "application/warc-fields"
    elif match := _STATUS.match(record.block):
        kind, content_type, status = "response", "application/http; msgtype=response", int(match[1])
        head, gap, body = record.block.partition(b"\r\n\r\n")
        if not gap:
            head, gap, body = record.block.partition(b"\n\n")
        found = _TYPE.search(head)
        payload_type = found[1].decode("utf-8", "replace").strip() if found else record.type
        payload_digest = digest(body)
    else:
        kind = "resource"
    date = _iso(record.date)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", date),
        ("WARC-Filename" if record.version_block else "WARC-Target-URI", record.url.removeprefix("filedesc://") if record.version_block else record.url),
        ("WARC-IP-Address", None if record.version_block or record.ip in ("0.0.0.0", "-") else record.ip),
        ("WARC-Block-Digest", block_digest),
        ("WARC-Payload-Digest", payload_digest),
        ("WARC-Identified-Payload-Type", payload_type),
        ("WARC-Truncated", "length" if record.truncated else None),
        ("Content-Type", content_type),
        ("Content-Length", str(len(record.block))),
    ]
    header = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    uri = None if record.version_block else record.url
    ip = fields[4][1]
    return (name, record.offset, kind, record_id, date, uri, ip, content_type, status, payload_type, block_digest, payload_digest, len(record.block), record.truncated, header, record.block)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in SCHEMA.split(", "))])


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow_schema()
    for batch in batches:
        rows, size = [], 0
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            for record in arc_records(content.as_py()):
                rows.append(warc_record(name.as_py(), record))
                size += len(record.block)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def arc_to_warc(files: DataFrame) -> DataFrame:
    """The WARC records of ARC files, given as (arc_name, content binary).

    Result: SCHEMA; warc_header and block, joined and followed by two line ends, are the bytes
    of the record.  A row is converted by itself, so nothing is shuffled; a file is held in
    memory while it is read.

    A null content has no records, nor has an empty one or one without a header line.  A null
    arc_name stays null.  Repeated files give repeated records with the same identifiers.
    Other columns are ignored, whatever their names.  An empty table gives no rows.
    """
    return files.where(F.col("content").isNotNull()).select("arc_name", "content").mapInArrow(_convert, SCHEMA)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(arc_name, content) of the ARC files at ``path``, a folder or pattern."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("arc_name"), "content")


def warc_bytes(records: DataFrame) -> DataFrame:
    """(arc_name, arc_offset, record): each WARC record as bytes."""
    return records.select("arc_name", "arc_offset", F.concat(F.col("warc_header").cast("binary"), "block", F.lit(b"\r\n\r\n")).alias("record"))


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """Each page as an ARC file: version 1 for even page ids, 2 for odd ones.

    The block is an HTTP response with the page's html; the date is 1996 plus page_id seconds.
    Rows with a null page_id, url or html are left out.
    """
    crlf = "\r\n"
    body = F.col("html").cast("binary")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.octet_length("html").cast("string"), F.lit(crlf + crlf))
    date = F.date_format(F.timestamp_seconds(F.lit(820454400) + F.col("page_id")), "yyyyMMddHHmmss")
    length = F.octet_length(head) + F.octet_length("html")
    two = F.col("page_id") % 2 != 0
    about = F.when(two, F.lit("2 0 crawl\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n")).otherwise(
        F.lit("1 0 crawl\nURL IP-address Archive-date Content-type Archive-length\n")
    )
    name = F.concat(F.lit("page-"), F.col("page_id"), F.lit(".arc"))
    first = F.concat(F.lit("filedesc://"), name, F.lit(" 0.0.0.0 "), date, F.lit(" text/plain "))
    # The version block's own header has the fields of the version it names.
    more = lambda tail: F.when(two, F.concat(F.lit("200 - - 0 "), name, F.lit(" "), tail)).otherwise(tail)
    version = F.concat(first, more(F.octet_length(about).cast("string")), F.lit("\n"), about)
    record = F.concat(F.lit("\n"), F.col("url"), F.lit(" 192.0.2.1 "), date, F.lit(" text/html "), more(length.cast("string")), F.lit("\n"))
    return pages.where("page_id is not null and url is not null and html is not null").select(
        name.alias("arc_name"), F.concat(version.cast("binary"), record.cast("binary"), head.cast("binary"), body, F.lit(b"\n")).alias("content")
    )
