"""WARC: legacy ARC archives are parsed and rewritten as equivalent WARC records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import chosen, hot_join
from tidemark.session import fresh_path

#: The field line of each ARC version, which also stands in the version block of every archive.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: HTTP header that carries the row's id through both formats.
ID_HEADER = "X-Row-Id"
_WRITE = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _unzipped(content: bytes) -> bytes:
    """The whole archive; a file may be plain, one gzip member, or a member for each record."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def arc_url(url: Column, row_id: Column) -> Column:
    """A URL that fits a space-separated line: white space and controls are escaped, null becomes a name of the row."""
    safe = F.regexp_replace(F.regexp_replace(url, " ", "%20"), r"[\x00-\x20\x7F]", "%0A")
    return F.when(url.isNull() | (url == ""), F.concat(F.lit("urn:row:"), F.coalesce(row_id.cast("string"), F.lit("null")))).otherwise(safe)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1, date: str = "20200101000000") -> None:
    """Write one ARC record per row, a file for each input partition with its version block first."""
    rows = chosen(pages, {"id": id_col, "url": url_col, "html": html_col})
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ID_HEADER}: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    length = (F.octet_length(head) + F.octet_length(body)).cast("string")
    start = [arc_url(F.col("url"), F.col("id")), F.lit("0.0.0.0"), F.lit(date), F.lit("text/html")]
    rest = [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages.arc")] if version == 2 else []
    record = F.concat(F.concat_ws(" ", *start, *rest, length).cast("binary"), F.lit("\n").cast("binary"), head, body)

    def with_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n"
        extra = " 200 - - 0 pages.arc" if version == 2 else ""
        block = f"filedesc://pages.arc 0.0.0.0 {date} text/plain{extra} {len(names)}\n{names}"
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([block.encode()], pa.binary())], names=["record"])
                first = False
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary())], names=["record"])

    made = rows.select(record.alias("record")).mapInArrow(with_block, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.options(**_WRITE, lineSep="\n").text(path)


def parse_arc(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of an unzipped archive.

    The version block names the fields of the lines that follow; without one,
    version 1 is read. Lengths are declared; blank lines between records are
    skipped. A line that fits no field list is skipped, a record that is cut
    short is given as far as it goes.
    """
    fields = ARC_FIELDS[1].lower().split()
    at, end = 0, len(content)
    while at < end:
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = content.find(b"\n", at)
        stop = end if stop < 0 else stop
        parts = content[at:stop].decode("utf-8", "replace").strip().split(" ")
        if parts[0].startswith("filedesc:") and parts[-1].isdigit():
            block = content[stop + 1 : stop + 1 + int(parts[-1])].decode("utf-8", "replace").split("\n")
            version = int(block[0].split(" ")[0]) if block[0][:1].isdigit() else 1
            fields = (block[1] if len(block) > 1 and block[1] else ARC_FIELDS.get(version, ARC_FIELDS[1])).lower().split()
            at = stop + 1 + int(parts[-1])
        elif len(parts) == len(fields) and parts[-1].isdigit():
            size = int(parts[-1])
            yield at, dict(zip(fields, parts, strict=True)), content[stop + 1 : stop + 1 + size]
            at = stop + 1 + size
        else:
            at = stop + 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head without its blank line, and payload; a block without a head is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        head, mark, body = block.partition(b"\n\n")
    return head, body


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text) else None


def arc_records(archive: str, content: bytes) -> Iterator[tuple]:
    """(record id, row id, url, date, payload digest, payload bytes, head, payload) of each record of one archive."""
    for at, fields, block in parse_arc(content):
        head, payload = split_http(block)
        d = fields.get("archive-date", "")
        date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z" if re.fullmatch(r"\d{14}", d) else "1970-01-01T00:00:00Z"
        name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}')}>"
        yield name, _number(http_field(head, ID_HEADER)), fields.get("url"), date, payload_digest(payload), len(payload), head, payload


_ARC_ROWS = "archive string, record_id string, row_id long, url string, date string, payload_digest string, payload_bytes long, head binary, payload binary"


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per ARC record below ``path``, with the identifier, date and digest that its WARC record gets.

    The identifier follows from archive name and offset, so reading again gives
    the same one. Without ``payloads`` the two byte columns are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for record in arc_records(name, _unzipped(content.as_py())):
                    rows.append((name, *record[:6], *(record[6:] if payloads else (None, None))))
                    if len(rows) == 256:
                        yield _table(rows, _ARC_TYPES)
                        rows = []
                yield _table(rows, _ARC_TYPES)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _ARC_ROWS)


_ARC_TYPES = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("row_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("head", pa.binary()), ("payload", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def decide_types(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, record_id, record_type, refers_to, refers_to_row): of equal payloads of at least ``min_bytes`` the record of the largest row id is the response, the others revisit it.

    A payload that a third of all records share is combined before the shuffle,
    and its records are spread over tasks when they learn the winner.
    """
    narrow = records.select("archive", "record_id", "row_id", "payload_digest", "payload_bytes")
    rank = F.struct(F.col("row_id").isNotNull().alias("known"), "row_id", "record_id")
    best = narrow.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(rank).alias("best"))
    joined = hot_join(narrow, best, "payload_digest")
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("best.record_id") != F.col("record_id"))
    return joined.select(
        "archive",
        "record_id",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("best.record_id")).alias("refers_to"),
        F.when(revisit, F.col("best.row_id")).alias("refers_to_row"),
    )


def warc_record(record: tuple, kind: str, refers_to: str | None, refers_to_row: int | None) -> bytes:
    """One record without its end mark; a revisit keeps the HTTP head and leaves the payload out."""
    name, _, url, date, digest, _, head, payload = record
    revisit = kind == "revisit"
    block = head + b"\r\n\r\n" + (b"" if revisit else payload) if head else (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url or ''}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"] if revisit else []),
        *([f"X-Refers-To-Row: {refers_to_row}"] if revisit and refers_to_row is not None else []),
        f"Content-Type: {'application/http;msgtype=response' if head else 'application/octet-stream'}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(spark: SparkSession, arc_path: str, types: DataFrame, path: str) -> None:
    """Rewrite each ARC file with the types of its records. The files meet their types zipped, and one file is in a task at a time."""
    files = spark.read.format("binaryFile").load(arc_path).select(F.col("path").alias("archive"), "content")
    schema = pa.schema([("record", pa.binary())])

    def rewrite(archive: pa.Table, said: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        known = {r["record_id"]: r for r in said.to_pylist()}
        made = []
        for name, content in zip(archive["archive"].to_pylist(), archive["content"], strict=True):
            for record in arc_records(name, _unzipped(content.as_py())):
                r = known[record[0]]
                made.append(warc_record(record, r["record_type"], r["refers_to"], r["refers_to_row"]))
        return pa.table([pa.array(made, pa.binary())], schema=schema)

    records = files.groupBy("archive").cogroup(types.groupBy("archive")).applyInArrow(rewrite, "record binary")
    # the separator of the text writer is the end mark of a record
    records.select(F.col("record").cast("string").alias("value")).write.options(**_WRITE, lineSep="\r\n\r\n").text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, by declared length."""
    at = 0
    while (at := content.find(b"WARC/1.", at)) >= 0:
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["content-length"])
        yield fields, content[stop + 4 : stop + 4 + size]
        at = stop + 4 + size


_WARC_TYPES = pa.schema([("record_id", pa.string()), ("row_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("refers_to_row", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per WARC record; digest and length of a response are those of the payload read, of a revisit those that it states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse_warc(_unzipped(content.as_py())):
                    head, payload = split_http(block)
                    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    response = fields.get("warc-type") == "response"
                    digest = payload_digest(payload) if response else stated
                    size = len(payload) if response else _number(http_field(head, "Content-Length"))
                    rows.append((fields.get("warc-record-id"), _number(http_field(head, ID_HEADER)), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"), digest, size, fields.get("warc-refers-to"), _number(fields.get("x-refers-to-row")), digest == stated, payload if payloads else None))
                    if len(rows) == 256:
                        yield _table(rows, _WARC_TYPES)
                        rows = []
                yield _table(rows, _WARC_TYPES)

    ddl = "record_id string, row_id long, record_type string, url string, date string, payload_digest string, payload_bytes long, refers_to string, refers_to_row long, intact boolean, payload binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ddl)


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """All ARC files below ``arc_path`` to WARC files below ``warc_path``."""
    types = decide_types(read_arc(spark, arc_path, payloads=False), min_bytes)
    write_warc(spark, arc_path, types, warc_path)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 1, min_bytes: int = 0) -> DataFrame:
    """Write the pages as ARC, convert them to WARC and read that back.

    Null pages have an empty payload, null URLs a name made of the row id;
    equal row ids with equal payloads revisit one of their number; an empty
    table gives no archives and no rows; columns not named are left behind.
    """
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col, version)
    convert(spark, arc, warc, min_bytes)
    return read_warc(spark, warc)


def archive_report(read: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The digest columns of ``archive_pages``."""
    return read.select(F.col("row_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_row").alias("refers_to"))
