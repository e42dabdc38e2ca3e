"""Legacy ARC archives to WARC, and back to rows.

The converter reads ARC version 1 and version 2 headers by their field lists, takes each
body by its declared length, and synthesises what WARC wants and ARC lacks: record ids
(name-based UUIDs, so a repeated run gives the same), ISO timestamps, record types and
SHA-256 digests. Payloads equal by digest and of at least MIN_REVISIT bytes are stored
once: the smallest key's record is the response, the others revisit it.

Archives are written by Spark's own committer to the shared folder, a record and the
blank lines that close it to a line separator, gzip a file of at most RECORDS_PER_FILE
records, and read back by declared lengths from a stream: a task holds a file as it is
stored and one record of it. Null payloads are empty, null URLs become `unknown:`; any URL
is a page's, `filedesc://` too. Rows without a key never become the response of a group
that has one; rows that repeat the smallest key are all responses. A truncated or
unreadable header raises, unless `errors="skip"`, which goes on at the next line that is
one. Only the key, url and body columns are read, so other columns may have any name. An
empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
#: Of pages of 64 KB a file holds 128 MB before compression.
RECORDS_PER_FILE = 2000
#: Fixed values of the ARC format: fields of a record's header line, by version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_SCHEMA = "record_id string, warc_type string, uri string, date string, ip string, mime string, head binary, payload binary, payload_bytes long, payload_digest string, key long"
END = "\r\n\r\n"
KEY_FIELD = "X-Record-Key"
NAMESPACE = uuid.UUID("5f0c7d1e-6a52-5d0e-9f4b-0d6c2a3b1e77")


def version_block(version: int, date: str = "20240101000000") -> str:
    body = f"{version} 0 prosemeter\n{FIELDS[version]}\n"
    middle = "text/plain" if version == 1 else "text/plain 200 - - 0 prosemeter.arc"
    return f"filedesc://prosemeter.arc 0.0.0.0 {date} {middle} {len(body)}\n{body}\n"


def to_arc(rows: DataFrame, key: str, url: str, body: str, version: Column, date: str = "20240101000000") -> DataFrame:
    """(archive binary): each row an ARC archive of one HTTP response, of the version asked for."""
    payload = F.coalesce(F.encode(F.col(body), "UTF-8"), F.lit(b""))
    address = F.regexp_replace(F.coalesce(F.col(url), F.lit("unknown:")), r"\s", "%20")
    address = F.when(address == "", "unknown:").otherwise(address)
    keyed = F.coalesce(F.concat(F.lit(f"{KEY_FIELD}: "), F.col(key).cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), keyed, F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    length = (F.octet_length(F.encode(head, "UTF-8")) + F.octet_length(payload)).cast("string")
    lines = {
        1: F.concat_ws(" ", address, F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), length),
        2: F.concat_ws(" ", address, F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("prosemeter.arc"), length),
    }
    front = [F.concat(F.lit(version_block(v, date)), line, F.lit("\n"), head) for v, line in lines.items()]
    whole = F.concat(F.encode(F.when(version == 1, front[0]).otherwise(front[1]), "UTF-8"), payload, F.lit(b"\n"))
    return rows.select(whole.alias("archive"))


def parse_arc(data: bytes, errors: str = "raise") -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by name, body) of each record, the version block first."""
    for fields, body, _ in arc_records(data, errors):
        yield fields, body


def arc_records(data: bytes, errors: str = "raise") -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(header fields by name, body, whether it is a version block) of each record.

    A version block is the first record of an archive; where archives follow each other in
    one file, a later `filedesc:` record whose body has a version line and a field list.
    """
    at, names, first = 0, FIELDS[1].split(), True
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        length = parts[-1]
        whole = end >= 0 and length.isdigit() and end + 1 + int(length) <= len(data)
        body = data[end + 1 : end + 1 + int(length)] if whole else b""
        said = field_list(body) if line.startswith("filedesc://") and whole else None
        block = line.startswith("filedesc://") and (first or said is not None)
        own = FIELDS[2 if len(parts) == len(FIELDS[2].split()) else 1].split() if block else names
        if not whole or len(parts) != len(own):
            if errors != "skip":
                raise ValueError(f"no ARC header at byte {at}: {line[:120]!r}")
            at = end + 1 if end >= 0 else len(data)
            continue
        yield dict(zip(own, parts)), body, block
        if block:  # its second line names the fields of what follows
            names = said or own
        first = False
        at = end + 1 + int(length)


def field_list(body: bytes) -> list[str] | None:
    """The field names in a version block's second line."""
    said = body.decode("utf-8", "replace").split("\n")
    version = said[0].split(" ")[0]
    return said[1].split() if version.isdigit() and len(said) > 1 and said[1].split()[:1] == ["URL"] else None


def iso_date(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with their blank line, payload); no head: all is payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name.lower().encode():
            return v.strip().decode("utf-8", "replace")
    return None


def _record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def convert(archives: DataFrame, errors: str = "raise") -> DataFrame:
    """(archive binary) of ARC bytes -> WARC record fields; version blocks become warcinfo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for data in batch.column("archive").to_pylist():
                for f, body, version_block in arc_records(data or b"", errors):
                    date = iso_date(f["Archive-date"])
                    if version_block:
                        kind, head, payload = "warcinfo", b"", body
                    else:
                        head, payload = http_parts(body)
                        kind = "response" if head else "resource"
                    digest = hashlib.sha256(payload).hexdigest()
                    key = field(head, KEY_FIELD) if head else None
                    rows.append((_record_id(f["URL"], date, digest, key or "", kind), kind, f["URL"], date, f["IP-address"], f["Content-type"], head, payload, len(payload), digest, int(key) if key else None))
                    size += len(payload)
                    if size > 16 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
            if rows:
                yield _batch(rows)

    return archives.mapInArrow(run, RECORD_SCHEMA)


_ARROW = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("mime", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("key", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def mark_revisits(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """Adds refers (struct of the response's key, record_id, uri, date; null unless a revisit).

    Digests are counted with map-side combine and joined back; Spark splits a hot digest.
    """
    part = records.where((F.col("payload_bytes") >= least) & F.col("key").isNotNull() & (F.col("warc_type") == "response"))
    firsts = part.groupBy("payload_digest").agg(F.min(F.struct("key", "record_id", "uri", "date")).alias("first"))
    joined = records.join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("warc_type") == "response") & ~F.col("key").eqNullSafe(F.col("first.key"))
    return joined.withColumn("refers", F.when(again, F.col("first"))).drop("first")


def warc_bytes(r: str = "refers") -> Column:
    """One WARC/1.1 record, without the two blank lines that close it."""
    old = F.col(r).isNotNull()
    block = F.when(old, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    kind = F.when(old, F.lit("revisit")).otherwise(F.col("warc_type"))
    mime = F.when(F.octet_length("head") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.when(F.col("warc_type") != "warcinfo", F.col("uri"))), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        line("WARC-Profile", F.when(old, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.col(f"{r}.record_id")), line("WARC-Refers-To-Target-URI", F.col(f"{r}.uri")), line("WARC-Refers-To-Date", F.col(f"{r}.date")),
        line("X-Refers-To-Key", F.col(f"{r}.key").cast("string")), line("Content-Type", mime), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return F.concat(F.encode(header, "UTF-8"), block)


def write_warc(marked: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    marked.select(warc_bytes().cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by name in lower case, block) of each record of a stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("truncated WARC record")
        stream.read(len(END))
        yield fields, block


def opened(data: bytes) -> BinaryIO:
    """A stream of a file's bytes, unpacked as it is read."""
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, warc_type, uri, date, payload binary, payload_bytes, payload_digest, key, refers_key).

    Of a revisit, bytes are those its HTTP head declares and the payload is null.
    """
    schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("key", pa.int64()), ("refers_key", pa.int64())])

    def whole(x: str | None) -> int | None:
        return None if x is None else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for f, block in parse_warc(opened(content.as_py())):
                    head, payload = http_parts(block)
                    old = f["warc-type"] == "revisit"
                    digest = f.get("warc-payload-digest", "").removeprefix("sha256:")
                    if not old and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                    n = whole(field(head, "Content-Length")) if old else len(payload)
                    rows.append((f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f.get("warc-date"), None if old else payload, n, digest, whole(field(head, KEY_FIELD)), whole(f.get("x-refers-to-key"))))
                    size += len(block)
                    if size > 16 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, warc_type string, uri string, date string, payload binary, payload_bytes long, payload_digest string, key long, refers_key long")


def read_arc(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    """WARC record fields of the ARC files below a path (gzip or plain)."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data], pa.binary())], names=["archive"])

    return convert(spark.read.format("binaryFile").load(path).select("content").mapInArrow(plain, "archive binary"), errors)
