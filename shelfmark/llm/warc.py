"""Content-addressed web archive.

Two Parquet tables. ``payloads`` holds each distinct payload once under its SHA-256,
compressed; ``headers`` holds for every record the exact header block with the
address of its payload. A record is rebuilt by joining both and equals the written
bytes. The address is verified twice: rows that share it must agree on length and
SHA-1 when written, and each payload read is hashed again.

The record with the smallest id of equal payloads is ``response``; the others are
``revisit`` records that name it. Payloads are compressed before they move, and only
addresses take part in finding the first record, so a payload that a third of the
pages share costs one row per task in that step. Joins by address take written tables, so
that adaptive execution can split the pages of a common payload.

Defined results: a null payload is empty and an empty payload is archived like any
other; a null URL gives an empty target; rows that repeat an id keep one record each,
of which those with equal payloads all are the response; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
_DIGESTED = "page_id long, url string, address binary, length long, sha1 string, packed binary"
_SMALL = "page_id long, url string, address binary, length long, sha1 string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few pages at a time: a task holds their bodies more than once."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in _small(batches):
        body = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()]
        yield pa.record_batch(
            [
                batch.column(0),
                batch.column(1),
                pa.array([hashlib.sha256(x).digest() for x in body], pa.binary()),
                pa.array([len(x) for x in body], pa.int64()),
                pa.array([sha1_base32(x) for x in body], pa.string()),
                pa.array([squeeze.compress(x) for x in body], pa.binary()),
            ],
            names=["page_id", "url", "address", "length", "sha1", "packed"],
        )


def _header(kind: str, page_id, url: str | None, sha1: str, length: int, first, page_text: str) -> bytes:
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <urn:page:" + page_text.encode() + b">",
        b"WARC-Date: " + DATE.encode(),
        # a line break in an address would end the header early
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass"),
        b"WARC-Payload-Digest: sha1:" + sha1.encode(),
    ]
    if kind == "revisit":
        lines += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: <urn:page:" + str(first).encode() + b">",
        ]
    lines += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: " + str(length).encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, url, address, length, sha1, first = (c.to_pylist() for c in batch.columns)
        made = [
            _header("response" if p == f else "revisit", p, u, s, n, f, "none" if p is None else str(p))
            for p, u, n, s, f in zip(page, url, length, sha1, first)
        ]
        yield pa.record_batch([pa.array(made, pa.binary()), batch.column(2)], names=["header", "address"])


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write ``{path}/payloads`` and ``{path}/headers``."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{body_col}`").cast("string").alias("html"),
    )
    # every payload goes to the store that its own task sees first; copies over tasks merge by address
    digested = rows.mapInArrow(_digest, _DIGESTED)
    packed = digested.groupBy("address").agg(
        F.first("packed").alias("packed"),
        F.min("length").alias("length"),
        F.min("sha1").alias("sha1"),
        F.min("page_id").alias("first"),
        (F.assert_true((F.min("length") == F.max("length")) & (F.min("sha1") == F.max("sha1")), F.lit("address clash"))).alias("_ok"),
    )
    packed.filter("_ok is null").drop("_ok").write.option("compression", "uncompressed").parquet(f"{path}/payloads")
    small = rows.mapInArrow(_digest_small, _SMALL)
    firsts = spark.read.schema("address binary, first long").parquet(f"{path}/payloads")
    headers = small.join(firsts.hint("merge"), "address").select("page_id", "url", "address", "length", "sha1", "first")
    headers.mapInArrow(_headers, "header binary, address binary").write.option("compression", "zstd").parquet(f"{path}/headers")


def _digest_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        body = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()]
        yield pa.record_batch(
            [
                batch.column(0),
                batch.column(1),
                pa.array([hashlib.sha256(x).digest() for x in body], pa.binary()),
                pa.array([len(x) for x in body], pa.int64()),
                pa.array([sha1_base32(x) for x in body], pa.string()),
            ],
            names=["page_id", "url", "address", "length", "sha1"],
        )


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in _small(batches):
        headers, address, packed = (batch.column(k).to_pylist() for k in range(3))
        body = [expand.decompress(x) for x in packed]
        for a, b in zip(address, body):
            if hashlib.sha256(b).digest() != a:
                raise ValueError(f"payload {a.hex()} does not match its address")
        yield pa.record_batch([pa.array(headers, pa.binary()), pa.array(body, pa.binary())], names=["header", "payload"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records as written: ``header`` and ``payload`` bytes, each payload verified."""
    headers = spark.read.schema("header binary, address binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("address binary, packed binary").parquet(f"{path}/payloads")
    return headers.join(payloads, "address").select("header", "address", "packed").mapInArrow(_open, "header binary, payload binary")


def record_bytes(record: DataFrame) -> DataFrame:
    """Whole records in the archive's byte form. A revisit record carries its payload here, as stored."""
    return record.select(F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, size, digest, kind, refers, url = [], [], [], [], [], []
        for head, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if line)
            if int(fields["Content-Length"]) != len(body) or fields["WARC-Payload-Digest"] != "sha1:" + sha1_base32(body):
                raise ValueError(f"record {fields['WARC-Record-ID']} does not match its payload")
            number = fields["WARC-Record-ID"][len("<urn:page:") : -1]
            page.append(None if number == "none" else int(number))
            size.append(len(body))
            digest.append(fields["WARC-Payload-Digest"][5:])
            kind.append(fields["WARC-Type"])
            first = fields.get("WARC-Refers-To", "<urn:page:None>")[len("<urn:page:") : -1]
            refers.append(None if first == "None" else int(first))
            url.append(fields["WARC-Target-URI"])
        yield pa.record_batch(
            [
                pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()),
                pa.array(kind, pa.string()), pa.array(refers, pa.int64()), pa.array(url, pa.string()),
            ],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"],
        )


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of each record, checked against its payload."""
    return records.mapInArrow(
        _parse,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string",
    )
