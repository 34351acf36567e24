"""A content-addressed web archive: headers apart, each payload stored once.

``store`` writes three tables into one folder. ``payloads`` holds each distinct
payload once, under its SHA-256; the pages that own a payload are found on
narrow rows (digest and id), so only owners' payloads are written. ``heads``
holds the exact header block of every record: a ``response`` for the owner,
the page with the largest id, and a ``revisit`` that refers to it for every
other page with the same payload.

``records`` reads both back, verifies every payload against its digest and
length, and joins the complete WARC records together again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawspark.session import scratch_dir

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def _uri(url: str | None) -> str:
    """A url as a header value: line ends and other controls percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def header_block(page_id, url, owner, sha1: bytes, length: int) -> bytes:
    """The record header of one page, up to and with the empty line."""
    response = owner == page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(owner)}", f"X-Refers-To-Page: {owner}"]
    lines += [f"X-Page: {'' if page_id is None else page_id}", f"Content-Length: {length if response else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_header(block: bytes) -> dict[str, str]:
    version, *lines = block.decode().split("\r\n")
    if not version.startswith("WARC/") or not block.endswith(b"\r\n\r\n"):
        raise ValueError("not a WARC header")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines if x)


def store(pages: DataFrame, path: str | None = None) -> str:
    """Archive ``pages(page_id, url, html)``; the folder written to.

    A null html is the empty payload; a null id is smaller than any other. If
    several rows have the largest id, all of them are responses and the
    payload is still stored once.
    """
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "archive")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    facts = pages.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.length("payload").alias("size"))
    facts.write.parquet(f"{path}/facts")
    facts = spark.read.parquet(f"{path}/facts")
    owners = facts.groupBy("digest").agg(F.max("page_id").alias("owner"))
    owners.write.parquet(f"{path}/owners")
    owners = spark.read.parquet(f"{path}/owners")

    heads = facts.join(owners, "digest").mapInArrow(_heads, "page_id long, digest string, head binary")
    heads.write.parquet(f"{path}/heads")
    # One copy per digest: the owner's. Only a repeated owner row can leave two.
    owner = owners.select(F.col("digest").alias("d"), "owner")
    is_owner = (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("owner"))
    once = pages.select("page_id", "digest", "payload").join(owner, is_owner).select("digest", "payload")
    repeated = facts.join(owner, is_owner).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        once = once.groupBy("digest").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("page_id", "url", "owner", "sha1", "size"))
        head = [header_block(p, u, o, bytes.fromhex(s), n) for p, u, o, s, n in zip(*columns, strict=True)]
        yield pa.record_batch(
            [b.column("page_id"), b.column("digest"), pa.array(head, pa.binary())], names=["page_id", "digest", "head"]
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sha1, size = [], []
        for digest, payload in zip(b.column("digest").to_pylist(), b.column("payload"), strict=True):
            raw = payload.as_buffer()
            if hashlib.sha256(raw).hexdigest() != digest:
                raise ValueError(f"payload {digest} does not have its digest")
            sha1.append(base64.b32encode(hashlib.sha1(raw).digest()).decode())
            size.append(len(raw))
        yield pa.record_batch(
            [b.column("digest"), pa.array(size, pa.int64()), pa.array(sha1)],
            names=["digest", "payload_bytes", "payload_digest"],
        )


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        heads = [parse_header(h) for h in b.column("head").to_pylist()]
        number = lambda x: int(x) if x not in (None, "", "None") else None
        yield pa.record_batch(
            [
                pa.array([number(h["X-Page"]) for h in heads], pa.int64()),
                b.column("digest"),
                pa.array([h["WARC-Type"] for h in heads]),
                pa.array([number(h.get("X-Refers-To-Page")) for h in heads], pa.int64()),
                pa.array([h["WARC-Payload-Digest"].removeprefix("sha1:") for h in heads]),
                pa.array([number(h["Content-Length"]) for h in heads], pa.int64()),
            ],
            names=["page_id", "digest", "record_type", "refers_to", "stated_digest", "stated_length"],
        )


def index(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, stated_digest`` as read back.

    Length and digest are those of the stored payload, computed anew and
    verified; type and reference stand in the stored header. A header whose
    stated digest or length is not that of its payload is an error.
    """
    payloads = spark.read.parquet(f"{path}/payloads").mapInArrow(
        _verify, "digest string, payload_bytes long, payload_digest string"
    )
    heads = spark.read.parquet(f"{path}/heads").select("digest", "head").mapInArrow(
        _parsed, "page_id long, digest string, record_type string, refers_to long, stated_digest string, stated_length long"
    )
    # The digest that a header states must be that of the payload, and its length that of the record's block.
    size = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    fits = (F.col("stated_digest") == F.col("payload_digest")) & (F.col("stated_length") == size)
    lost = F.raise_error(F.concat(F.lit("header and payload differ: "), "digest")).cast("string")
    rows = heads.join(payloads, "digest").withColumn("record_type", F.when(fits, F.col("record_type")).otherwise(lost))
    return rows.drop("digest", "stated_length")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record``: each record's exact bytes (header, payload, two line ends)."""
    heads = spark.read.parquet(f"{path}/heads")
    payloads = spark.read.parquet(f"{path}/payloads")
    end = F.lit(b"\r\n\r\n")
    # By the type's own line, which comes second: a url may hold any text.
    response = F.col("head").cast("string").startswith("WARC/1.1\r\nWARC-Type: response\r\n")
    full = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    return heads.join(payloads, "digest").select("page_id", F.concat("head", full, end).alias("record"))
