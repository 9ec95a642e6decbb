"""A content-addressed WARC archive (operator 5).

Two tables: ``payloads`` holds the bytes of each different payload once, compressed and addressed by SHA-256 (equal
digests are verified by comparing complete bytes, see :mod:`.grace`); ``records`` holds the exact header bytes of each
record. Original records are reconstructed by joining them on the number of the stored payload, and what is read back
is parsed from these records.
"""

from __future__ import annotations

import atexit
import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grace import decided, folded
from .shared import arrow, batch_of, numbered, remove, shared_dir, stored, table

DIGESTS = "stored long, payload_digest string"
RECORDS = "rid long, stored long, page_id long, url string, record_type string, refers_to long, said string, payload_digest string, payload_bytes long"
_DATE = "1970-01-01T00:00:00Z"


class Archive(NamedTuple):
    payloads: str
    records: str


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: Column) -> Column:
    """``<urn:uuid:...>`` made of the page's id."""
    h = F.md5(F.concat(F.lit("page "), page_id.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def pack(payload: bytes) -> bytes:
    return pa.compress(payload, codec="zstd", asbytes=True) if payload else b""


def unpack(packed: bytes | None, size: int) -> bytes:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if packed else b""


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stored payloads (number, SHA-256, packed bytes, size) the digests that headers name."""
    schema = arrow(DIGESTS)
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            sizes = part.column(3).to_pylist()
            payloads = [unpack(p, n) for p, n in zip(part.column(2).to_pylist(), sizes)]
            for p, d in zip(payloads, part.column(1).to_pylist()):
                if hashlib.sha256(p).digest() != d:
                    raise ValueError("a stored payload doesn't have the digest that addresses it")
            yield batch_of(schema, part.column(0), [base32_sha1(p) for p in payloads])


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, fold_bytes: int = 24 << 20, table_bytes: int = 64 << 20) -> Archive:
    """One WARC record for each row of ``pages``, as the tables ``path/payloads`` and ``path/records``.

    Null payloads count as empty, extra columns are ignored, and an empty table gives an empty archive. Of records with equal payloads of at least ``min_bytes``, that with the largest id
    (null ids last) is a response and the others are revisits of it; all smaller ones are responses. A null url has
    no WARC-Target-URI line; line ends in a url become %0D and %0A. A null id makes a record without Page-Id.
    """
    pages = numbered(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("content")))
    keep = pages.select(F.monotonically_increasing_id().alias("rid"), "id", "url", "content")
    local = folded(keep.select("rid", "id", "content"), lower=False, fold_bytes=fold_bytes)
    at = Archive(f"{path}/payloads", f"{path}/records")
    # The store's rows: one for each record that a task passed on; `payload` only on that which stays.
    decided(local, table_bytes=table_bytes, payload=pack).write.parquet(at.payloads)
    payloads = pages.sparkSession.read.parquet(at.payloads)
    digests = payloads.filter("rid = keep_rid").select("rid", "digest", "payload", "n_bytes").mapInArrow(_digests, DIGESTS)
    # Joined with the store's rows, one for each record that a task passed on, before these meet all rows: no key of the
    # second join has more rows than a task folded into one.
    groups = payloads.select(F.col("rid").alias("rep"), F.col("keep_rid").alias("stored"), "keep_id").join(digests, "stored")
    rows = local.select("rid", "id", "rep", "n_bytes").join(groups, "rep").join(keep.select("rid", "url"), "rid")
    revisit = (F.col("rid") != F.col("stored")) & (F.col("n_bytes") >= min_bytes)
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    only = lambda column: F.when(revisit, column)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(record_id(F.col("id")), record_id(F.concat(F.lit("row "), F.col("rid").cast("string"))))),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", only(record_id(F.col("keep_id")))),
        line("Refers-To-Page-Id", only(F.col("keep_id").cast("string"))),
        line("Page-Id", F.col("id").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    rows.select("rid", header.cast("binary").alias("header"), "stored", revisit.alias("revisit")).write.parquet(at.records)
    return at


def reconstruct(spark: SparkSession, at: Archive) -> DataFrame:
    """``rid, stored, record``: each complete original record (header, payload of a response, two line ends).

    A revisit has an empty block. Null payloads were stored as empty ones. An empty archive gives no records.
    """
    payloads = spark.read.parquet(at.payloads).filter("rid = keep_rid").select(F.col("rid").alias("stored"), "payload", "n_bytes")
    records = spark.read.parquet(at.records)
    # Revisits need no payload, so a payload that many records share isn't sent to each of them.
    whole = records.filter("not revisit").join(payloads, "stored").select("rid", "stored", "header", "payload", "n_bytes")
    both = whole.unionByName(records.filter("revisit").select("rid", "stored", "header", F.lit(None).cast("binary").alias("payload"), F.lit(0).cast("long").alias("n_bytes")))
    return both.mapInArrow(_records, "rid long, stored long, record binary")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            headers, packed, sizes = (part.column(c).to_pylist() for c in (2, 3, 4))
            yield batch_of(arrow("rid long, stored long, record binary"), part.column(0), part.column(1), [h + unpack(p, n) + b"\r\n\r\n" for h, p, n in zip(headers, packed, sizes)])


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and block; an error if its length isn't what it says."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record isn't as long as its header says")
    return fields, rest[:size]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: None if x is None else int(x)
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            out = []
            for record in part.column(2).to_pylist():
                f, block = parse(record)
                said, response = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"] == "response"
                if response and base32_sha1(block) != said:
                    raise ValueError("a header's payload digest isn't that of the record's block")
                own = (said, len(block)) if response else (None, None)
                out.append((number(f.get("Page-Id")), f.get("WARC-Target-URI"), f["WARC-Type"], number(f.get("Refers-To-Page-Id")), said, *own))
            yield batch_of(arrow(RECORDS), part.column(0), part.column(1), *(list(c) for c in zip(*out)))


def read_records(spark: SparkSession, at: Archive) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` for each record, parsed from its reconstructed bytes.

    A response's digest and size are those of its block; a revisit's are those of the response that holds its payload, and
    must be the digest that its own header names. A record without Page-Id has a null id, one without a url a null url.
    """
    # Read several times: what was parsed, without the payloads, is written once.
    records = stored(reconstruct(spark, at).mapInArrow(_parsed, RECORDS))
    told = records.filter("record_type = 'response'").groupBy("stored").agg(F.first("payload_digest").alias("payload_digest"), F.first("payload_bytes").alias("payload_bytes"))
    visits = records.filter("record_type = 'revisit'").drop("payload_digest", "payload_bytes").withColumn("part", F.shiftright("rid", 16))
    # Revisits that share a payload may be a third of all rows: each run of row numbers fetches its answers once.
    answers = visits.select("stored", "part").distinct().join(told, "stored")
    visits = visits.join(answers, ["stored", "part"]).drop("part")
    same = F.when(F.col("said") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit's payload digest isn't that of its response")))
    both = records.filter("record_type = 'response'").unionByName(visits.select(*records.columns))
    return both.select("page_id", "url", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")


def export_files(spark: SparkSession, at: Archive, write: Callable[[int, Iterator[bytes]], None]) -> None:
    """Hands each task's records to ``write(task number, records)``, which stores one .warc file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        write(TaskContext.get().partitionId(), (r for b in batches for r in b.column(0).to_pylist()))
        yield from ()

    reconstruct(spark, at).select("record").mapInArrow(run, "done boolean").count()


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    at = write_archive(table(spark, sf_dir, "pages"), path)
    return read_records(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, t, strlen(t) AS n, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS top FROM p),
parts AS (SELECT *, [('0x' || x[5 * k + 1 : 5 * k + 5])::BIGINT for k in range(8)] AS w FROM h)
SELECT page_id, n AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((w[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::INT, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM parts
"""
