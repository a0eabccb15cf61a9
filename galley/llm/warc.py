"""WARC archives in which equal payloads are stored once.

Headers (id, digest, length) are shuffled by payload digest; payloads stay where
they are read as long as the digests that repeat are few enough to broadcast
(``BROADCAST_ORIGINALS``), and move once with the join of these beyond that.
Of the records with one digest the one with the largest id stays a
``response``; the others become ``revisit`` records that refer to it. All
headers are written afresh. A record is one row of Spark's text sink with the
blank lines between records as line separator, so the archives get Spark's
commit protocol, any file system Spark knows, and gzip.

Defined results: a null payload is empty; a null URL leaves the target header
out; control characters of a URL are percent-encoded; payloads under
``MIN_BYTES`` are never replaced; a null id never becomes the original unless
all ids of the group are null, and then all its records are responses; rows
that repeat an id and a payload are alike, so each is a response if that id is
the largest; an empty table gives no record. Columns other than id, URL and
payload are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators.scale import fits
from galley.sources.files import scratch

#: Shorter payloads are kept: a revisit header would be as long.
MIN_BYTES = 1000
#: Originals up to which their table (about 100 bytes a row) is broadcast.
BROADCAST_ORIGINALS = 100_000
#: Bounds the size of one archive file.
RECORDS_PER_FILE = 4000
RECORDS_PER_BATCH = 256
CRLF = "\r\n"
#: The revisit profile the standard names, and the record id form used here.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_START = "<urn:x-page:"


def record_headers(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(record, url, payload, bytes, digest) of every row."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("bigint").alias("record"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )


def resolve_revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``records`` with ``original``: the record it revisits, or null for a response.

    Only digests that occur twice or more are joined back. Their table is
    broadcast when it is proven small; otherwise Spark's skew handling splits
    the records of a digest that is very common.
    """
    originals = (
        records.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("record").alias("original"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    if fits(originals, BROADCAST_ORIGINALS):
        originals = F.broadcast(originals)
    joined = records.join(originals, "digest", "left")
    is_copy = ~F.col("original").eqNullSafe(F.col("record"))
    return joined.withColumn("original", F.when(is_copy, F.col("original")))


def _record_id(record: Column) -> Column:
    return F.concat(F.lit(ID_START), F.coalesce(record.cast("string"), F.lit("")), F.lit(">"))


def _escaped(url: Column) -> Column:
    for code in [*range(0x20), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write records (with ``original``) as gzip-compressed WARC 1.1 files under ``path``."""
    revisit = F.col("original").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes"),
        F.lit(CRLF * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        named("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        named("WARC-Record-ID", _record_id(F.col("record"))),
        named("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        named("WARC-Target-URI", _escaped(F.col("url"))),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, named("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, named("WARC-Refers-To", _record_id(F.col("original")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        named("Content-Length", length.cast("string")),
    )
    rows = records.select(F.concat(head, F.lit(CRLF * 2), block).alias("value"))
    (
        rows.write.option("lineSep", CRLF * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of one gzip file."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:60]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("the archive ends inside a record")
        yield head, block


READ_SCHEMA = (
    "record bigint, record_type string, url string, refers_to bigint, bytes bigint, digest string, payload binary"
)


def _number(record_id: str | None) -> int | None:
    digits = (record_id or "").removeprefix(ID_START).removesuffix(">")
    return int(digits) if digits else None


def _read_record(head: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        length = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
        payload = None
    else:
        length = len(payload)
        if hashlib.sha1(payload).hexdigest() != stated:
            raise ValueError(f"payload of {head['warc-record-id']} does not have its stated digest")
    return (
        _number(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"),
        _number(head.get("warc-refers-to")), length, stated, payload if keep_payload else None,
    )


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of all archives; digests of responses are checked against their payloads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for files in batches:
            for content in files.column(0):
                for head, block in parse_archive(content.as_py()):
                    rows.append(_read_record(head, block, keep_payload))
                    if len(rows) >= RECORDS_PER_BATCH:
                        yield batch()
                        rows.clear()
        yield batch()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, READ_SCHEMA)


def restore_payloads(records: DataFrame) -> DataFrame:
    """Read records in which every revisit has the payload of the response it refers to."""
    responses = records.where("record_type = 'response'").select(
        F.col("record").alias("refers_to"), F.col("payload").alias("_original")
    )
    # rows that repeat an id with one payload are alike
    responses = responses.where("refers_to is not null").groupBy("refers_to").agg(F.first("_original").alias("_original"))
    joined = records.join(responses, "refers_to", "left")
    return joined.withColumn(
        "payload", F.when(F.col("record_type") == "revisit", F.col("_original")).otherwise(F.col("payload"))
    ).drop("_original")


def deduplicated_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> None:
    write_archives(resolve_revisits(record_headers(pages, id_col, url_col, payload_col)), path)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    deduplicated_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, keep_payload=False).select(
        F.col("record").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS original FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> original THEN original END AS refers_to
FROM m
"""
