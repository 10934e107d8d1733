"""WARC writing, reading and transaction assembly.

``write_archives`` turns each page row into a transaction of three records (request,
response or revisit, metadata) that name each other by WARC-Concurrent-To, and
writes them as archive files with Spark's own writer, so commits survive lost
executors and the target may be any store that Spark reaches. A file is bounded by
bytes. ``read_archives`` parses the files again by Content-Length (a payload may itself look
like a WARC record). ``assemble`` brings requests and metadata to their response by the
concurrent-to identifiers in one grouping, resolves revisits, and gives one nested row for
each capture.

A payload of at least ``min_revisit_bytes`` that several rows share is stored
once, under the largest (page_id, url); the others are revisit records.

Defined results: null html is an empty payload; null or odd URLs are written
with control characters percent-encoded; rows that share a page_id, or are repeated whole,
are captures of their own, of which one is the response; a null page_id ranks behind every
other; empty tables write no record; other columns are not read. A file is one gzip member, as
Spark's writer makes it; the reader takes any number of members.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.functions.ship import ship
from sentinela.llm.common import documents, shared_dir, written

CRLF = "\r\n"
_HEAD_END = b"\r\n\r\n"


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.lit(">"),
    )


def _record(head: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")] + [F.concat(F.lit(k + ": "), v) for k, v in head]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 1 << 27) -> None:
    """One request, response or revisit, and metadata record for each page row; files of about
    ``file_bytes`` before compression at most, or of one record that is larger."""
    payload = F.coalesce("html", F.lit(""))
    p = pages.select(
        F.col("page_id"),
        F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("")).alias("url"),
        payload.alias("html"),
        F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).alias("size"),
        F.lit(0).cast("long").alias("copy"),
    )
    same = written(p.groupBy("digest", "page_id", "url", "size").agg(F.count(F.lit(1)).alias("n")), "page-keys")
    if not same.where("n > 1").isEmpty():  # rows repeated whole need a number of their own, stored so that every reading agrees
        p = written(p.withColumn("copy", F.monotonically_increasing_id()), "pages")
        same = p.select("digest", "page_id", "url", "size", "copy", F.lit(1).alias("n"))
    elif "copy" not in same.columns:
        same = same.withColumn("copy", F.lit(0).cast("long"))
    sizes = same.groupBy(F.floor(F.log2(F.col("size") + F.lit(1024)) / 3).alias("step")).agg(F.min("size").alias("low"), F.max("size").alias("high")).collect()  # at most 11 steps
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    named = lambda kind, page, url, copy: _urn(F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), url, F.col("digest"), copy.cast("string"))
    rid = lambda kind: named(kind, F.col("page_id"), F.col("url"), F.col("copy"))
    first = (
        same.where(F.col("size") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "url", "copy")).alias("top"), F.sum("n").alias("n"))
        .where("n > 1")
        .select("digest", F.col("top.page_id").alias("o_page_id"), F.col("top.url").alias("o_url"), F.col("top.copy").alias("o_copy"))
    )
    # Only payloads that repeat have a row in ``first``; texts stay on their side of the join.
    keyed = p.join(first, "digest", "left")
    original = named("response", F.col("o_page_id"), F.col("o_url"), F.col("o_copy"))
    itself = F.col("o_page_id").eqNullSafe(F.col("page_id")) & (F.col("o_url") == F.col("url")) & (F.col("o_copy") == F.col("copy"))
    again = (F.col("size") >= min_revisit_bytes) & F.col("o_url").isNotNull() & ~itself
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit(CRLF * 2),
    )
    k = keyed.withColumn("again", again).withColumn("rid", rid("response"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", rid("request")), ("WARC-Concurrent-To", F.col("rid")), *common, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + CRLF * 2)),
    )
    response = _record(
        [("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("rid")), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(http, "html"),
    )
    revisit = _record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", F.col("rid")), *common, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", original), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("Content-Type", F.lit("application/http;msgtype=response"))],
        http,
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", rid("metadata")), ("WARC-Concurrent-To", F.col("rid")), *common, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), pid, F.lit(CRLF)),
    )
    # The writer ends each row with \n, which completes the last \r\n\r\n.
    end = F.lit(CRLF * 2)
    value = F.concat(request, end, F.when(F.col("again"), revisit).otherwise(response), end, metadata, F.lit("\r\n\r"))
    k = k.select("size", value.alias("value"))
    for r in sizes:
        # Rows of like size, so that a count of rows bounds the bytes of a file.
        rows = max(1, file_bytes // (r["high"] + 2048))
        own = k.where(F.col("size").between(r["low"], r["high"])).select("value")
        own.write.mode("append").option("maxRecordsPerFile", rows).option("compression", "gzip").text(path)
    if not sizes:
        k.select("value").write.option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers with lower-case names, block) of each record of one file."""
    view, pos = memoryview(data), 0
    while pos < len(data):
        end = data.find(_HEAD_END, pos)
        if end < 0 or data[pos : pos + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {pos}")
        head = {}
        for line in data[pos:end].decode().split("\r\n")[1:]:
            k, _, v = line.partition(":")
            head[k.lower()] = v.strip(" ")
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != _HEAD_END:
            raise ValueError(f"record at byte {pos} is cut or has a wrong length")
        yield head, view[start:stop]
        pos = stop + 4


_READ = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("concurrent_to", pa.string()),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("header_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("fields", pa.string()),
        ("payload", pa.binary()),
    ]
)
_READ_DDL = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, header_digest string, payload_bytes bigint, payload_digest string, fields string, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, rows_per_batch: int = 512) -> DataFrame:
    """One row for each record; files that are plain or gzip, with one or many members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                data = cell.as_py()
                if data[:2] == b"\x1f\x8b":
                    parts, rest = [], data
                    while rest:
                        z = zlib.decompressobj(31)
                        parts.append(z.decompress(rest))
                        rest = z.unused_data
                    data = b"".join(parts)
                rows = []
                for head, block in parse_records(data):
                    kind, raw = head["warc-type"], bytes(block)
                    payload = raw.partition(_HEAD_END)[2] if kind == "response" else None
                    rows.append(
                        (
                            head["warc-record-id"],
                            kind,
                            head.get("warc-concurrent-to"),
                            head.get("warc-refers-to"),
                            head.get("warc-target-uri"),
                            head.get("warc-date"),
                            head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            None if payload is None else len(payload),
                            None if payload is None else hashlib.sha1(payload).hexdigest(),
                            raw.decode() if kind == "metadata" else None,
                            payload if with_payload else None,
                        )
                    )
                    if len(rows) >= rows_per_batch:
                        yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in rows], _READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in rows], _READ)

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _READ_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: page_id, request, response, metadata, and
    the payload's size and digest, which a revisit takes from the record it refers to."""
    # A response stands for itself, the others for the record they are concurrent to; no key is null.
    main = F.col("record_type").isin("response", "revisit")
    page = F.nullif(F.regexp_extract("fields", r"(?m)^page-id: (-?\w+)", 1), F.lit("null")).cast("long")
    part = lambda name, when, *cols: F.max(F.when(when, F.struct(*cols))).alias(name)
    whole = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture")).agg(
        part("request", F.col("record_type") == "request", "record_id", "target_uri", "date"),
        part("response", main, "record_id", "target_uri", "date", "payload"),
        part("metadata", F.col("record_type") == "metadata", "record_id", "fields"),
        part("facts", main, "record_type", "refers_to", "header_digest", "payload_bytes", "payload_digest"),
        F.max(page).alias("page_id"),
    )
    captures = written(whole.select("capture", "page_id", "facts.*", "request", "response", "metadata").where("record_type IS NOT NULL"), "captures")
    cols = ["page_id", "record_type", "payload_bytes", "payload_digest", "header_digest", "o_page_id", "request", "response", "metadata"]
    own = captures.where("record_type = 'response'").withColumn("o_page_id", F.lit(None).cast("long"))
    original = own.select(F.col("capture").alias("refers_to"), F.col("page_id").alias("o_page_id"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest"))
    again = captures.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(original, "refers_to", "left")
    again = again.withColumnsRenamed({"o_bytes": "payload_bytes", "o_digest": "payload_digest"})
    return own.select(cols).union(again.select(cols)).withColumnRenamed("o_page_id", "refers_to")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/sentinela/warc-{uuid.uuid4().hex}"
    write_archives(documents(spark, sf_dir, "pages"), path)
    rows = assemble(read_archives(spark, path, with_payload=False))
    whole = F.col("header_digest") == F.col("payload_digest")
    return rows.select(
        "page_id",
        "payload_bytes",
        F.when(whole, F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload differs from its digest")).cast("string")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM k
"""
