"""WARC transactions: write captures as request, response or revisit, and metadata records, and join them again.

Archives are written by the text sink, record by record with the blank lines that end a WARC record as separator, so
task retries and lost executors are Spark's to handle. They are gzipped and therefore read as one stream per file, cut
at the version line; a record that contains the version line itself is put together again by its Content-Length.
Records meet through WARC-Concurrent-To, and each capture becomes one nested row.

Defined results: a null html is an empty payload; pages with equal payloads share one response, that of the largest
(page_id, url); a row repeated in full is written as often as it comes and counted in ``copies``; a null id or url stays
null; an empty table gives an empty archive and no captures; other columns of the table are not read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitwarden.llm.common import by_batch, stage

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
BASE32_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, 40 bits at a time."""
    hexed = F.sha1(payload)
    part = [F.translate(F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0"), BASE32_DIGITS, BASE32) for i in (1, 11, 21, 31)]
    return F.concat(*part)


def _one_line(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(kind: str | Column, record_id: Column, concurrent: Column | None, uri: Column, content_type: str, block: Column, *more: Column) -> Column:
    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit(VERSION), header("WARC-Type", kind), header("WARC-Record-ID", record_id), header("WARC-Date", F.lit(DATE)), header("WARC-Target-URI", uri),
        *([header("WARC-Concurrent-To", concurrent)] if concurrent is not None else []), *more,
        F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def shared_payloads(pages: DataFrame) -> DataFrame:
    """(digest, top): the row that holds the response of every payload that several rows share."""
    small = pages.select(base32_sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.struct("page_id", "url").alias("top"))
    return small.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top")).filter("n > 1").drop("n")


def write_archive(pages: DataFrame, path: str) -> None:
    """Three records per row of ``pages`` (page_id, url, html) into gzipped WARC files below ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # Stored first: its size then decides how it is joined, and the pages need no shuffle where it is small.
    shared = stage(shared_payloads(rows), "payloads")
    given = rows.withColumn("payload", F.coalesce("html", F.lit(""))).withColumn("digest", base32_sha1(F.col("payload"))).join(shared, "digest", "left")
    is_response = F.col("top").isNull() | F.col("top").eqNullSafe(F.struct("page_id", "url"))

    def record_id(kind: str, page_id: Column, url: Column) -> Column:
        name = F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), F.col("digest"))
        return F.concat(F.lit("<urn:md5:"), F.md5(name), F.lit(">"))

    own = record_id("capture", F.col("page_id"), F.col("url"))
    uri = _one_line(F.col("url"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"))
    request = _record("request", record_id("request", F.col("page_id"), F.col("url")), own, uri, "application/http;msgtype=request", F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    response = _record("response", own, None, uri, "application/http;msgtype=response", F.concat(F.lit(HTTP_OK), F.col("payload")), digest)
    refers = F.concat(F.lit("WARC-Refers-To: "), record_id("capture", F.col("top.page_id"), F.col("top.url")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))
    revisit = _record("revisit", own, None, uri, "application/http;msgtype=response", F.lit(HTTP_OK), digest, refers)
    fields = F.concat(
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("payload-length: "), F.octet_length("payload").cast("string"), F.lit("\r\n"),
        F.when(is_response, "").otherwise(F.coalesce(F.concat(F.lit("refers-to-page: "), F.col("top.page_id").cast("string"), F.lit("\r\n")), F.lit(""))),
    )
    metadata = _record("metadata", record_id("metadata", F.col("page_id"), F.col("url")), own, uri, "application/warc-fields", fields)
    records = given.select(F.explode(F.array(request, F.when(is_response, response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


RECORD = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, digest string, http string, payload binary, payload_bytes long, payload_digest string, fields map<string,string>"
NAMES = [f.split(" ", 1)[0] for f in RECORD.split(", ")]


def parse_record(raw: bytes) -> tuple | None:
    """One record without its version line; None while it is shorter than its Content-Length says."""
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        return None
    head = {}
    for line in raw[:cut].decode().split("\r\n"):
        name, _, value = line.partition(":")
        head[name.strip().lower()] = value.strip()
    size = int(head.get("content-length", 0))
    block = raw[cut + 4 : cut + 4 + size]
    if len(block) < size:
        return None
    kind = head.get("warc-type", "")
    payload, http, fields, count, digest = None, None, None, None, None
    if kind in ("response", "revisit", "request"):
        text, _, body = block.partition(b"\r\n\r\n")
        http = text.decode(errors="replace")
        if kind == "response":
            payload, count = body, len(body)
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    else:
        fields = dict(line.split(": ", 1) for line in block.decode(errors="replace").split("\r\n") if ": " in line)
    return (
        kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
        head.get("warc-payload-digest", "").removeprefix("sha1:") or None, http, payload, count, digest, fields,
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record below ``path``. Gzipped files are one stream each, so cut records can be joined again."""
    pieces = spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def run(batches):
        file, held = None, b""
        for batch in batches:
            out = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    if held:
                        raise ValueError(f"a record of {file} is cut short")
                    file = name
                raw = held + VERSION.encode() + value if held else value
                if not raw.strip():
                    continue
                record = parse_record(raw)
                held = raw if record is None else b""
                if record is not None:
                    out.append(record)
            if out:
                yield dict(zip(NAMES, zip(*out, strict=True), strict=True)) | {"fields": pa.array([list(r[-1].items()) if r[-1] is not None else None for r in out], pa.map_(pa.string(), pa.string()))}
        if held:
            raise ValueError(f"a record of {file} is cut short")

    return by_batch(pieces, RECORD, run)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata joined by their concurrent-to ids.

    Records that name no other one stand for themselves. One shuffle brings a capture's records together.
    """
    of = F.coalesce("concurrent_to", "record_id")
    main = F.col("kind").isin("response", "revisit")
    answer = F.struct("kind", "record_id", "target_uri", "digest", "refers_to", "http", "payload_bytes", "payload_digest", "payload")
    return records.groupBy(of.alias("capture")).agg(
        F.max(F.when(F.col("kind") == "request", F.struct("record_id", "target_uri", "http"))).alias("request"),
        F.max(F.when(main, answer)).alias("response"),
        F.max(F.when(F.col("kind") == "metadata", F.struct("record_id", F.map_entries("fields").alias("fields")))).alias("metadata"),
        F.count(F.when(main, 1)).alias("copies"),
    ).withColumn("metadata", F.struct("metadata.record_id", F.map_from_entries("metadata.fields").alias("fields")))


def page_transactions(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` to ``path``, read the archives back and report each page's record."""
    write_archive(pages, path)
    found = captures(read_records(pages.sparkSession, path))
    field = lambda name: F.try_element_at("metadata.fields", F.lit(name))
    return found.select(
        field("page-id").cast("long").alias("page_id"), F.coalesce("response.payload_bytes", field("payload-length").cast("long")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"),
        field("refers-to-page").cast("long").alias("refers_to"), F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"),
    ).drop("copy")
