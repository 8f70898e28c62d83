"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling them again.

Writing is expressions and Spark's text writer (one record a line, whose separator is the record's last CRLF), so files
go wherever Spark can write. Reading parses whole files by Content-Length in tasks. Assembly joins the records of one
capture through WARC-Concurrent-To and gives one nested row a capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, write_shared

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in one file at most (with three a capture, about 2,000 captures), and bytes of records of mean size.
RECORDS_PER_FILE, BYTES_PER_FILE = 6_000, 64_000_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits at a time from base 16 to base 32, then to the standard letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, *of: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("\t")) for c in of]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, i, n), F.lit("-"))], F.substring(h, 21, 12), F.lit(">"))


def _record(kind: Column | str, own: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record's text up to the separator; headers with a null value are left out."""
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), own]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    lines += [F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n")]
    return F.concat(*lines)


def numbered(rows: DataFrame, key: Column) -> tuple[DataFrame, int, int]:
    """(rows with `copy`, their number, their bytes of html): copy tells rows of equal page_id, url and html apart, "" where there is one.

    Only rows whose hash key repeats are numbered, within the partition in which they stand, so that no group is dealt to
    one task; they are written once, since partitions may differ when they are made again.
    """
    counts = write_shared(rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes")), "counts")
    n, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    again = counts.where("n > 1").select("key")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit("")), n, size
    keyed = rows.withColumn("key", key)
    some = keyed.join(again, "key", "left_semi").withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("page_id", "url", "html", "part").orderBy("key"))
    some = write_shared(some.withColumn("copy", F.concat_ws("-", "part", number)).drop("part"), "copies")
    return keyed.join(again, "key", "left_anti").withColumn("copy", F.lit("")).unionByName(some).drop("key"), n, size


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files under path: three records for every row, repeated rows too.

    Of rows with equal payloads of at least least_bytes bytes, the one with the smallest page_id (null last, then the
    smaller url, then any one of equal rows) has a response record and the others revisit it; smaller payloads are all
    responses. A null html is an empty payload, a null url gives no WARC-Target-URI; line breaks in a url are
    percent-encoded. Files hold at most RECORDS_PER_FILE records, and fewer where records are large: BYTES_PER_FILE at
    their mean size. An empty table gives a folder without records. Other columns are not read.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"))
    rows, count, size = numbered(rows, F.xxhash64("page_id", "url", "html"))
    per_file = max(3, min(RECORDS_PER_FILE, 3 * count * BYTES_PER_FILE // max(1, size)))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("u"), F.col("url").isNull().alias("no_url"), "copy")
    # Only payloads that repeat are looked up, so that the pages are not shuffled while these are few.
    first = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    rows = rows.join(write_shared(first, "first"), "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~order.eqNullSafe(F.col("first")))
    own = [F.col("page_id"), F.coalesce("url", F.lit("")), F.col("url").isNull(), F.col("digest"), F.col("copy")]
    capture = _record_id("capture", *own)
    origin = _record_id("capture", F.col("first.page_id"), F.col("first.u"), F.col("first.no_url"), F.col("digest"), F.col("first.copy"))
    uri = ("WARC-Target-URI", F.col("url"))
    host = F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit(""))
    target = F.coalesce(F.regexp_extract("url", r"://[^/?#]*([^#]*)", 1), F.lit(""))
    request = F.concat(F.lit("GET "), F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("payload-bytes: "), F.col("n").cast("string"), F.lit("\r\n"))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    records = F.array(
        _record("request", _record_id("request", *own), [("WARC-Concurrent-To", capture), uri], "application/http;msgtype=request", request),
        _record(kind, capture, [uri, digest, ("WARC-Refers-To", F.when(F.col("revisit"), origin)), ("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE)))], "application/http;msgtype=response", F.when(F.col("revisit"), http).otherwise(F.concat(http, "html"))),
        _record("metadata", _record_id("metadata", *own), [("WARC-Concurrent-To", capture), uri], "application/warc-fields", fields),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed WARC stream; blocks go by Content-Length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, http string, payload binary, payload_bytes long, payload_digest string, fields map<string,string>"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row (RECORD) for each record of the files under path, gzipped or not.

    payload is the HTTP body of a response and null otherwise; payload_bytes and payload_digest belong to the full
    payload: counted and hashed for responses, taken from the headers for revisits. fields holds a metadata record's lines.
    Headers that a record lacks are null, and a record without Content-Length has no block; anything else than a record
    where one should begin ends the job with an error. A file is read by one task, one record at a time: files may have up
    to 2 GB as stored (larger ones have to be cut between records first). Records of all kinds are returned, repeats too.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string()] * 6 + [pa.binary(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]

    def rows(content: bytes) -> Iterator[tuple]:
        raw = io.BytesIO(content)
        for h, block in parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if content[:2] == b"\x1f\x8b" else raw):
            kind, http, payload, n, digest, fields = h.get("warc-type"), None, None, None, None, None
            if kind in ("response", "revisit", "request") and h.get("content-type", "").startswith("application/http"):
                head, _, body = block.partition(b"\r\n\r\n")
                http = head.decode("utf-8", "replace")
                if kind == "response":
                    payload, n = body, len(body)
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                elif kind == "revisit":
                    digest = (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    n = next((int(x.partition(":")[2]) for x in http.split("\r\n") if x.lower().startswith("content-length:")), None)
            elif h.get("content-type") == "application/warc-fields":
                fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()]
            yield h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), http, payload, n, digest, fields

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for content in batch.column(0):
                got, size = [], 0
                for row in rows(content.as_py()):
                    got.append(row)
                    size += len(row[6] or b"")
                    if size > 2_000_000 or len(got) >= 4_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types)], names)
                        got, size = [], 0
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types)], names)

    return arrow(files, run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, target_uri, response, request, metadata.

    A capture is a response or revisit record; the request and metadata records that are concurrent to it join it (null
    if there is none; of several, the least record id). Records that share an id are one record; records without an id,
    and request and metadata records that are concurrent to nothing there, are left out. No records give no rows.
    """
    captures = records.where(F.col("type").isin("response", "revisit") & F.col("record_id").isNotNull()).dropDuplicates(["record_id"])
    response = F.struct("type", "refers_to", "http", "payload", "payload_bytes", "payload_digest")
    captures = captures.select(F.col("record_id").alias("capture_id"), "target_uri", response.alias("response"))

    def concurrent(kind: str, name: str, *fields: str) -> DataFrame:
        rows = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        one = rows.groupBy("concurrent_to").agg(F.min_by(F.struct("record_id", *fields), "record_id").alias(name))
        return one.withColumnRenamed("concurrent_to", "capture_id")

    return captures.join(concurrent("request", "request", "http"), "capture_id", "left").join(concurrent("metadata", "metadata", "fields"), "capture_id", "left")
