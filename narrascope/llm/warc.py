"""WARC archives: writing captures and assembling them again into one nested row each.

Writing: every page becomes three records, request, response (or revisit) and metadata, tied by
``WARC-Concurrent-To``. Equal payloads of at least ``MIN_REVISIT`` bytes are stored once, in the response
with the largest page id; the others are revisit records that name it. Records are rows of text and
Spark's text writer, with the record separator as line separator, lays them out as gzip archives.

Reading: archives are decompressed as a stream, one per task, so a task holds the compressed file and a
batch of records whatever the size of the archive; records are cut by their ``Content-Length``, and transactions are assembled by joins: request and metadata to the response through
the concurrent-to id, a revisit to its response through the refers-to id.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import materialize
from narrascope.session import scratch_dir

MIN_REVISIT = 1000
#: bytes of payload per archive file before compression, on average; a task starts a new file after as
#: many captures, so files need no shuffle
FILE_BYTES = 32 << 20
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12)), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as gzip WARC files under ``path``.

    Every row is a capture of its own, repeated rows too. Rows that repeat the largest page id of a group
    of equal payloads are all responses. Null ids never are the largest unless all are null, and then
    none of the group is a revisit. A null url is written without a target URI; line breaks in a url
    become ``%0D`` and ``%0A``.
    """
    rows = pages.select(F.monotonically_increasing_id().cast("string").alias("row"), F.col("page_id").cast("long").alias("page_id"),
                        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), payload(F.col("html")).alias("body"))
    rows = materialize(rows.withColumn("n", F.octet_length("body").cast("long")).withColumn("sha", F.sha1("body")), "warc-captures")
    groups = (rows.filter(F.col("n") >= MIN_REVISIT).groupBy("sha")
              .agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("page_id", "row")).alias("top"))
              .filter("copies > 1 and top.page_id is not null").select("sha", F.col("top.page_id").alias("first_id"), F.col("top.row").alias("first_row")))
    groups = materialize(groups, "warc-groups")
    r = rows.join(groups, "sha", "left")
    again = F.col("first_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    rid = _urn(F.lit("response"), F.col("row"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    uri = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(DATE))]
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:]*://([^/?#]*)", 1)
    target = F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:]*://[^/?#]*([^#]*)", 1), " ", "%20")
    get = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)),
                   F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF * 2))
    facts = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    response = _record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), [
        ("WARC-Record-ID", rid), *uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        ("WARC-Refers-To", F.when(again, _urn(F.lit("response"), F.col("first_row")))),
        ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body").cast("string"))))
    request = _record("request", [("WARC-Record-ID", _urn(F.lit("request"), F.col("row"))), ("WARC-Concurrent-To", rid), *uri,
                                  ("Content-Type", F.lit("application/http; msgtype=request"))], get)
    metadata = _record("metadata", [("WARC-Record-ID", _urn(F.lit("metadata"), F.col("row"))), ("WARC-Concurrent-To", rid), *uri,
                                    ("Content-Type", F.lit("application/warc-fields"))], facts)
    size = rows.agg(F.sum("n").alias("b"), F.count(F.lit(1)).alias("k")).first()
    per_file = max(1, size["k"] * file_bytes // max(1, size["b"] or 0))
    records = r.select(F.concat_ws(CRLF * 2, request, response, metadata).alias("value"))
    (records.write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", int(per_file)).text(path))


RECORD = ("record_id string, type string, concurrent_to string, refers_to string, url string, digest string, "
          "payload_bytes long, payload binary, fields string")
_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
                    ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.string())])


def parse_records(data: bytes | BinaryIO, keep_payload: bool = True) -> Iterator[dict]:
    """The records of one uncompressed archive (bytes or a stream), cut by ``Content-Length``, one at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().removesuffix(CRLF).partition(": ")
            head[k.lower()] = v
        size = int(head["content-length"])
        block, kind = stream.read(size), head["warc-type"]
        if len(block) < size:
            raise ValueError(f"the archive ends inside {head['warc-record-id']}")
        row = {"record_id": head["warc-record-id"], "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"),
               "url": head.get("warc-target-uri"), "digest": None, "payload_bytes": None, "payload": None, "fields": None}
        if kind in ("response", "revisit"):
            body = block[block.index(b"\r\n\r\n") + 4:]
            stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response":
                row["digest"] = hashlib.sha1(body).hexdigest()
                if stated and stated != row["digest"]:
                    raise ValueError(f"payload of {row['record_id']} does not match its digest")
                row |= {"payload_bytes": len(body), "payload": body if keep_payload else None}
            else:
                row["digest"] = stated
        else:
            row["fields"] = block.decode()
        yield row


def read_records(spark, path: str, keep_payload: bool = True) -> DataFrame:
    """All records under ``path`` (plain or gzip archives), one task per file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                data = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                for row in parse_records(data, keep_payload):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > FILE_BYTES // 4 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "1")  # a row here is a whole archive
    try:
        files = spark.read.format("binaryFile").load(path).select("content")
        return materialize(files.mapInArrow(read, RECORD), "warc-records")
    finally:
        spark.conf.set(batch, before)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, url, response, request, metadata, original``.

    ``original`` is the response a revisit refers to. Captures without a request or metadata record have
    null there.
    """
    part = lambda kind, *cols: records.filter(F.col("type") == kind).select(F.col("concurrent_to").alias("capture_id"), F.struct(*cols).alias(kind))
    main = records.filter(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "url", "refers_to",
        F.struct("type", "digest", "payload_bytes", "payload").alias("response"))
    tied = (main.join(part("request", "record_id", "fields"), "capture_id", "left")
            .join(part("metadata", "record_id", "fields"), "capture_id", "left"))
    first = tied.filter(F.col("response.type") == "response").select(
        F.col("capture_id").alias("refers_to"), F.struct("capture_id", "metadata", F.col("response.payload_bytes").alias("payload_bytes")).alias("original"))
    # responses refer to nothing: only revisits are joined, so no task gets the rows without a key
    alone = tied.filter(F.col("refers_to").isNull()).withColumn("original", F.lit(None).cast(first.schema["original"].dataType))
    return tied.filter(F.col("refers_to").isNotNull()).join(first, "refers_to", "left").unionByName(alone)


def op8_warc(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back and return one row per capture."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_warc(pages, path)
    captures = assemble(read_records(spark, path, keep_payload=False))
    page = lambda m: F.regexp_extract(m["fields"], "^page_id: (-?[0-9]+)\r", 1).try_cast("long")
    return captures.select(page(F.col("metadata")).alias("page_id"),
                           F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
                           F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
                           page(F.col("original.metadata")).alias("refers_to"))
