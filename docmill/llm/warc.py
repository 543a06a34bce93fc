"""WARC writing, reading and transaction assembly.

Writing: each page becomes a request, a response or revisit, and a metadata
record; request and metadata name the main record in WARC-Concurrent-To. Of
pages with equal payloads of at least ``min_revisit`` bytes, that with the
smallest id is the response and the others are revisits that refer to it. A
record is one text value and records are separated by two line breaks, so
Spark's text writer writes the archives, with its commit protocol, to any
store it knows. Only pages' ids and digests meet to settle the responses;
the payload is moved once, dealt by page id.

Reading: archives are parsed by Content-Length, in a stream, one task a file.

Assembly: the records of a capture are brought together by the id they are
concurrent to, and each capture gives one nested row.

Edge cases: null html is an empty payload, null url an empty target; a null
page_id is a page like any other and the smallest; rows equal in id and
payload have equal record ids and are one capture when read.
"""

from __future__ import annotations

import base64
import hashlib
import io

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, open_fs, shared_path

DATE = "2024-01-15T12:30:00Z"
CRLF = "\r\n"
END = "\r\n\r\n"
FILE_BYTES = 64 << 20
READ = 1 << 20


def sha1_base32(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def _hex_to_base32(col: str) -> Column:
    def code(c: pd.Series) -> pd.Series:
        return c.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())

    return F.pandas_udf(code, T.StringType())(col)


def record_id(kind: str, *key: Column) -> Column:
    """A record id made from the page, so that a repeated task attempt writes
    the same one."""
    h = F.md5(F.concat_ws("/", F.lit(kind), *(F.coalesce(k.cast("string"), F.lit("null")) for k in key)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, rid: Column, body: Column, url: Column, ctype: str, more: list[Column]) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid),
             F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), url), F.lit(f"Content-Type: {ctype}"), *more,
             F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(END), body)


def settle(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(page_id, sha1, is_response, refers_to) of every distinct page and payload."""
    ids = pages.select("page_id", F.sha1("html").alias("sha1"), F.octet_length("html").alias("n"))
    first = ids.groupBy("sha1", "n").agg(F.min(F.struct(F.col("page_id").isNotNull(), "page_id")).alias("first"))
    both = ids.dropDuplicates().join(first, ["sha1", "n"])
    own = F.col("page_id").eqNullSafe(F.col("first.page_id")) | (F.col("n") < min_revisit)
    return both.select("page_id", "sha1", own.alias("is_response"), F.when(~own, F.col("first.page_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = 0) -> str:
    """Write ``pages`` (page_id, url, html) as archives; their folder."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "llm", "warc")
    # a line break in a URL would end its header
    pages = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A").alias("url"),
                         F.coalesce("html", F.lit("")).alias("html"))
    size = pages.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("b")).first()
    pages = pages.withColumn("sha1", F.sha1("html"))
    known = settle(pages, min_revisit).withColumnsRenamed({"page_id": "known_id", "sha1": "known_sha1"})
    both = pages.join(
        known, pages["page_id"].eqNullSafe(known["known_id"]) & (pages["sha1"] == known["known_sha1"]))
    both = both.withColumn("digest", _hex_to_base32("sha1"))
    rid, url = record_id("main", F.col("page_id"), F.col("sha1")), F.col("url")
    main = F.concat(F.lit("WARC-Concurrent-To: "), rid)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    request = _record("request", record_id("request", F.col("page_id"), F.col("sha1")),
                      F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
                      url, "application/http; msgtype=request", [main])
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    response = _record("response", rid, F.concat(http, F.col("html")), url, "application/http; msgtype=response", [digest])
    revisit = _record("revisit", rid, http, url, "application/http; msgtype=response", [
        digest, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("WARC-Refers-To: "), record_id("main", F.col("refers_to"), F.col("sha1"))), F.lit("WARC-Truncated: length")])
    metadata = _record("metadata", record_id("metadata", F.col("page_id"), F.col("sha1")),
                       F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
                       url, "application/warc-fields", [main])
    rows = both.select(F.explode(F.array(request, F.when(F.col("is_response"), response).otherwise(revisit), metadata)).alias("value"))
    each = size["b"] / max(1, size["n"]) + 2_000
    (rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(3, int(3 * FILE_BYTES / each))).text(folder))
    return folder


# ----------------------------------------------------------------- reading
def parse_stream(f):
    """(headers with lower-case names, body) of each record of an open
    archive, in order; at most one record is held."""
    f = io.BufferedReader(f, READ)
    while x := f.readline():
        x = x.rstrip(b"\r\n")
        if not x:
            continue
        if not x.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {x[:40]!r}")
        headers = {}
        while x := f.readline().rstrip(b"\r\n"):
            name, _, value = x.partition(b":")
            headers[name.decode().lower()] = value.decode().strip()
        n = int(headers["content-length"])
        body = f.read(n)
        if len(body) != n:
            raise ValueError("the archive ends within a record")
        yield headers, body


RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("file", "type", "record_id", "capture_id", "url", "date", "refers_to", "digest")]
                      + [T.StructField("http_header", T.StringType()), T.StructField("body", T.BinaryType()),
                         T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())])


def read_records(archives: DataFrame, with_body: bool = True) -> DataFrame:
    """Records of the files in ``archives`` (path): ``body`` is the payload
    of a response, else the whole block. The size and digest are those of the
    payload as read; without ``with_body`` the bytes of responses stay behind."""
    def run(it):
        from .byte_bpe import _arrow

        out = _arrow(RECORD)

        def rows():
            for b in it:
                for path in b.column(0).to_pylist():
                    fs, where = open_fs(path)
                    with fs.open_input_stream(where, compression="detect") as f:
                        for h, body in parse_stream(f):
                            kind, head = h["warc-type"], None
                            if kind in ("response", "revisit"):
                                head, _, body = body.partition(b"\r\n\r\n")
                            n, d = (len(body), sha1_base32(body)) if kind == "response" else (None, None)
                            yield (path, kind, h["warc-record-id"], h.get("warc-concurrent-to", h["warc-record-id"]), h.get("warc-target-uri"),
                                   h.get("warc-date"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                   head.decode("utf-8", "replace") if head is not None else None,
                                   body if with_body or kind != "response" else None, n, d)

        yield from batches(rows(), out)

    return archives.select("path").mapInArrow(run, RECORD)


def list_archives(spark, folder: str) -> DataFrame:
    """(path) of the archive files, dealt over tasks one by one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length")
    n = max(1, spark.sparkContext.defaultParallelism)
    return files.select("path").repartition(n)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: capture_id, url, main (response or revisit),
    request, metadata. Records of a capture are few; a record kind that comes
    twice in a capture is represented by its smallest record id."""
    def one(cond: Column, *fields: str) -> Column:
        return F.min(F.when(cond, F.struct("record_id", *fields)))

    kind = F.col("type")
    return records.groupBy("capture_id").agg(
        F.max(F.when(kind.isin("response", "revisit"), F.col("url"))).alias("url"),
        one(kind.isin("response", "revisit"), "type", "date", "digest", "refers_to", "http_header", "body", "payload_bytes", "payload_digest").alias("main"),
        one(kind == "request", "date", "body").alias("request"),
        one(kind == "metadata", "date", "body").alias("metadata"))


def captures(spark, folder: str, with_body: bool = True) -> DataFrame:
    return assemble(read_records(list_archives(spark, folder), with_body))


def digests(spark, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of
    every page, from the archives that were written and read back. A revisit's
    size is that of the response it refers to."""
    id_type = pages.schema["page_id"].dataType
    rows = captures(spark, write_archives(pages.select("page_id", "url", "html")), with_body=False)
    got = rows.select(
        F.nullif(F.regexp_extract(F.col("metadata.body").cast("string"), r"^page_id: (.*)\r\n$", 1), F.lit("")).cast(id_type).alias("page_id"),
        F.col("main.record_id").alias("record_id"), F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("to"),
        F.col("main.payload_bytes").alias("n"), F.coalesce(F.col("main.payload_digest"), F.col("main.digest")).alias("payload_digest"))
    first = got.filter(F.col("record_type") == "response").select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("n").alias("to_n"))
    return got.join(first, "to", "left").select("page_id", F.coalesce("n", "to_n").alias("payload_bytes"), "payload_digest", "record_type",
                                                F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
    array_to_string(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda g: array_to_string(list_transform([15, 10, 5, 0],
      lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * g + 1, 5))::INT >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
