"""A content-addressed archive of WARC records.

`payloads/` holds every distinct payload once, deflated, under its SHA-256; `headers/`
holds the exact header bytes of every record (WARC fields, and the HTTP head of its block)
with the digest that names its payload. `records` puts the original WARC records together by
a join on the digest; `parse` reads them like any reader of WARC bytes would.

* Equal payloads of at least `LEAST_BYTES` make one response, that of the largest page_id;
  the others are revisits which refer to it and have no payload of their own. Smaller
  payloads are stored once too, but all their records are responses.
* A digest is verified: rows with equal SHA-256 must agree in length and SHA-1 when the
  archive is written, and a payload must have both when its record is read.
* Copies are reduced within each task before any exchange, and only digests, never
  payloads, are grouped to find responses; a payload that a third of all pages share costs
  one row for each task.

Defined cases: null html is an empty payload; a null url is written as `about:blank`, control
characters and blanks in one as %20; of repeated rows with the largest page_id one is the
response and the others refer to it; an empty table makes an empty archive; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.session import materialize

LEAST_BYTES = 1_000
DATE = "2024-01-01T00:00:00Z"

# Fixed value: the profile of revisits with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _lines(*lines: Column | str) -> Column:
    """Header lines with their ends and the blank line after them; null lines are left out."""
    cells = [F.lit(x) if isinstance(x, str) else x for x in lines]
    return F.concat(F.concat_ws(CRLF, *cells), F.lit(CRLF + CRLF))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _headers(meta: DataFrame, least: int, date: str) -> DataFrame:
    """meta: page_id, url, row, length, sha1, sha256."""
    first = meta.filter(F.col("length") >= least).groupBy("sha256").agg(
        F.max(F.struct("page_id", "row", "record_id", "url")).alias("first"),
        (F.min("sha1") == F.max("sha1")).alias("a"), (F.min("length") == F.max("length")).alias("b"),
    ).select("sha256", F.when(F.col("a") & F.col("b"), F.col("first")).otherwise(
        F.raise_error("two payloads with one SHA-256")
    ).alias("first"))
    rows = meta.join(first, "sha256", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", _field("Content-Length", F.col("length")))
    rows = rows.withColumn("revisit", revisit).withColumn("http", http)
    block = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("length"))
    warc = _lines(
        "WARC/1.1",
        F.when(F.col("revisit"), "WARC-Type: revisit").otherwise("WARC-Type: response"),
        _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(F.col("revisit"), _field("WARC-Refers-To", F.col("first.record_id"))),
        F.when(F.col("revisit"), _field("WARC-Refers-To-Target-URI", F.col("first.url"))),
        F.when(F.col("revisit"), _field("X-Refers-To-Page", F.col("first.page_id"))),
        _field("X-Page", F.col("page_id")),
        "Content-Type: application/http;msgtype=response", _field("Content-Length", block),
    )
    return rows.select(
        "record_id", "page_id", F.concat(warc, F.col("http")).cast("binary").alias("header"),
        F.when(~F.col("revisit"), F.col("sha256")).alias("payload_sha256"),
    )


def _deflated(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [p.as_py() for p in batch.column("payload")]
            yield pa.record_batch(
                [pa.array([hashlib.sha256(p).hexdigest() for p in raw]),
                 pa.array([zlib.compress(p) for p in raw], pa.binary())],
                names=["payload_sha256", "deflated"],
            )

    return pages.select("payload").mapInArrow(run, "payload_sha256 string, deflated binary")


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Archive `pages` (page_id, url, html) under `folder`."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    read = pages.select(F.col("page_id").cast("long"), url.alias("url"), payload.alias("payload"))
    meta = materialize(
        read.select(
            "page_id", "url", F.octet_length("payload").cast("long").alias("length"),
            F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"),
            F.monotonically_increasing_id().alias("row"),
        ), "captures",
    )
    digest = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.col("row").cast("string"), "url"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    meta = meta.withColumn("record_id", F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")))
    _headers(meta, least, date).write.mode("errorifexists").parquet(f"{folder}/headers")
    _deflated(read).groupBy("payload_sha256").agg(F.first("deflated").alias("deflated")).write.mode(
        "errorifexists"
    ).parquet(f"{folder}/payloads")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """record_id and the bytes of every WARC record in the archive."""
    headers = spark.read.parquet(f"{folder}/headers")
    joined = headers.filter("payload_sha256 is not null").join(
        spark.read.parquet(f"{folder}/payloads"), "payload_sha256", "left"
    ).select("record_id", "header", "payload_sha256", "deflated")
    whole = joined.unionByName(headers.filter("payload_sha256 is null").select(
        "record_id", "header", "payload_sha256", F.lit(None).cast("binary").alias("deflated")
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for r in batch.to_pylist():
                payload = b""
                if r["payload_sha256"] is not None:
                    payload = zlib.decompress(r["deflated"])
                    if hashlib.sha256(payload).hexdigest() != r["payload_sha256"]:
                        raise ValueError(f"{r['record_id']}: payload and digest differ")
                ids.append(r["record_id"])
                found.append(r["header"] + payload + b"\r\n\r\n")
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(found, pa.binary())], names=["record_id", "record"])

    return whole.mapInArrow(run, "record_id string, record binary")


def read_record(record: bytes) -> dict:
    """The fields and payload of one WARC record; raises ValueError where they do not agree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split(CRLF)
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode("latin-1").split(CRLF)[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (
        len(payload) != length or hashlib.sha1(payload).hexdigest() != digest
    ):
        raise ValueError("payload and digest differ")
    return {"fields": fields, "payload": payload, "length": length, "digest": digest}


PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def parse(found: DataFrame) -> DataFrame:
    """What the records say: one row for each, PARSED."""

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("record"):
                r = read_record(data.as_py())
                rows.append((number(r["fields"].get("X-Page")), r["length"], r["digest"], r["fields"]["WARC-Type"],
                             number(r["fields"].get("X-Refers-To-Page"))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                  names=[f.split()[0] for f in PARSED.split(", ")])

    return found.select("record").mapInArrow(run, PARSED)
