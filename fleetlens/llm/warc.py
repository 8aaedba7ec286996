"""WARC archives: segmented, chunked records out, whole payloads back.

Writing: a task turns each page into WARC/1.1 records and Spark's text writer puts
them, byte for byte, into gzip files in a folder that all executors share.  A response
holds an HTTP message with chunked transfer framing; a long one becomes several records,
the first segment and its continuations.  A payload seen before becomes a revisit.

Reading: Spark splits the archives at record starts, whole records are decoded where
they lie, and the segments of a record are grouped by their origin, ordered by number,
checked against the total length, joined and decoded.  A group is one record, so it is
no larger than the page it holds.  The writer never lets a record start appear inside a
record (it begins another chunk there), so splitting is exact.

Defined cases: a null html is an empty payload; a null url has no target field; a null
page_id is no first page while its payload has another, and comes back null;
repeated rows are records of their own (equal page_id and payload: all are responses or
all revisits); an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.joins import small_side
from fleetlens.llm.registry import query, table
from fleetlens.session import cut, drop_staged, stage_path

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VERSION = "WARC/1.1"
DATE = "2026-01-01T00:00:00Z"
CHUNK_BYTES = 8192
SEGMENT_BYTES = 16384
MIN_REVISIT_BYTES = 100
FILE_RECORDS = 200_000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
START = b"WARC/1.1\r\n"  # with the blank line before it, the start of a record


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing; a chunk ends before what looks like a record start."""
    out, a = [], 0
    while a < len(payload):
        b = min(a + CHUNK_BYTES, len(payload))
        trap = payload.find(START, a + 1, min(b + len(START), len(payload)))
        if trap > 0:
            b = min(b, trap)
        out += [b"%x\r\n" % (b - a), payload[a:b], b"\r\n"]
        a = b
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of chunked framing, or None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(chunk)
        at = end + 4 + size


def segments(block: bytes, limit: int = SEGMENT_BYTES) -> list[bytes]:
    """The block in parts of about ``limit`` bytes; none begins like a record."""
    out, a = [], 0
    while a < len(block) or not out:
        b = a + limit
        if block.startswith(START, b):
            b += 1
        out.append(block[a:b])
        a = b
    return out


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return START + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def page_records(row: dict) -> Iterator[bytes]:
    """All records of one page, without the blank lines that end each of them."""
    own = f"<urn:page:{row['id']}>"
    uri = None if row["url"] is None else "".join("%%%02X" % ord(c) if c in "\r\n" else c for c in row["url"])
    common = [
        ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Page-Id", row["page_id"]),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http;msgtype=response"),
    ]
    if row["refers_to"] is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-Id", row["refers_to"])]
        yield _record(fields + common, HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked((row["html"] or "").encode())
    parts = segments(block)
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common], block)
        return
    for n, part in enumerate(parts, 1):
        if n == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1), *common]
        else:
            fields = [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{row['id']}:{n}>"), ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n),
                ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None),
            ]
        yield _record(fields, part)


def _write_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for i in range(batch.num_rows):
            for record in page_records({c: batch.column(c)[i].as_py() for c in batch.schema.names}):
                out.append(record)
                size += len(record)
            if size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write ``page_id``, ``url`` and ``html`` of all pages as gzip WARC files below ``folder``.

    Equal payloads of at least 100 bytes have one response, of the smallest page_id.  The
    payloads seen more than once are found with a partial aggregate; only they are
    joined back, broadcast if their measured size allows it.
    """
    rows = pages.select(
        "page_id", "url", "html",
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"),
        F.coalesce(F.octet_length("html"), F.lit(0)).alias("_bytes"),
    )
    seen = rows.where(F.col("_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("_first"), F.count("*").alias("_n")
    )
    again = small_side(cut(seen.where("_n > 1").select("digest", "_first")))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    records = rows.join(again, "digest", "left").select(
        F.monotonically_increasing_id().alias("id"), "page_id", "url",
        F.when(refers.isNull(), F.col("html")).alias("html"), "digest", refers.alias("refers_to"),
    )
    lines = records.mapInArrow(_write_records, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(folder, compression="gzip")


def http_payload(blocks: pd.Series) -> pd.Series:
    """The payload of HTTP messages; null where the framing is broken."""
    def one(block: bytes) -> bytes | None:
        head, gap, body = bytes(block).partition(b"\r\n\r\n")
        if not gap:
            return None
        return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body

    return blocks.map(one)


def read_archives(spark, folder: str) -> DataFrame:
    """One row per record that is no continuation.

    Returns record_id, record_type, page_id, url, payload_digest (as stated), refers_to (a
    page_id), payload (binary; null for revisits) and intact: every length and the framing
    are as stated.
    """
    decode = F.pandas_udf(http_payload, T.BinaryType())
    raw = spark.read.option("lineSep", "\r\n\r\n" + START.decode()).text(folder)
    # the first record of a file still has its version line; the others get a blank in its place
    value = F.when(F.col("value").startswith(START.decode()), F.col("value")).otherwise(F.concat(F.lit("\r\n"), F.col("value")))
    head = F.substring_index(F.col("value"), "\r\n\r\n", 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))
    records = raw.select(value.alias("value")).select("value", head.alias("head")).select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"),
        field("WARC-Page-Id").cast("long").alias("page_id"), field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        field("WARC-Refers-To-Page-Id").cast("long").alias("refers_to"),
        field("WARC-Segment-Origin-ID").alias("origin"), field("WARC-Segment-Number").cast("int").alias("number"),
        field("WARC-Segment-Total-Length").cast("long").alias("total"), field("Content-Length").cast("long").alias("length"),
        F.substring(F.col("value"), F.length("head") + F.lit(5), F.lit(2**31 - 1)).alias("block"),
    )
    # the last record of a file keeps the blank lines that end it
    extra = F.octet_length("block") - F.col("length")
    tail = (extra == 4) & F.col("block").endswith("\r\n\r\n")
    records = records.withColumn("block", F.when(tail, F.expr("left(block, length(block) - 4)")).otherwise(F.col("block")))
    facts = ["record_id", "type", "page_id", "url", "payload_digest", "refers_to"]
    whole = records.where(F.col("number").isNull()).select(
        *facts, "block", (F.octet_length("block") == F.col("length")).alias("fits")
    )
    parts = records.where(F.col("number").isNotNull()).groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in facts[1:]],
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("_parts"),
        F.max("total").alias("_total"), F.max("number").alias("_last"), F.count("*").alias("_count"),
        F.min((F.octet_length("block") == F.col("length")).cast("int")).alias("_fits"),
    )
    joined = F.array_join(F.transform("_parts", lambda x: x["block"]), "")
    parts = parts.withColumn("block", joined).select(
        *facts, "block",
        F.coalesce(
            (F.octet_length("block") == F.col("_total")) & (F.col("_last") == F.col("_count")) & (F.col("_fits") == 1), F.lit(False)
        ).alias("fits"),
    )
    revisit = F.col("type") == "revisit"
    both = whole.unionByName(parts).withColumn("_payload", decode(F.col("block").cast("binary")))
    return both.select(
        "record_id", F.col("type").alias("record_type"), "page_id", "url", "payload_digest", "refers_to",
        F.when(~revisit, F.col("_payload")).alias("payload"),
        (F.col("fits") & (revisit | F.col("_payload").isNotNull())).alias("intact"),
    )


def _sizes(read: DataFrame) -> DataFrame:
    """Bytes and digest of every record's full payload, recomputed; revisits get those of their response."""
    rows = cut(read.select(
        "page_id", "record_type", "payload_digest", "refers_to", "intact",
        F.octet_length("payload").cast("long").alias("_bytes"),
        F.sha2("payload", 256).alias("_digest"),
    ))
    wanted = rows.where("record_type = 'revisit'").select("payload_digest").distinct()
    known = rows.where("record_type = 'response'").join(wanted, "payload_digest").groupBy("payload_digest").agg(
        F.min("_bytes").alias("_of")
    )
    known = small_side(cut(known))
    same: Column = F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.col("_digest"))
    return rows.join(known, "payload_digest", "left").select(
        "page_id", F.coalesce("_bytes", "_of").alias("payload_bytes"), same.alias("payload_digest"), "record_type",
        "refers_to", (F.col("intact") & (same == F.col("payload_digest"))).alias("intact"),
    )


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


@query("op5_warc", OP5_SQL)
def op5_warc(spark, sf_dir):
    folder = stage_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    rows = _sizes(read_archives(spark, folder))
    drop_staged(spark, folder)  # the result no longer reads the archives
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
