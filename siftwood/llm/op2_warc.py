"""Operator 2: WARC archives with revisit resolution.

Headers (id, target, digest, length) are shuffled by payload digest to find the original of
each repeated payload, and the headers of repeats are joined to those, which makes them
revisit records.  Payloads stay where they are: a filter of bounded size tells rows that
surely repeat nothing, and they are written as read; a second one tells rows that are surely
no original, and they need no payload.  What passes both, the originals and few others, is
joined with its payload, and rows that the filters were wrong about are looked up at the end.
The deduplicated archives are written with fresh headers and read back.

Archives are written by Spark's text sink: a record ends with two line breaks, which is the
sink's line separator, so the files are gzipped WARC 1.1, committed by the usual protocol on
any store, and a lost executor costs its tasks alone.  Each record names, right after the
version line, the segment it belongs to; "end of record, version, segment" is the separator
at reading, so records stream and only one is held at a time.  The segment is fresh for each archive,
and the block lengths are verified against the headers, so a payload that contained the
separator could not pass unnoticed.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.operators.sizing import broadcast_if_small

from . import common

CRLF = "\r\n"
END = CRLF * 2
LEAST_BYTES = 1000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(c):
    """A header value: control characters would end the line."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", " ")


_KEY = ["payload_digest", "payload_bytes"]


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """(digest, bytes, original, n) of payloads that n rows share, several.

    The original is the record of the largest id.  A partial aggregate: a digest that a
    third of all records share costs one row per task.
    """
    return headers.groupBy(*_KEY).agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND original IS NOT NULL")


def resolved(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes, original) of pages; original is null for what repeats nothing.

    html is null where the row is a revisit.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("payload_digest", F.unhex(F.sha1(F.col("html").cast("binary")))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    columns, unknown = [*p.columns, "original"], F.lit(None).cast("long").alias("original")
    headers = common.materialise(p.filter(F.col("payload_bytes") >= least_bytes).drop("html"), "warc-headers")
    originals = common.materialise(resolve_revisits(headers), "warc-originals")
    if not originals.limit(1).count():
        return p.select(*p.columns, unknown)
    hot = common.hot_keys(originals.select(*_KEY, "n"))
    originals = originals.drop("n")
    payload, record = F.xxhash64(*_KEY), F.xxhash64(*_KEY, "page_id")
    repeated = common.key_filter(originals.select(payload.alias("h")))
    original = common.key_filter(originals.select(F.xxhash64(*_KEY, "original").alias("h")))

    def told(df: DataFrame) -> DataFrame:
        told = common.with_filter(common.with_filter(df, repeated, payload, "repeats"), original, record, "is_original")
        return told.withColumn("repeats", F.col("repeats") & (F.col("payload_bytes") >= least_bytes))

    alone = told(p).filter("NOT repeats").select(*p.columns, unknown)
    whole = common.join_unique(told(p).filter("repeats AND is_original").select(*p.columns), originals, _KEY, hot, "left")
    others = common.join_unique(told(headers).filter("repeats AND NOT is_original").select(*headers.columns), originals, _KEY, hot, "left")
    others = common.materialise(others, "warc-revisits")
    revisits = others.filter("original IS NOT NULL").withColumn("html", F.lit(None).cast("string"))
    parts = [alone, whole, revisits]
    lost = common.materialise(others.filter("original IS NULL").select(*_KEY).distinct(), "warc-lost")  # the filter was wrong: they repeat nothing
    if lost.limit(1).count():
        sought = common.with_filter(told(p).filter("repeats AND NOT is_original"), common.key_filter(lost.select(payload.alias("h"))), payload, "lost")
        parts.append(sought.filter("lost").select(*p.columns).join(broadcast_if_small(lost), _KEY, "left_semi").select(*p.columns, unknown))
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])


def to_records(pages: DataFrame, segment: str, date: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One WARC record per page as a string column `value`, without its final line breaks."""
    p = resolved(pages, least_bytes).withColumn("payload_digest", F.lower(F.hex("payload_digest")))
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))

    def line(key, value):
        return F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))

    def record_id(c):
        digest = F.md5(F.concat(F.lit(f"{segment}:"), c))
        cut = [F.substring(digest, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))

    refers = F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("original").cast("string"))), line("Refers-To-Page-Id", F.col("original").cast("string")), line("WARC-Profile", F.lit(REVISIT)))).otherwise(F.lit(""))
    return p.withColumn("block", block).select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}WARC-Segment: {segment}{CRLF}"),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", record_id(name)),
            line("Page-Id", name),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", _clean(F.col("url"))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
            refers,
            line("Content-Type", F.lit("application/http;msgtype=response")),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit(CRLF),
            F.col("block"),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> str:
    """Write deduplicated archives of pages (page_id, url, html) under path; returns the segment for reading.

    A null html is an empty payload, a null url an empty target.  Payloads shorter than
    least_bytes are always responses.  Rows that repeat the largest page_id of a payload are
    all responses; a row with a null page_id revisits the original if there is one.
    """
    segment = uuid.uuid4().hex
    to_records(pages, segment, date, least_bytes).write.option("lineSep", END).option("compression", "gzip").text(path)
    return segment


def read_archives(spark: SparkSession, path: str, segment: str) -> DataFrame:
    """The records under path: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    payload is null for a revisit; its size and digest are those of the full payload.  A
    record whose block differs in length from its header, or whose payload differs from its
    digest, raises an error.
    """
    start = f"WARC/1.1{CRLF}WARC-Segment: {segment}{CRLF}"
    raw = spark.read.option("lineSep", END + start).text(path).filter(F.length("value") > 0)
    # the first record of a file still has its start, the last one its end
    v = F.col("value")
    v = F.when(v.startswith(start), F.substr(v, F.lit(len(start) + 1))).otherwise(v)
    cut = raw.select(v.alias("v")).withColumn("at", F.instr("v", END))
    cut = cut.select(F.substr("v", F.lit(1), F.col("at") + 1).alias("head"), F.substr("v", F.col("at") + 4).alias("rest"))

    def header(key):
        return F.regexp_extract("head", rf"(?:^|\r\n){key}: ([^\r\n]*)\r", 1)

    def number(c):
        return F.when(c != "", c.cast("long"))

    cut = cut.withColumn("size", header("Content-Length").cast("long")).withColumn("extra", F.octet_length("rest") - F.col("size"))
    whole = (F.col("extra") == 0) | ((F.col("extra") == 4) & F.col("rest").endswith(END))
    cut = cut.withColumn("block", F.when(F.col("extra") == 0, F.col("rest")).when(whole, F.substr("rest", F.lit(1), F.length("rest") - 4)).otherwise(F.raise_error(F.lit("a WARC block differs in length from its header"))))
    body = F.instr("block", END)
    http = F.substr("block", F.lit(1), body + 1)
    kind = header("WARC-Type")
    cut = cut.select(
        number(header("Page-Id")).alias("page_id"),
        header("WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        number(header("Refers-To-Page-Id")).alias("refers_to"),
        F.regexp_extract(http, r"\r\nContent-Length: ([0-9]+)\r", 1).cast("long").alias("payload_bytes"),
        F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]{40})\r", 1).alias("payload_digest"),
        F.when(kind == "response", F.substr("block", body + 4)).alias("payload"),
    )
    good = F.col("payload").isNull() | ((F.sha1(F.col("payload").cast("binary")) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes")))
    return cut.withColumn("payload_digest", F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a WARC payload differs from its digest"))))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "warc")
    segment = write_archives(common.table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, segment).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < max(page_id) OVER (PARTITION BY d, n) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < max(page_id) OVER (PARTITION BY d, n) THEN max(page_id) OVER (PARTITION BY d, n) END AS refers_to
FROM p
"""
