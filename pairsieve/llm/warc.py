"""Content-addressed web archive.

Payload bytes are stored once under their SHA-256; exact record headers are a
table of their own; original records come back by joining the two on the
digest. Of the records with one payload the one with the largest page_id is
the response, the others are revisits that refer to it and hold no payload.

Every read of the payload store recomputes the digest of the stored bytes and
fails on a mismatch. All steps are DataFrame expressions; a payload shared by
very many pages is one row in the store, pre-aggregated within each task, and
the join of headers to payload facts is on rows without payloads, which
adaptive execution can split.

Defined cases: null html is the empty payload and is archived like any other;
a null url gives an empty target, and a line end in a url becomes a blank; equal rows are one record each, and rows
that tie for the largest page_id are all responses; a null page_id never wins
over a number; pages without any number among equal payloads are responses
(they have no id to refer to); an empty table gives an empty archive; other
columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CAPTURE_DATE = "2026-01-01T00:00:00Z"
ID_PREFIX = "urn:x-page:"
LINE_END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as base32: five hex digits are four base32 digits."""
    hex_digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def header_text(page_id: Column, url: Column, size: Column, sha1: Column, refers_to: Column, is_response: Column) -> Column:
    """Record header and HTTP header, as they stand in front of the payload."""
    http = _lines(
        "HTTP/1.1 200 OK", LINE_END, "Content-Type: text/html; charset=utf-8", LINE_END, "Content-Length: ", size.cast("string"), LINE_END, LINE_END,
    )
    length = F.octet_length(http) + F.when(is_response, size).otherwise(0)
    name = F.coalesce(page_id.cast("string"), F.lit(""))
    revisit = _lines(
        "WARC-Profile: ", REVISIT_PROFILE, LINE_END, "WARC-Refers-To: <", ID_PREFIX, F.coalesce(refers_to.cast("string"), F.lit("")), ">", LINE_END,
    )
    return _lines(
        VERSION, LINE_END, "WARC-Type: ", F.when(is_response, "response").otherwise("revisit"), LINE_END,
        "WARC-Record-ID: <", ID_PREFIX, name, ">", LINE_END, "WARC-Date: ", CAPTURE_DATE, LINE_END,
        "WARC-Target-URI: ", F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " "), LINE_END, "WARC-Payload-Digest: sha1:", sha1, LINE_END,
        F.when(is_response, "").otherwise(revisit),
        "Content-Type: application/http; msgtype=response", LINE_END, "Content-Length: ", length.cast("string"), LINE_END, LINE_END, http,
    )


def write_archive(pages: DataFrame, folder: str) -> None:
    """Write ``folder``/payloads (content_key, payload) and ``folder``/headers (content_key, header)."""
    payload = F.coalesce(pages["html"].cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("content_key", F.sha2("payload", 256))
    keyed.groupBy("content_key").agg(F.first("payload").alias("payload")).write.mode("overwrite").parquet(f"{folder}/payloads")
    facts = written(
        keyed.select("page_id", "url", "content_key", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1")),
        "page-facts",
    )
    holders = facts.groupBy("content_key").agg(F.max("page_id").alias("holder"))
    is_response = F.coalesce(F.col("page_id") == F.col("holder"), F.col("holder").isNull())
    header = header_text(F.col("page_id"), F.col("url"), F.col("size"), F.col("sha1"), F.col("holder"), is_response)
    headers = facts.join(holders, "content_key").select("content_key", header.cast("binary").alias("header"))
    headers.write.mode("overwrite").parquet(f"{folder}/headers")


def _verified(payloads: DataFrame) -> DataFrame:
    """The store, failing where bytes don't have their digest."""
    good = F.sha2("payload", 256) == F.col("content_key")
    return payloads.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("stored bytes differ from digest "), F.col("content_key"))).cast("binary")))


def _field(name: str, pattern: str) -> Column:
    found = F.regexp_extract(F.col("header_text"), rf"\r\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def parsed_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Header rows with their fields."""
    headers = spark.read.parquet(f"{folder}/headers").withColumn("header_text", F.col("header").cast("string"))
    return headers.select(
        "content_key",
        "header",
        _field("WARC-Record-ID", f"<{ID_PREFIX}(-?[0-9]+)>").cast("long").alias("page_id"),
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Target-URI", r"([^\r]*)").alias("url"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("payload_digest"),
        _field("WARC-Refers-To", f"<{ID_PREFIX}(-?[0-9]+)>").cast("long").alias("refers_to"),
    )


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, size and digest taken from the stored payload of its key."""
    store = _verified(spark.read.parquet(f"{folder}/payloads"))
    facts = store.select("content_key", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("stored_digest"))
    same = F.col("stored_digest") == F.col("payload_digest")
    digest = F.when(same, F.col("stored_digest")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ at "), F.col("content_key"))))
    return parsed_headers(spark, folder).join(facts, "content_key").select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Original records, byte for byte: header, payload (of responses), two line ends."""
    head = parsed_headers(spark, folder)
    store = _verified(spark.read.parquet(f"{folder}/payloads"))
    end = F.lit((LINE_END * 2).encode())
    responses = head.where(F.col("record_type") == "response").join(store, "content_key").select("page_id", "record_type", F.concat("header", "payload", end).alias("record"))
    revisits = head.where(F.col("record_type") == "revisit").select("page_id", "record_type", F.concat("header", end).alias("record"))
    return responses.unionByName(revisits)


def pages_back(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url and payload of every record, revisits included."""
    store = _verified(spark.read.parquet(f"{folder}/payloads"))
    return parsed_headers(spark, folder).join(store, "content_key").select("page_id", "url", "payload")
