"""A content-addressed web archive: every payload is stored once, under its SHA-256 digest.

An archive is a folder with two Parquet tables. ``payloads`` holds digest and bytes; ``headers`` holds
the exact header block of every record and the digest of its payload. Joining them gives the records
back. Everything is DataFrame functions; payloads are read, deduplicated and joined by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# WARC format values.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT_TYPE = "text/html; charset=utf-8"
BREAK = "\r\n"
# Digits of base 32 as Spark's conv writes them, and as RFC 4648 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32: 40 bits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def _one_line(value: Column) -> Column:
    """White space and control characters, which would break a header line, percent-encoded."""
    for code in (*range(33), 127):
        value = F.replace(value, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return value


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) under ``folder``.

    The payload is the html in UTF-8; null counts as empty. Of records with equal payloads of at
    least ``min_bytes`` bytes the smallest page_id is a response and the others revisit it;
    smaller payloads are all responses. Rows that repeat the smallest page_id are all responses, a
    null page_id is larger than any other, a payload with null ids only has responses only. A
    null url has no target line. Other columns are ignored.
    """
    records = pages.select(
        F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # Equal digests must mean equal bytes: two more hashes of other kinds have to agree.
    alike = (F.min("check") == F.max("check")) & (F.min("bytes") == F.max("bytes"))
    (
        records.withColumns({"check": F.xxhash64("payload"), "bytes": F.octet_length("payload")})
        .groupBy("digest")
        .agg(
            F.when(alike, F.first("payload"))
            .otherwise(F.raise_error(F.concat(F.lit("different payloads have digest "), F.col("digest"))).cast("binary"))
            .alias("payload"),
            F.min("page_id").alias("first_page"),
        )
        .write.option("compression", "zstd")
        .parquet(f"{folder}/payloads")
    )
    firsts = pages.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "first_page")
    bytes_ = F.octet_length("payload").cast("long")
    heads = records.select("page_id", "url", "digest", bytes_.alias("bytes"), sha1_base32(F.col("payload")).alias("sha1"))
    revisit = (F.col("bytes") >= min_bytes) & (F.coalesce("page_id", F.lit(2**63 - 1)) > F.col("first_page"))
    refers = F.when(revisit, F.col("first_page"))
    header = F.concat(
        F.lit(VERSION + BREAK),
        _line("WARC-Type", F.when(refers.isNull(), "response").otherwise("revisit")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _one_line(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))),
        _line("WARC-Profile", F.when(refers.isNotNull(), PROFILE)),
        _line("Content-Type", F.lit(CONTENT_TYPE)),
        _line("Content-Length", F.when(refers.isNull(), F.col("bytes")).otherwise(0).cast("string")),
        F.lit(BREAK),
    )
    (
        heads.join(firsts, "digest")
        .select("digest", header.alias("header"))
        .write.option("compression", "zstd")
        .parquet(f"{folder}/headers")
    )


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive, put together again by joining headers and payloads.

    Columns: header, payload (the full one, of revisits too), record (the bytes of the WARC record; a
    revisit has an empty block). A header whose payload is missing is an error.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").select("digest", "payload")
    whole = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("no payload for digest "), F.col("digest"))).cast("binary")
    )
    block = F.when(F.col("header").contains(f"{BREAK}WARC-Type: response{BREAK}"), F.col("payload")).otherwise(F.lit(b""))
    return (
        headers.join(payloads, "digest", "left")
        .withColumn("payload", whole)
        .withColumn("record", F.concat(F.col("header").cast("binary"), block, F.lit(2 * BREAK).cast("binary")))
        .select("header", "payload", "record")
    )


def _field(name: str, pattern: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)


def summaries(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records of an archive;
    the digest is computed from the payload and must agree with the header's."""
    digest = sha1_base32(F.col("payload"))
    stated = _field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")
    return records.select(
        _field("WARC-Record-ID", "<urn:page:([^>]*)>").try_cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(digest == stated, digest)
        .otherwise(F.raise_error(F.concat(F.lit("wrong payload for "), F.col("header"))).cast("string"))
        .alias("payload_digest"),
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:([^>]*)>").try_cast("long").alias("refers_to"),
    )
