"""A content-addressed WARC archive: payloads once, exact record headers apart, records rebuilt by a join.

``payloads``: sha256 (the key), payload, holder (smallest page_id and its record's name). ``headers``: sha256, header
(the record's exact header bytes, up to and with the empty line). A record is its header, its payload if it is a
response, and two line ends. Both tables are Parquet in a folder of any store that Spark can write. Whatever is read
back comes from records put together in this way, of payloads that have the digest they are kept under.

Scale: payloads are grouped by digest with map-side combination, so a payload of a third of all pages is shuffled once
per task. The joins on the digest have plain exchanges, so adaptive execution splits that key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.shared import shared_dir

#: The digits of conv() in base 32, and those of RFC 4648.
CONV_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits make four of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, i + 1, 5), 16, 32), 4, "0") for i in range(0, 40, 5)]
    return F.translate(F.upper(F.concat(*parts)), CONV_32, RFC_32)


def _safe(value: Column) -> Column:
    """A header value on one line."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive ``pages`` (page_id, url, html; other columns are ignored) under ``path``, one record per row.

    Null html: an empty payload. Of equal payloads of at least ``revisit_bytes`` the smallest page_id is the response
    and others are revisits of it; smaller ones are all responses. Rows that repeat the smallest page_id with its
    payload are responses too. A null page_id comes after all others, and its record names no page. Null url: no
    target field. A record is named by page_id, url and payload, so rows equal in all three make equal records.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    rows = rows.withColumn("name", F.lower(F.hex(F.xxhash64("url", "sha256"))))
    check = F.xxhash64("payload")
    groups = rows.groupBy("sha256").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "name"))).alias("holder"), F.first("payload").alias("payload"), F.min(check).alias("_low"), F.max(check).alias("_high"))
    clash = F.when(F.col("_low") != F.col("_high"), F.raise_error(F.concat(F.lit("different payloads have SHA-256 "), "sha256")))
    groups.select(F.coalesce(clash.cast("string"), F.col("sha256")).alias("sha256"), "holder", "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")

    spark = pages.sparkSession
    holders = spark.read.parquet(f"{path}/payloads").select("sha256", "holder")
    facts = rows.select("page_id", "url", "name", "sha256", F.octet_length("payload").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    known = facts.join(holders, "sha256")
    again = (F.col("bytes") >= revisit_bytes) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder.page_id"))
    named = lambda c, name: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(":"), name, F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", named("page_id", "name")),
        F.coalesce(line("WARC-Target-URI", _safe(F.col("url"))), F.lit("")),
        F.lit(f"WARC-Date: {date}{END}"),
        F.when(again, F.concat(line("WARC-Refers-To", named("holder.page_id", "holder.name")), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.lit(f"Content-Type: text/html{END}"),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(END),
    )
    known.select("sha256", F.encode(header, "UTF-8").alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Each record again: record (its exact bytes, put together by a join) and, read from these bytes, page_id,
    record_type, refers_to, payload_digest and header; payload (the full one, for revisits too) and sha256. Fails where
    a stored payload does not have the digest it is kept under or the one its record states, or a record's length is
    not the one it states."""
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    records = spark.read.parquet(f"{path}/headers").join(payloads, "sha256")
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("a payload is not that of "), "sha256")).cast("binary"))
    records = records.withColumn("payload", sound)
    response = F.instr(F.decode("header", "UTF-8"), f"{END}WARC-Type: response{END}") > 0
    whole = F.concat("header", F.when(response, F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n"))
    records = records.select("sha256", "payload", whole.alias("record"), F.octet_length("header").alias("_size"))

    text = F.decode(F.substring("record", F.lit(1), F.col("_size")), "UTF-8")
    field = lambda name, of: F.regexp_extract(text, rf"\r\n{name}: {of}\r\n", 1)
    number = lambda name: F.nullif(field(name, "<urn:page:(-?[0-9]+):[0-9a-f]+>"), F.lit("")).cast("long")
    stated = field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")
    held = (stated == base32_sha1(F.col("payload"))) & (field("Content-Length", "([0-9]+)").cast("long") == F.octet_length("record") - F.col("_size") - 4)
    digest = F.when(held, stated).otherwise(F.raise_error(F.concat(F.lit("a record does not state the digest and length of "), "sha256")).cast("string"))
    return records.select(
        number("WARC-Record-ID").alias("page_id"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        digest.alias("payload_digest"),
        F.substring("record", F.lit(1), F.col("_size")).alias("header"),
        "payload",
        "record",
        "sha256",
    )


def archived(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """``pages`` written to an archive in the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}"
    write_archive(pages, path, revisit_bytes)
    return read_archive(spark, path)
