"""Content-addressed WARC archive as two tables.

``payloads`` holds the bytes of each distinct payload once, under its SHA-256. ``headers`` holds the
exact header bytes of every record (WARC and HTTP header lines) with the key of its payload. Reading
joins the two, verifies the digest of what was stored, and rebuilds the records byte for byte, with the
two empty lines that end a record.

Of records with equal payloads of at least ``LEAST`` bytes, that with the largest page_id is a
response and the others are revisits that refer to it; smaller ones are all responses.

Defined cases: null html is an empty payload; a null url gives the target ``about:blank``, and white
space in a url is percent-encoded; of repeated rows of the largest page_id one is the response; a null
page_id counts as smaller than any other, and where all are null the revisits refer to none by page_id;
every record has an id of its own; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import scratch

LEAST = 1000
#: Records of one payload that a join task meets at most, roughly.
SALT_ROWS = 512
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _record_id(archive: str, page_id, record):
    """The URN of a record: archive, page (empty for null) and the record's number in the archive."""
    return F.concat(F.lit(f"<urn:factloom:{archive}:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), record.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST, date: datetime.datetime | None = None) -> None:
    """Write the archive of (page_id, url, html) rows below ``path``; ``date`` is the records' date, now unless said."""
    archive = uuid.uuid4().hex
    stamp = (date or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", body.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    # the numbers of records are written with them, so later reads agree on them
    digests = hashed.select(F.monotonically_increasing_id().alias("record"), "page_id", "url", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), "key")
    digests = scratch.stored(digests, "warc-digests")
    # only payloads of several records are joined; the copies of a hot one meet as partial aggregates and are dealt over tasks after
    per = digests.groupBy("key", "page_id").agg(F.count(F.lit(1)).alias("rows"), F.max("record").alias("record"))
    groups = per.groupBy("key").agg(F.max(F.struct("page_id", "record", "rows")).alias("first"), F.sum("rows").alias("copies")).where("copies > 1")
    groups = scratch.stored(
        groups.select(F.col("key").alias("hot"), F.col("first.page_id").alias("first_page"), F.col("first.record").alias("first_record"), F.col("first.rows").alias("first_rows"), "copies"), "warc-groups"
    )
    named = scratch.hot_join(digests, groups, F.col("key"), "hot", F.col("record"), "warc-named", 72)
    other = F.coalesce(F.col("record") != F.col("first_record"), F.lit(False))
    revisit = other & (F.col("n") >= least)
    http = F.concat(F.lit(_HTTP), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    target = F.when(F.coalesce("url", F.lit("")) == "", "about:blank").otherwise(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(archive, F.col("page_id"), F.col("record")),
        F.lit(f"\r\nWARC-Date: {stamp}\r\nWARC-Target-URI: "), target, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            _record_id(archive, F.col("first_page"), F.col("first_record")), F.lit(f"\r\nWARC-Refers-To-Date: {stamp}"),
        )).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"), http,
    )
    named.select("page_id", "record", lines.cast("binary").alias("header"), "key", F.coalesce("copies", F.lit(1)).alias("copies")).write.parquet(f"{path}/headers")
    kept = scratch.hot_join(hashed.select("page_id", "key", "payload"), groups, F.col("key"), "hot", F.col("page_id"), "warc-kept", 80)
    copies = F.coalesce("copies", F.lit(1)).alias("copies")
    first = F.col("page_id").eqNullSafe(F.col("first_page"))
    single = kept.where(F.col("hot").isNull() | (first & (F.col("first_rows") == 1))).select("key", "payload", copies)
    repeated = kept.where(first & (F.col("first_rows") > 1)).groupBy("key").agg(F.any_value("payload").alias("payload"), F.max("copies").alias("copies"))
    single.unionByName(repeated).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload, record) of every record; a revisit's record has no payload.

    The payload of a revisit is that of the response it refers to. A stored payload whose digest is
    not its key stops the read.
    """
    headers = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("key"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.hex("key"))).cast("binary")
    )
    salts = F.ceil(F.col("copies") / SALT_ROWS).cast("int")
    stored = stored.select("key", sound.alias("payload"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    headers = headers.withColumn("salt", F.pmod(F.xxhash64("record"), F.ceil(F.col("copies") / SALT_ROWS)).cast("int"))
    whole = headers.join(stored, ["key", "salt"])
    end = F.lit("\r\n\r\n").cast("binary")
    response = F.decode("header", "UTF-8").rlike(r"\AWARC/1\.1\r\nWARC-Type: response\r\n")
    return whole.select("page_id", "header", "payload", F.when(response, F.concat("header", "payload", end)).otherwise(F.concat("header", end)).alias("record"))


def _field(header, name: str):
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive, read it back, and describe each record from what was read."""
    path = path or scratch.folder(pages.sparkSession, "warc")
    write_archive(pages, path)
    read = read_archive(pages.sparkSession, path).select(
        "page_id", F.decode("header", "UTF-8").alias("h"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"),
        F.octet_length("record").alias("n"),
    )
    kind = F.regexp_extract("h", r"\AWARC/1\.1\r\nWARC-Type: (\w+)\r\n", 1)
    refers = F.regexp_extract("h", r"\r\nWARC-Refers-To: <urn:factloom:[0-9a-f]+:([^:\r\n>]*):\d+>\r\n", 1)
    whole = F.when(F.col("sha1") == F.substring_index(_field("h", "WARC-Payload-Digest"), ":", -1), F.col("sha1")).otherwise(
        F.raise_error(F.lit("a record's payload is not the one it names"))
    )
    return read.select(
        "page_id", "payload_bytes", whole.alias("payload_digest"), kind.alias("record_type"),
        F.when(refers != "", refers.cast(pages.schema["page_id"].dataType)).alias("refers_to"),
    )
