"""Content-addressed WARC archive.

``write_archive`` stores two tables below one folder of the shared store:
``payloads`` (SHA-256, bytes), each distinct payload once, and ``headers``, the
exact WARC header block of every record with the SHA-256 of its payload.
``read_archive`` joins them back into whole records and verifies each payload
against its digest, failing loudly on a mismatch. ``export_warc`` writes the
records as plain WARC/1.1 files.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one
with the largest page id is the response and the others revisit it; smaller
ones are all responses. A null payload is the empty one. Rows that repeat the
largest page id of their payload are all responses; a null page id counts as
the smallest. Line ends and other control characters of a url are
percent-encoded in its header; a null url has no header line. An empty table
gives an empty archive; other columns are ignored.

A payload's group is pre-aggregated to one row (its largest page id) before the
join back, so a payload that a third of all rows share costs no large group;
the joins are plain equi-joins that AQE can split. Record ids are unique: they
hold a row's own number beside its page id, which may be of any type that casts
to a string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footgrid.llm.common import new_folder

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The two alphabets of base 32 (RFC 4648): extended hex, which conv() gives, and the standard one.
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Warc:
    min_revisit_bytes: int = 0
    date: str = "2024-01-01T00:00:00Z"
    content_type: str = "text/html; charset=utf-8"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are four groups of 40 bits, each eight digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), BASE32_HEX, BASE32)


def _record_uri(page_id: Column, row: Column) -> Column:
    """A record's id: the page id, percent-encoded (``~`` for null, which that never gives), and the row's number."""
    return F.concat(F.lit("<urn:footgrid:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("~")), F.lit(":"), row.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def header_block(config: Warc) -> Column:
    """The record's exact header, without the empty line that ends it."""
    revisit = F.col("record_type") == "revisit"
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F\x7F]", "%3F")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_uri(F.col("page_id"), F.col("row"))),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Date", F.lit(config.date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_uri(F.col("refers_to"), F.col("response.row"))), F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}"))).otherwise(F.lit("")),
        _line("Content-Type", F.lit(config.content_type)),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
    )


def hashed(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, row, n_bytes, sha1, sha256) of every row; row: a number of its own."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row")).withColumns({
        "n_bytes": F.octet_length("payload").cast("long"),
        "sha1": base32_sha1(F.col("payload").cast("binary")),
        "sha256": F.sha2(F.col("payload").cast("binary"), 256),
    })


def records(pages: DataFrame, config: Warc = Warc()) -> DataFrame:
    """(page_id, url, row, n_bytes, sha1, sha256, response, record_type, refers_to) of every row; payloads stay behind."""
    rows = hashed(pages).drop("payload")
    leaders = rows.groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("response"))
    revisit = (F.col("n_bytes") >= config.min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("response.page_id"))
    return (
        rows.join(leaders, "sha256")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("response.page_id")))
    )


def write_archive(pages: DataFrame, path: str, config: Warc = Warc()) -> str:
    """Write the archive of ``pages`` (page_id, url, html) below ``path``.

    Only ``payloads`` shuffles bytes of payloads: once, after each task has
    dropped the copies that it saw itself.
    """
    records(pages, config).select("sha256", F.concat(header_block(config), F.lit(CRLF)).alias("header")).write.parquet(f"{path}/headers")
    hashed(pages).select("sha256", "payload").dropDuplicates(["sha256"]).write.parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, sha256, payload_bytes, payload_sha1) of every record; a revisit gets the payload it refers to.

    Each stored payload is verified against its digest and measured once, where
    it is read, however many records share it; whoever asks for no payloads
    shuffles none.
    """
    headers = spark.read.schema("sha256 string, header string").parquet(f"{path}/headers")
    stored = spark.read.schema("sha256 string, payload string").parquet(f"{path}/payloads")
    data = F.col("payload").cast("binary")
    right = F.sha2(data, 256) == F.col("sha256")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256")))
    verified = stored.select(
        "sha256", F.when(right, F.col("payload")).otherwise(wrong).alias("payload"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.concat(base32_sha1(data), F.when(right, "").otherwise(wrong)).alias("payload_sha1"),
    )
    missing = F.raise_error(F.concat(F.lit("no payload for "), F.col("sha256")))
    return headers.join(verified, "sha256", "left").withColumn("payload_sha1", F.when(F.col("payload_sha1").isNull(), missing).otherwise(F.col("payload_sha1")))


def header_value(name: str, pattern: str = "([^\r\n]*)") -> Column:
    """A header line's value, null if there is none."""
    return F.nullif(F.regexp_extract("header", f"\r\n{name}: {pattern}\r\n", 1), F.lit(""))


def parsed(archive: DataFrame, kind: str = "long") -> DataFrame:
    """The archive's records with the fields of their headers; kind: the type of page ids."""

    def page(name: str) -> Column:
        return F.url_decode(F.nullif(F.split_part(header_value(name), F.lit(":"), F.lit(4)), F.lit("~"))).cast(kind)

    return archive.select(
        page("WARC-Record-ID").alias("page_id"), "payload_bytes",
        F.when(header_value("WARC-Payload-Digest", "sha1:([A-Z2-7]*)") == F.col("payload_sha1"), F.col("payload_sha1"))
        .otherwise(F.raise_error(F.lit("payload does not match its header's digest"))).alias("payload_digest"),
        header_value("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
    )


def export_warc(archive: DataFrame, path: str) -> None:
    """Plain WARC files: header, empty line, block, two line ends; a revisit's block is empty."""
    block = F.when(header_value("WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    archive.select(F.concat("header", block).alias("value")).write.text(path, lineSep=CRLF + CRLF)


def round_trip(pages: DataFrame, config: Warc = Warc()) -> DataFrame:
    """Write the archive of ``pages`` to the shared folder, read it back and give its records' fields."""
    path = write_archive(pages, new_folder(pages.sparkSession, "warc"), config)
    return parsed(read_archive(pages.sparkSession, path), pages.schema["page_id"].dataType.simpleString())
