"""WARC: a content-addressed archive of pages.

Writing splits every record in two: the exact record header goes to ``headers`` (one row per page), the
payload bytes go to ``payloads`` once per distinct content, addressed by SHA-256. Of records with equal
payloads of at least ``min_bytes`` bytes the one with the largest ``page_id`` is the response, the others
are revisits that refer to it. Reading joins headers with payloads, checks each payload against both of its
digests and its stated length (a mismatch fails the job), and parses the records' own header lines.
``export`` writes the same records as plain WARC text files.

Only DataFrame functions are used. The payload that is kept is chosen by an aggregate that combines before
the shuffle and a join on (digest, page_id), so a content that a third of all pages share is never gathered.

Defined results: a null html is an empty payload; a null page_id ranks below all others and can only be a
response among records that have none; records that tie on the largest page_id are all responses; a null url
has no target line, and line breaks in a url are written as %0D and %0A. Columns beyond page_id, url and
html are ignored; an empty table makes an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.tables import shared_path

CRLF = "\r\n"
NO_PAGE = -(1 << 63)  # ranks a null page_id below all others
DATE = "2024-01-01T00:00:00Z"  # the tables hold no crawl time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Digits of base 32 as Spark's conv() writes them, and the alphabet of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base 32 of a hexadecimal digest whose length is a multiple of five digits."""
    parts = [
        F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)
    ]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, its digests and length, and whether the record is a response."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload")).withColumns(
        {"address": F.sha2("payload", 256), "digest": base32_of_hex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    return base.withColumn("pooled", F.col("payload_bytes") >= min_bytes)


def _header(kind: Column, revisit: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    identity = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        F.when(F.col("page_id").isNotNull(), line("WARC-Record-ID", identity)).otherwise(F.lit("")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(F.lit("")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("keeper").cast("string"), F.lit(">"))),
                line("WARC-Profile", F.lit(PROFILE)),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Write ``path``/headers and ``path``/payloads."""
    found = records(pages, min_bytes)
    thin = found.drop("payload", "url")
    keepers = thin.filter("pooled").groupBy("address").agg(F.max("page_id").alias("keeper"))
    headers = found.select("page_id", "url", "address", "digest", "payload_bytes", "pooled").join(keepers, "address", "left")
    revisit = F.col("pooled") & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    headers.select(
        F.col("address"), "payload_bytes", "digest", _header(kind, revisit).alias("header")
    ).write.option("compression", "zstd").parquet(f"{path}/headers")
    # one row per content, taken from one page; the keys are plain numbers, so dropping ties needs no second exchange
    number = F.coalesce("page_id", F.lit(NO_PAGE))
    first = thin.groupBy("address").agg(F.max(number).alias("keeper")).withColumnRenamed("address", "of")
    kept = found.select(number.alias("number"), "address", "payload").join(
        first, (F.col("address") == F.col("of")) & (F.col("number") == F.col("keeper"))
    )
    kept.dropDuplicates(["address", "number"]).select("address", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record rebuilt: header, payload bytes, and the fields that its header lines state."""
    headers = spark.read.schema("address string, payload_bytes long, digest string, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    checked = payloads.select(
        F.col("address").alias("stored_as"),
        "payload",
        base32_of_hex(F.sha1("payload")).alias("stored_digest"),
        F.octet_length("payload").cast("long").alias("stored_bytes"),
        (F.sha2("payload", 256) == F.col("address")).alias("intact"),
    )
    joined = headers.join(checked, F.col("address") == F.col("stored_as"), "left")
    sound = F.coalesce(
        F.col("intact") & (F.col("stored_digest") == F.col("digest")) & (F.col("stored_bytes") == F.col("payload_bytes")),
        F.lit(False),
    )
    # the check guards the header: payloads themselves only move where a caller selects them
    header = F.when(sound, F.col("header")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("string"))
    field = lambda name, pattern: F.regexp_extract("header", rf"\r\n{name}: {pattern}\r\n", 1)
    number = lambda text: F.when(text != "", text).cast("long")
    return joined.withColumn("header", header).select(
        number(field("WARC-Record-ID", r"<urn:page:(-?\d+)>")).alias("page_id"),
        F.col("stored_bytes").alias("payload_bytes"),
        field("WARC-Payload-Digest", r"sha1:(\w+)").alias("payload_digest"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        number(field("WARC-Refers-To", r"<urn:page:(-?\d+)>")).alias("refers_to"),
        "header",
        "payload",
    )


def export(spark: SparkSession, path: str, to: str) -> None:
    """The records as WARC files: header, empty line, payload (none for a revisit), two line breaks."""
    body = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise(F.lit(""))
    read(spark, path).select(F.concat("header", F.lit(CRLF), body).alias("value")).write.option("lineSep", CRLF * 2).text(to)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive the pages in the shared folder and read them back."""
    spark = pages.sparkSession
    return read(spark, write(pages, shared_path(spark, "archive"), min_bytes)).drop("header", "payload")
