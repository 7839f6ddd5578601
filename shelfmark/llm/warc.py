"""Content-addressed WARC archive.

An archive is two tables in the shared folder. ``headers`` has the exact header block of every
record and the SHA-256 that addresses its payload; ``payloads`` has each distinct payload once.
A join on the digest gives the original records back, and every payload is hashed again on the
way out, once before the join: bytes that no longer match their address stop the read. A payload
says how many records have it, so the records of a very common one are dealt to several tasks.

Edge cases: a null payload is an empty payload; a null id is written as ``null`` and read back as
null; line breaks in a URL are percent-encoded, so a URL cannot forge a header line; very long
payloads are one value each; rows that repeat an id with the same payload are the same record and
share one role; an empty table gives an empty archive. Extra columns of the input are ignored,
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_hot, materialise

CRLF = "\r\n"
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1. Five hex digits are four base32 digits, without padding."""
    digest = F.sha1(payload)
    blocks = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*blocks)), _HEX32, _BASE32)


def _header_line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(value: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one WARC record per row under `path`.

    Of records with equal payloads of at least `min_revisit_bytes`, the one with the largest id is
    the response and the others are revisits of it; smaller payloads are all responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    heads = pages.select(
        F.col(id_col).cast("bigint").alias("id"),
        url.alias("url"),
        F.octet_length(payload).cast("bigint").alias("n"),
        base32_sha1(payload).alias("sha1"),
        F.sha2(payload, 256).alias("sha256"),
    )
    heads = materialise(heads, "warc-heads")  # hashed once; no payloads in it
    # One row per digest, summed up before the shuffle. A digest shared by payloads of different
    # length or SHA-1 would be a collision: the archive refuses it.
    owners = heads.groupBy("sha256").agg(
        F.max("id").alias("response_id"),
        ((F.min("n") == F.max("n")) & (F.min("sha1") == F.max("sha1"))).alias("sound"),
        F.count("*").alias("times"),
    )
    owners = owners.select(
        "sha256",
        "times",
        F.when(F.col("sound"), F.col("response_id"))
        .otherwise(F.raise_error(F.concat(F.lit("digest collision at "), F.col("sha256"))).cast("bigint"))
        .alias("response_id"),
    )
    revisit = (F.col("n") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("response_id"))
    block = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header_line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header_line("WARC-Record-ID", _urn(F.col("id"))),
        _header_line("WARC-Target-URI", F.col("url")),
        _header_line("WARC-Date", F.lit(date)),
        _header_line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            revisit,
            F.concat(
                _header_line("WARC-Refers-To", _urn(F.col("response_id"))),
                _header_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(""),
        _header_line("Content-Type", F.lit("text/html")),
        _header_line("Content-Length", F.when(revisit, 0).otherwise(F.col("n")).cast("string")),
        F.lit(CRLF),
    )
    owners = materialise(owners, "warc-owners", few=True)
    headers = join_hot(heads, owners, "sha256", "times", "id").select("sha256", block.cast("binary").alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    # Copies meet in the map task already: the partial aggregate keeps one row per digest.
    payloads = pages.select(F.sha2(payload, 256).alias("sha256"), payload.alias("payload")).groupBy("sha256")
    payloads = payloads.agg(F.first("payload").alias("payload"), F.count("*").alias("times"))
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")


def _header_value(name: str, pattern: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), f"\\r\\n{name}: {pattern}\\r\\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, with payloads back in place.

    Columns: page_id, url, record_type, refers_to, payload_bytes, payload_digest, header, payload,
    record (the exact bytes: header block, payload unless a revisit, two line ends).
    """
    headers = spark.read.schema("sha256 string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 string, payload binary, times bigint").parquet(f"{path}/payloads")
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), base32_sha1(F.col("payload"))).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256")))
    )
    stored = payloads.select(
        "sha256",
        "payload",
        checked.alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.coalesce("times", F.lit(1)).alias("times"),
    )
    number = r"<urn:page:(-?\d+)>"
    records = headers.select(
        "sha256",
        "header",
        _header_value("WARC-Record-ID", number).try_cast("bigint").alias("page_id"),
        _header_value("WARC-Target-URI", r"([^\r]*)").alias("url"),
        _header_value("WARC-Type", r"(\w+)").alias("record_type"),
        _header_value("WARC-Refers-To", number).try_cast("bigint").alias("refers_to"),
    )
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return join_hot(records, stored, "sha256", "times", "header").select(
        "page_id",
        "url",
        "record_type",
        "refers_to",
        "payload_bytes",
        "payload_digest",
        "header",
        "payload",
        F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")).alias("record"),
    )
