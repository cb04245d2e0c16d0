"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records by joins.

`write_archive` gives every page a record. Of records with equal payloads the one with the smallest page_id is
a response, the others are revisits that refer to it. The archive is two tables in the shared folder:
`payloads` (digest, frame) with every payload once, compressed, and `headers` (record, digest, header) with the bytes of
every record's header block. `read_archive` verifies each stored payload against its digest, joins the two and
returns the records as they were; `parse_records` reads a record back from its bytes alone.

Payloads are told apart by SHA-256, and every record's length is checked on reading; the SHA-1 of the WARC header
is computed from the same bytes. Digests and payloads are combined before they are shuffled, so a payload that a
third of the pages share is one row a task. Payloads are compressed one by one when they are read, and travel and
rest that way until a record is put together again.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.llm.common import stored

# Payloads below this length are always responses.
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The digits of Base32, in order of value, beside those of Spark's number conversion.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass
class Archive:
    headers: DataFrame
    payloads: DataFrame


def base32(hex_digest: Column) -> Column:
    """Base32 of a 160-bit hex digest: five hex digits are four Base32 digits."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), CONV_DIGITS, BASE32_DIGITS)


@F.pandas_udf(T.BinaryType())
def compressed(payloads: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=3).compress
    return pd.Series([pack(p) for p in payloads], dtype=object)


@F.pandas_udf(T.BinaryType())
def decompressed(frames: pd.Series) -> pd.Series:
    """The payloads; null for a frame that is missing or damaged."""
    unpack = zstandard.ZstdDecompressor().decompress

    def payload(frame: bytes | None) -> bytes | None:
        try:
            return None if frame is None else unpack(frame)
        except zstandard.ZstdError:
            return None

    return pd.Series([payload(f) for f in frames], dtype=object)


def record_uri(record: Column) -> Column:
    """A urn:uuid from a hash of the record's place in the archive."""
    digest = F.md5(F.concat(F.lit("record:"), record.cast("string")))
    parts = [F.substring(digest, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header_block() -> Column:
    """The header of a record, CRLF ended, with the empty line that closes it. Line breaks in a url are escaped."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "%", "%25")
    url = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    kind = F.when(F.col("is_response"), F.lit("response")).otherwise(F.lit("revisit"))
    revisit = F.when(
        ~F.col("is_response"),
        F.concat(
            line("WARC-Refers-To", record_uri(F.col("owner"))),
            F.when(F.col("owner_page").isNotNull(), line("X-Refers-To-Page", F.col("owner_page").cast("string"))).otherwise(""),
            line("WARC-Profile", F.lit(PROFILE)),
        ),
    ).otherwise(F.lit(""))
    content = F.when(F.col("is_response"), F.col("payload_bytes")).otherwise(F.lit(0))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_uri(F.col("record"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        revisit,
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", content.cast("string")),
        F.lit("\r\n"),
    ).cast("binary")


def write_archive(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> Archive:
    """Archive every row of `pages`.

    A null html is an empty payload; a null url or page_id leaves its header line out. A null page_id comes
    after all others when the owner of a payload is chosen; of rows with the same id the one read first owns
    it, the others revisit. Other columns are ignored; an empty table gives empty tables.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # The id of a record is its place in the input; it is written once, so a later retry cannot change it.
    digests = stored(
        pages.select(
            "page_id", "url", F.monotonically_increasing_id().alias("record"), F.sha2(payload, 256).alias("digest"),
            base32(F.sha1(payload)).alias("sha1"), F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        ),
        "warc-digests",
    )
    order = F.struct(F.col("page_id").isNull(), "page_id", "record")
    owners = digests.groupBy("digest").agg(F.min(order).alias("_owner"))
    owners = stored(owners.select("digest", "_owner.record", "_owner.page_id"), "warc-owners").select(
        "digest", F.col("record").alias("owner"), F.col("page_id").alias("owner_page")
    )
    alone = (F.col("record") == F.col("owner")) | (F.col("payload_bytes") < min_revisit_bytes)
    headers = digests.join(owners, "digest").withColumn("is_response", alone).select(
        "record", "digest", "payload_bytes", header_block().alias("header")
    )
    # Copies of a payload are dropped in the map tasks before the rest are shuffled.
    frames = pages.select(F.sha2(payload, 256).alias("digest"), compressed(payload).alias("frame"))
    payloads = frames.groupBy("digest").agg(F.first("frame").alias("frame"))
    return Archive(stored(headers, "warc-headers"), stored(payloads, "warc-payloads"))


def open_archive(spark: SparkSession, headers: str, payloads: str) -> Archive:
    return Archive(spark.read.parquet(headers), spark.read.parquet(payloads))


def read_archive(archive: Archive) -> DataFrame:
    """(record, header, payload) of every record. A payload that is lost or fails its digest raises."""
    joined = archive.headers.join(archive.payloads, "digest", "left").withColumn("payload", decompressed("frame"))
    sound = (F.octet_length("payload") == F.col("payload_bytes")) & (F.sha2("payload", 256) == F.col("digest"))
    checked = F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("archive: payload lost or damaged: "), F.col("digest"))).cast("binary")
    )
    return joined.select("record", "header", checked.alias("payload"))


def record_bytes(records: DataFrame) -> DataFrame:
    """(record, content): a response with its payload, a revisit without, each ended by two line ends."""
    body = F.when(header_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("record", F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")).alias("content"))


def header_field(name: str) -> Column:
    """A field of the header block, or null."""
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?md)^{name}: ([^\r\n]*)\r$", 1)
    return F.when(found != "", found)


def parse_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read from headers and payloads.

    Digest and length are those of the payload that the archive gave back, not what the header says.
    """
    digest = base32(F.sha1("payload"))
    same = (F.concat(F.lit("sha1:"), digest) == header_field("WARC-Payload-Digest"))
    return records.select(
        header_field("X-Page-ID").cast("bigint").alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(same, digest).otherwise(F.raise_error(F.lit("archive: header and payload differ")).cast("string")).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        header_field("X-Refers-To-Page").cast("bigint").alias("refers_to"),
    )


def export_records(records: DataFrame, path: str) -> None:
    """Write the records' bytes as a Parquet table of one binary column `content`, a record a row."""
    record_bytes(records).select("content").write.parquet(path)

