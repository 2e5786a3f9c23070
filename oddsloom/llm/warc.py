"""A content-addressed WARC archive: payload bytes once, record headers apart, records by a join.

An archive is a folder with two tables.  ``payloads`` has each distinct payload once, under its
SHA-256; equal digests with unequal bytes would give two rows there, and records of such a key are read
as not verified.  ``records`` has the exact header bytes of every record and the digest of its payload.  The
original records come back by joining the two.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, scratch

#: Payloads of at least so many bytes are revisited where they recur.
REVISIT_BYTES = 1000
#: Fixed values of WARC/1.1.
CRLF = "\r\n"
#: Characters that end a line somewhere, as they are written in a URL.
LINE_ENDS = {"\n": "%0A", "\x0b": "%0B", "\x0c": "%0C", "\r": "%0D", "\x1c": "%1C", "\x1d": "%1D", "\x1e": "%1E", "\x85": "%C2%85", "\u2028": "%E2%80%A8", "\u2029": "%E2%80%A9"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column) -> Column:
    """A record's URN, a function of its page_id."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))


def _headers(date: str) -> Column:
    """The header block of a record and the HTTP block before its payload, line by line."""
    length = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    content = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    # A line break within a URL would end its header line.
    uri = F.col("url")
    for end, written in LINE_ENDS.items():
        uri = F.replace(uri, F.lit(end), F.lit(written))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), content.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), http)


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> str:
    """Write a record for each row of ``pages`` (page_id long, url string, html string) below ``path``.

    The payload is html in UTF-8; null counts as empty.  Of records with equal payloads of at least
    ``revisit_bytes`` bytes, those with the largest page_id are responses and the others revisit it;
    a row that repeats the response's page_id is a response too.  Smaller payloads are stored once as
    well, but all their records are responses.  Null urls give no WARC-Target-URI line.  A null
    page_id is never the largest; payloads that only such rows have get responses.  Characters of a url
    that end a line are written in percent code (``LINE_ENDS``), so a url cannot add header lines.
    Payloads of any length are stored whole; columns besides the three are ignored.  An empty table
    gives an archive without records.
    """
    content = pages.select("page_id", "url", body("html").cast("binary").alias("payload"))
    keyed = content.withColumn("payload_key", F.sha2("payload", 256))
    # Grouping by the bytes themselves verifies the digest; copies combine in the map tasks.
    keyed.groupBy("payload_key", "payload").agg(F.max("page_id").alias("last_page_id")).write.parquet(f"{path}/payloads")
    held = pages.sparkSession.read.parquet(f"{path}/payloads").select("payload_key", "last_page_id")
    small = keyed.select("page_id", "url", "payload_key", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    again = (F.col("payload_bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("last_page_id"))
    typed = small.join(held, "payload_key").withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("last_page_id")))
    typed.select("page_id", "payload_key", _headers(date).alias("header")).write.parquet(f"{path}/records")
    return path


def field(name: str) -> Column:
    """A named field of the WARC header block; null where it is absent.  Lines end with CRLF and with nothing else."""
    block = F.concat(F.substring_index("header", CRLF + CRLF, 1), F.lit(CRLF))
    found = F.regexp_extract(block, rf"(?s)\r\n{name}: (.*?)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of an archive, from its header bytes and from the stored payload bytes.

    Columns: page_id, payload_bytes, payload_digest (SHA-1 of the stored bytes), record_type,
    refers_to (null where the header's is no number), record_id, verified (the stored bytes have the
    digests that key and header name, and no others are stored under that key).
    """
    stored = spark.read.parquet(f"{path}/payloads").select("payload_key", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), (F.sha2("payload", 256) == F.col("payload_key")).alias("sound"))
    # By the key of the join, so this adds no exchange.
    payloads = stored.groupBy("payload_key").agg(F.min(F.struct("payload_bytes", "payload_digest", "sound")).alias("p"), F.count("*").alias("n"))
    payloads = payloads.select("payload_key", "p.payload_bytes", "p.payload_digest", (F.col("p.sound") & (F.col("n") == 1)).alias("sound"))
    heads = spark.read.parquet(f"{path}/records").select("page_id", "payload_key", field("WARC-Type").alias("record_type"), field("WARC-Refers-To-Page").try_cast("long").alias("refers_to"), field("WARC-Record-ID").alias("record_id"), field("WARC-Payload-Digest").alias("named"))
    both = heads.join(payloads, "payload_key")
    verified = F.col("sound") & (F.col("named") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", verified.alias("verified"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the bytes of the whole WARC record) and payload (also for revisits), by a join."""
    heads = spark.read.parquet(f"{path}/records")
    payloads = spark.read.parquet(f"{path}/payloads").select("payload_key", "payload")
    body_of = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header").cast("binary"), body_of, F.lit((CRLF + CRLF).encode()))
    return heads.join(payloads, "payload_key").select("page_id", record.alias("record"), "payload")


def _members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Header block and content of each record of a WARC file, gzipped or plain."""
    file = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    while line := file.readline():
        if not line.strip():
            continue
        lines = [line]
        while (line := file.readline()).strip():
            lines.append(line)
        header = b"".join(lines).decode("utf-8", "replace")
        named = (x.partition(":") for x in header.split("\n")[1:])
        length = next((int(v) for k, _, v in named if k.strip().lower() == "content-length"), 0)
        yield header, file.read(length)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (``.warc`` or ``.warc.gz``): file, header, content.  A file is one task's work."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, raw in zip(batch["path"], batch["content"], strict=True):
                for header, content in _members(bytes(raw)):
                    yield pd.DataFrame({"file": [file], "header": [header], "content": [content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, header string, content binary")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, scratch(spark, "warc")))
