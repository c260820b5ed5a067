"""Operator 9, a content-addressed WARC archive.

Payload bytes are stored once by SHA-256, exact record headers are stored apart, and the original records are
put together again by joins of the two; a payload whose digest does not verify when read makes its records
unreadable instead of wrong.  Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the smallest page id is the response, the others are revisits of it.

Payloads move through one partial aggregation by digest, so a payload that a third of all pages share costs
a row a task; decisions move ids and digests only.  When read, a payload joins its responses, which is one row
unless it is tiny; revisits, whose records have no body, join its length alone.

Defined cases: null html is an empty payload; null url gives an empty target; rows that repeat the smallest
id of their payload are all responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import shared_dir

MIN_REVISIT = 100
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def _record_id(page_id: str) -> Column:
    return F.concat(F.lit("<urn:millrace:page:"), F.col(page_id).cast("string"), F.lit(">"))


def record_headers(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A row per page: page_id, digest, record_type, refers_to and the record's exact header block."""
    plain = pages.select("page_id", "url", F.sha2(_payload(), 256).alias("digest"), F.octet_length(_payload()).cast("long").alias("_bytes"))
    firsts = plain.groupBy("digest").agg(F.min("page_id").alias("_first"))
    known = plain.join(firsts, "digest")
    known = known.withColumn("record_type", F.when((F.col("_bytes") >= MIN_REVISIT) & (F.col("page_id") != F.col("_first")), "revisit").otherwise("response"))
    known = known.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("_first")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.coalesce(_record_id("page_id"), F.lit("<urn:millrace:page:>"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", "%0A"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("record_type") == "revisit", line("WARC-Refers-To", _record_id("refers_to"))).otherwise(F.lit("")),
        F.when(F.col("record_type") == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("record_type") == "revisit", "0").otherwise(F.col("_bytes").cast("string"))),
        F.lit(CRLF),
    )
    return known.select("page_id", "digest", "record_type", "refers_to", header.alias("header"))


def payload_store(pages: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload): every distinct payload once."""
    once = pages.select(F.sha2(_payload(), 256).alias("digest"), _payload().alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    return once.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Writes ``path/headers`` and ``path/payloads`` (zstd-compressed Parquet, any Hadoop file system)."""
    for name, rows in (("headers", record_headers(pages, date)), ("payloads", payload_store(pages))):
        rows.write.option("compression", "zstd").parquet(f"{path}/{name}")


def _field(name: str, text: str = "header") -> Column:
    return F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)


def _page(column: Column) -> Column:
    return F.regexp_extract(column, "page:(-?[0-9]+)>", 1).try_cast("long")


def read_archive(spark: SparkSession, path: str, resolve: bool = True) -> DataFrame:
    """The records put together again: page_id, record_type, refers_to and digest parsed from the header block,
    payload_bytes, header, payload and record (the exact bytes of the WARC record).

    With ``resolve`` a revisit bears the payload that it refers to, else null."""
    parts = spark.read.parquet(f"{path}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("binary"))
    stored = parts.select("digest", "payload_bytes", verified.alias("payload"))
    heads = spark.read.parquet(f"{path}/headers").select("header")
    heads = heads.select("header", _page(_field("WARC-Record-ID")).alias("page_id"), _field("WARC-Type").alias("record_type"), _page(_field("WARC-Refers-To")).alias("refers_to"), F.substring(_field("WARC-Payload-Digest"), 8, 64).alias("digest"))
    revisit = F.col("record_type") == "revisit"
    full = heads.filter(~revisit).join(stored, "digest")
    again = heads.filter(revisit).join(stored if resolve else parts.select("digest", "payload_bytes", F.lit(None).cast("binary").alias("payload")), "digest")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.encode("header", "UTF-8"), body, F.lit((CRLF * 2).encode()))
    return full.unionByName(again).select("page_id", "record_type", "refers_to", F.col("digest").alias("payload_digest"), "payload_bytes", "header", "payload", record.alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """From the bytes of WARC records alone: page_id, record_type, refers_to, the digest that the header states, body.

    The header ends at the first empty line; the body has the stated length and two line ends after it."""
    text = F.col("record").cast("string")
    split = records.select(F.substring_index(text, CRLF * 2, 1).alias("_head"), text.alias("_text"))
    split = split.withColumn("header", F.concat("_head", F.lit(CRLF * 2)))
    rest = F.substr("_text", F.length("header") + 1)
    body = F.substr(rest, F.lit(1), F.length(rest) - 2 * len(CRLF))
    whole = (F.octet_length(body) == _field("Content-Length").try_cast("long")) & F.endswith("_text", F.lit(CRLF * 2))
    checked = F.when(whole, body).otherwise(F.raise_error(F.concat(F.lit("record of another length than stated: "), F.col("_head"))).cast("string"))
    return split.select(_page(_field("WARC-Record-ID")).alias("page_id"), _field("WARC-Type").alias("record_type"), _page(_field("WARC-Refers-To")).alias("refers_to"), F.substring(_field("WARC-Payload-Digest"), 8, 64).alias("stated_digest"), checked.alias("body"))


def write_warc_files(records: DataFrame, path: str) -> None:
    """Plain WARC files (gzip) of read-back records through Spark's text writer, one per partition; every record
    ends with two line ends, which the writer adds as its separator."""
    text = F.decode(F.concat(F.encode("header", "UTF-8"), F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))), "UTF-8")
    records.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def op9(spark, sf_dir):
    from .runtime import table

    path = f"{shared_dir(spark)}/millrace/archive-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    parsed = parse_records(read_archive(spark, path, resolve=False))
    # A response's length and digest come from the bytes in its record; a revisit has none and takes them from the payload store.
    size, digest = F.octet_length("body").cast("long"), F.sha2(F.col("body").cast("binary"), 256)
    responses = parsed.filter(F.col("record_type") == "response").select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
    revisits = parsed.filter(F.col("record_type") == "revisit").join(spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("payload_digest"), "payload_bytes"), F.col("stated_digest") == F.col("payload_digest"))
    return responses.unionByName(revisits.select(*responses.columns))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to FROM f
"""
