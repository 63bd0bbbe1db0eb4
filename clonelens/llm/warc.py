"""Content-addressed WARC archive: headers and payloads apart, payload bytes stored once.

``write_archive`` writes two tables.  ``headers`` has one row per record: the
exact header bytes (WARC and, for responses, HTTP) and the address of the
payload.  ``payloads`` has one row per distinct payload under its SHA-256; rows
that share an address are checked to agree in length and SHA-1, so a collision
fails the write instead of losing bytes.  ``read_archive`` joins both again into
the records' columns, ``whole_records`` also rebuilds the bytes of each record and
measures them again, and ``export_warc`` writes these as gzip WARC files.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the
largest page_id is the response, the others are revisits that refer to it.

All of a hot payload's records meet it by ``join_hot``; only addresses move
there.  The payloads themselves move twice: to their address, after copies have been
merged within each task, and to the responses that hold them, where the rows of a
hot address are salted.  Revisits fetch no payload.

Defined cases: missing html is an empty payload; a missing url is written as
``urn:unknown``, line ends in a url are percent-encoded; rows without a page_id
are records without a number and revisits of the numbered ones; repeated rows
of the response are responses too; empty tables give an empty archive.  Other
columns of the input are not archived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonelens.functions.skew import salted_join
from clonelens.llm.common import join_hot, table
from clonelens.session import staged, staging_root

MIN_REVISIT = 1000
_RECORD_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_END = "\r\n\r\n"


def _url(column: Column) -> Column:
    clean = F.replace(F.replace(column, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(clean, F.lit("urn:unknown"))


def _record_name(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_RECORD_ID}"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _addressed(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumns(
        {"address": F.sha2("payload", 256), "sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("bigint")}
    )


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, written: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``path``/headers and ``path``/payloads; ``written`` is the date in the headers."""
    rows = _addressed(pages)
    agree = (F.min("sha1") == F.max("sha1")) & (F.min("n_bytes") == F.max("n_bytes"))
    store = rows.groupBy("address").agg(F.first("payload").alias("payload"), agree.alias("agree"))
    store = store.filter(F.coalesce(F.assert_true("agree", "different payloads under one address").isNull(), F.lit(True)))
    store.select("address", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    slim = staged(rows.drop("payload"), "warc-index")
    groups = slim.groupBy("address").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    met = join_hot(slim, staged(groups, "warc-groups"), ["address"], "n", slim.count())
    revisit = (F.col("n_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    http = F.concat(F.lit(_HTTP), F.col("n_bytes").cast("string"), F.lit(_END))
    block = F.when(revisit, 0).otherwise(F.octet_length(http) + F.col("n_bytes"))
    refers = F.concat(F.lit("WARC-Refers-To: "), _record_name(F.col("response_id")), F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_name(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), _url(F.col("url")),
        F.lit(f"\r\nWARC-Date: {written}\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.lit("\r\n"), F.when(revisit, refers).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(_END),
        F.when(revisit, "").otherwise(http),
    )
    met.select("address", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    """A field of the WARC header, from its line (lines end with \\r\\n); the HTTP header comes after a blank line."""
    return F.regexp_extract("warc", rf"(?md)^{name}: ([^\r\n]*)\r$", 1)


def _holds(condition: Column, message: str) -> Column:
    """A filter that keeps every row and fails the job where the condition does not hold."""
    return F.coalesce(F.assert_true(condition, message).isNull(), F.lit(True))


def _number(name: str) -> Column:
    found = F.regexp_extract(_field(name), rf"^<{_RECORD_ID}(-?\d+)>$", 1)
    return F.when(found != "", found.cast("bigint"))


def _archived(spark: SparkSession, path: str) -> DataFrame:
    """``read_archive`` with ``__row``, a number of the stored header row to salt by."""
    headers = spark.read.schema("address string, header binary").parquet(f"{path}/headers")
    headers = headers.withColumn("__row", F.monotonically_increasing_id())
    payloads = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    uses = headers.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    stored = payloads.select(
        "address", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")
    )
    stored = staged(stored.join(uses, "address"), "warc-stored")
    parsed = headers.withColumn("warc", F.substring_index(F.decode("header", "UTF-8"), _END, 1))
    parsed = parsed.withColumn("warc", F.concat("warc", F.lit("\r\n")))
    total = headers.count()
    met = join_hot(parsed, stored, ["address"], "n", total)
    met = met.filter(_holds(F.regexp_extract(_field("WARC-Payload-Digest"), r"^sha1:([0-9a-f]{40})$", 1) == F.col("payload_digest"), "a payload differs from its digest"))
    return met.select(
        _number("WARC-Record-ID").alias("page_id"), "payload_bytes", "payload_digest",
        _field("WARC-Type").alias("record_type"), _number("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Target-URI").alias("url"), "address", "header", "__row",
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, parsed from its header and joined with its payload's measures.

    ``payload_bytes`` and ``payload_digest`` are measured on the stored bytes and
    must agree with the digest in the header.
    """
    return _archived(spark, path).drop("__row")


def whole_records(spark: SparkSession, path: str) -> DataFrame:
    """``read_archive`` with ``record``, the bytes of each WARC record.

    A response's payload follows its header, a revisit has none.  For responses
    ``payload_bytes`` and ``payload_digest`` are measured on the payload's place
    in the rebuilt record and must agree with the stored ones.
    """
    rows = _archived(spark, path)
    payloads = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    end = F.lit(_END.encode())
    full = salted_join(rows.filter("record_type = 'response'"), payloads, "address", "__row")
    full = full.withColumn("record", F.concat("header", "payload", end)).drop("payload")
    start = F.octet_length("header")
    inside = F.substring("record", start + 1, F.octet_length("record") - start - len(_END))
    full = full.withColumns({"__bytes": F.octet_length(inside).cast("bigint"), "__digest": F.sha1(inside)})
    same = (F.col("__bytes") == F.col("payload_bytes")) & (F.col("__digest") == F.col("payload_digest"))
    full = full.filter(_holds(same, "a record differs from its payload"))
    full = full.withColumns({"payload_bytes": F.col("__bytes"), "payload_digest": F.col("__digest")}).drop("__bytes", "__digest")
    bare = rows.filter("record_type <> 'response'").withColumn("record", F.concat("header", end))
    return full.unionByName(bare.select(*full.columns)).drop("__row")


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """Write the archive's records as gzip WARC files, one per partition.

    The blank lines that end a record are the writer's line separator, so a file
    is the records' bytes one after another.  Payloads are UTF-8, as ``write_archive`` makes them.
    """
    record = F.decode(F.substring("record", F.lit(1), F.octet_length("record") - len(_END)), "UTF-8")
    lines = whole_records(spark, path).select(record.alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", _END).text(out)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to an archive, read back and rebuilt as whole records."""
    path = f"{staging_root(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return whole_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = f"""
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), groups AS (
  SELECT html, max(page_id) AS last FROM sized GROUP BY html
)
SELECT s.page_id, s.payload_bytes, sha1(s.html) AS payload_digest,
  CASE WHEN s.payload_bytes >= {MIN_REVISIT} AND s.page_id <> g.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN s.payload_bytes >= {MIN_REVISIT} AND s.page_id <> g.last THEN g.last END AS refers_to
FROM sized s JOIN groups g ON s.html = g.html
"""
