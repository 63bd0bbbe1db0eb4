"""Line deduplication across documents.

Lines are exploded and normalised, hashed, and counted per hash; a line held by
several documents stays only in the smallest doc_id.  Only (document, position,
hash) rows are shuffled for that; the texts move once, to meet their dropped
positions, and are put together again by position.

A line's key is the line without ASCII blanks at both ends and with A-Z lower
cased.  Keys shorter than ``min_chars`` code points are never dropped.  Lines
meet by the first 128 bits of their key's SHA-256.

Defined cases: a missing or empty text is one empty line and stays an empty
text; rows without an id act as one document that comes after all others;
repeated rows of one document are treated alike, and a line repeated within one
document is not a duplicate; a document may lose all its lines and stays, with
an empty text.  Columns of the input, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.llm.common import BLANKS, id_order, join_hot, packed_row, table, whole_text
from clonelens.session import staged

MIN_CHARS = 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    only_ascii = F.octet_length(bare) == F.char_length(bare)  # then the fast lower() changes A-Z only
    return F.when(only_ascii, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _document(docs: DataFrame) -> list[Column]:
    return [id_order("doc_id").alias("__d"), F.xxhash64(whole_text()).alias("__t")]


def _lines() -> Column:
    return F.split(whole_text(), "\n", -1)


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__d, __t, __drops): per document that loses lines, their positions from 0."""
    lines = docs.select(*_document(docs), F.posexplode(_lines()).alias("pos", "line"))
    keyed = lines.select("__d", "__t", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.filter(F.char_length("key") >= min_chars)
    digest = F.substring(F.unhex(F.sha2("key", 256)), 1, 16)
    hashed = staged(keyed.select("__d", "__t", "pos", digest.alias("h")), "lines")
    seen = hashed.groupBy("h").agg(
        F.min("__d").alias("first"), F.max("__d").alias("last"), F.count(F.lit(1)).alias("n")
    )
    several = staged(seen.filter("first < last").drop("last"), "repeated-lines")
    met = join_hot(hashed, several, ["h"], "n", hashed.count())
    return met.filter(F.col("__d") > F.col("first")).groupBy("__d", "__t").agg(F.collect_set("pos").alias("__drops"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents as ``__row`` with ``kept`` text, ``n_lines`` (before) and ``n_dropped``."""
    drops = dropped_positions(docs, min_chars)
    rows = docs.select(packed_row(docs), *_document(docs), whole_text().alias("__text")).join(drops, ["__d", "__t"], "left")
    rows = rows.withColumn("__lines", F.split("__text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drops"))
    joined = F.array_join(F.transform(stay, lambda p: F.element_at(F.col("__lines"), p + 1)), "\n")
    return rows.select(
        "__row",
        F.when(F.col("__drops").isNull(), F.col("__text")).otherwise(joined).alias("kept"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's line counts and the digest of what is left of it."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("__row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


OP2_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), lines AS (
  SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM split
), keyed AS (
  SELECT doc_id, line, pos,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              '{_UPPER}', '{_UPPER.lower()}') AS k
  FROM lines
), seen AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= {MIN_CHARS}
  GROUP BY k HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id > s.first, false) AS dropped
  FROM keyed l LEFT JOIN seen s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
