"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again for the next one.  All but the last return the
columns of ``documents``; the last returns one row per packed piece.

1. ``language_id``: documents without a letter or without a leading language go.
2. ``line_dedup``: lines that an earlier document holds are cut out of the texts.
3. ``simhash``: one document of each group of near-duplicates stays; two are linked
   if their five-word shingles have a Jaccard similarity of 0.8 or more.
4. ``mixing``: sources are brought to their target weights; a document may stay
   several times, as equal rows, or not at all.
5. ``packing``: every row is tokenized and cut into sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonelens.llm import language, line_dedup, mixing, near_texts, packing, ship_worker_code
from clonelens.session import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_worker_code()
    return language.keep_known(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; ``n_chars`` follows the text."""
    own = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    out = line_dedup.dedup_lines(docs)
    return out.select(*[own.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_worker_code()
    return near_texts.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_worker_code()
    return packing.digest(packing.pack(docs, packing.default_tokenizer()))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("simhash", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Language prediction and fingerprints are not expressible in SQL; a brute-force version is tested instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
