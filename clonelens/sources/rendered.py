"""Inputs derived from the given tables: code files, leaderboards, scored rows, vectors.

The tables hold no source code, so each ``part`` row is rendered as one small
Python file; every 97th does not parse and many texts repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_INDENT = "CASE WHEN p_partkey % 2 = 0 THEN '    ' ELSE '' END"

CODE_FILES_SQL = f"""
SELECT p_partkey AS file_id, p_brand AS repo,
       p_brand || '/f' || CAST(p_partkey AS VARCHAR(20)) || '.py' AS path,
       repeat('# note' || chr(10), CAST(p_partkey % 4 AS INT)) || 'import os' || chr(10)
    || CASE WHEN p_partkey % 2 = 0 THEN 'class K:' || chr(10) ELSE '' END
    || {_INDENT} || 'def f(x, y):' || chr(10)
    || repeat({_INDENT} || '    t = x + y' || chr(10), CAST(1 + p_size % 7 AS INT))
    || repeat({_INDENT} || '    for q in x:' || chr(10) || {_INDENT} || '        t = t * q' || chr(10), CAST(p_partkey % 3 AS INT))
    || repeat({_INDENT} || '    if y:' || chr(10) || {_INDENT} || '        z = x' || chr(10), CAST(p_partkey % 5 AS INT))
    || {_INDENT} || '    return t' || chr(10)
    || CASE WHEN p_partkey % 97 = 0 THEN ')' || chr(10) ELSE '' END AS content
FROM {{part}}
"""

# Two repositories; one of them holds one different text in about 500, the other equal texts only.
NEARLY_EQUAL_SQL = """
SELECT p_partkey AS file_id, 'r' || CAST(p_partkey % 2 AS VARCHAR(20)) AS repo,
       'r/f' || CAST(p_partkey AS VARCHAR(20)) || '.py' AS path,
       CASE WHEN p_partkey % 1000 = 7 THEN 'y = ' || CAST(p_partkey AS VARCHAR(20)) ELSE 'x = 1' END AS content
FROM {part}
"""

RESULTS_SQL = """
SELECT p_name || '#' || CAST(p_partkey AS VARCHAR(20)) AS model, p_type AS type,
       round(CAST(0.5 AS DOUBLE) + CAST(p_partkey % 499 AS DOUBLE) / CAST(1000 AS DOUBLE), 6) AS accuracy,
       round(CAST(0.5 AS DOUBLE) + CAST(p_partkey % 487 AS DOUBLE) / CAST(1000 AS DOUBLE), 6) AS balanced_accuracy,
       round(CAST(0.5 AS DOUBLE) + CAST(p_partkey % 491 AS DOUBLE) / CAST(1000 AS DOUBLE), 6) AS roc_auc,
       round(CAST(0.5 AS DOUBLE) + CAST(p_partkey % 479 AS DOUBLE) / CAST(1000 AS DOUBLE), 6) AS f1_score,
       p_retailprice AS time_ms, p_partkey AS seq
FROM {part}
UNION ALL
SELECT 'stack#0', 'META', CAST(0.75 AS DOUBLE), CAST(0.75 AS DOUBLE), CAST(0.75 AS DOUBLE),
       CAST(0.75 AS DOUBLE), CAST(1000 AS DOUBLE), CAST(0 AS BIGINT)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, repo, path, content): one file per part; the brand is the repository."""
    return spark.sql(CODE_FILES_SQL.format(part="{part}"), part=table(spark, sf_dir, "part"))


def nearly_equal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files of which hardly any differ from the others of their repository."""
    return spark.sql(NEARLY_EQUAL_SQL.format(part="{part}"), part=table(spark, sf_dir, "part"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaderboard with ties; one type has a single row."""
    return spark.sql(RESULTS_SQL.format(part="{part}"), part=table(spark, sf_dir, "part"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, score, prediction) from document labels and lengths."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("bigint").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") >= 500).cast("bigint").alias("prediction"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, x array<double>) from the embeddings; label 1 from class 5 up."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") >= 5).cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository listing made of the customers."""
    key = F.col("c_custkey")
    language = F.element_at(F.array(*[F.lit(v) for v in ("python", "java", "rust")]), (key % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        F.concat(F.lit("repo://"), F.col("c_name"), F.lit(".git")).alias("clone_url"),
        language.alias("language"),
        F.col("c_acctbal").cast("bigint").alias("stars"),
        F.concat(F.lit("python cli for "), F.lower("c_mktsegment")).alias("description"),
    )
