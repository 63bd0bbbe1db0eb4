"""Hand-off tables between stages: collected files, metrics, features, results.

Schemas are declared, never inferred.  Parquet is the default; JSON and CSV are
for exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clonelens.operators.leaderboard import result_summary
from clonelens.operators.metrics import FRACTIONS, METRICS
from clonelens.operators.pair_features import FEATURES

CODE_FILES = "path string, content string, repo string"
FILE_METRICS = "file_id bigint, " + ", ".join(
    f"{m} {'double' if m in FRACTIONS else 'bigint'}" for m in METRICS
)
PAIR_FEATURES = "pair_id bigint, label bigint, " + ", ".join(f"{f} double" for f in FEATURES)
RESULTS = (
    "model string, type string, accuracy double, balanced_accuracy double, "
    "roc_auc double, f1_score double, time_ms double"
)
_CSV = {"header": True, "escape": '"'}


def write_table(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write rows as 'parquet', 'json' (one record per line) or 'csv' (with a header)."""
    writer = df.write.mode("errorifexists")
    if file_format == "csv":
        writer = writer.options(**_CSV)
    writer.format(file_format).save(path)


def read_table(spark: SparkSession, path: str, schema: str, file_format: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    if file_format == "csv":
        reader = reader.options(**_CSV, multiLine=True)
    return reader.format(file_format).load(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read whole-file JSON arrays, as other tools dump them."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def export_report(results: DataFrame, path: str) -> None:
    """The ranked result table as CSV and as JSON records."""
    columns = [c for c in RESULTS.replace(",", "").split() if c in results.columns]
    ranked = result_summary(results).select(*columns)
    write_table(ranked, f"{path}/csv", "csv")
    write_table(ranked, f"{path}/json", "json")
