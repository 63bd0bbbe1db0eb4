"""The per-file metrics over collected files as they arrive.

The metrics are a narrow projection, so the batch operator runs unchanged on a
stream: no state, no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clonelens.operators.metrics import metrics_of_parsed
from clonelens.operators.syntax import parse_files
from clonelens.sources.tables import CODE_FILES


def arriving_metrics(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """(path, repo, 17 metrics) of collected-file records landing under ``path``."""
    stream = spark.readStream.schema(CODE_FILES).format(file_format).load(path)
    return metrics_of_parsed(parse_files(stream), ["path", "repo"])
