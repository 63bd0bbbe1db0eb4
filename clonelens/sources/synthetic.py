"""Two Gaussian classes for trying models out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (mean, deviation) of class 0 and of class 1.
ZERO, ONE = (3.0, 2.0), (1.0, 1.5)


def synthetic(
    spark: SparkSession, n_samples: int = 2000, n_features: int = 34, seed: int = 42
) -> DataFrame:
    """(row_id, label, x): the first half of the ids is class 0, the rest class 1."""
    rows = spark.range(n_samples).withColumnRenamed("id", "row_id")
    label = (F.col("row_id") >= n_samples // 2).cast("bigint")
    values = []
    for at in range(n_features):
        draw = F.randn(seed + at)
        values.append(
            F.when(label == 0, draw * ZERO[1] + ZERO[0]).otherwise(draw * ONE[1] + ONE[0])
        )
    return rows.select("row_id", label.alias("label"), F.array(*values).alias("x"))
