"""34 features per pair from the metrics of its two files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.functions.skew import salted_join
from clonelens.operators.metrics import METRICS

# one difference and one ratio per metric, side by side, in metric order
FEATURES = [f"{m}_{kind}" for m in METRICS for kind in ("diff", "ratio")]
_RATIO_OFFSET = 0.001  # fixed value: keeps the ratio of equal values below 1


def diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def ratio(a: Column, b: Column) -> Column:
    """Smaller value over the larger one, the right side lifted by the offset; 1 if both are 0."""
    quotient = F.least(a, b) / F.greatest(a, b + F.lit(_RATIO_OFFSET))
    return F.when(a + b > 0, quotient).otherwise(F.lit(1.0))


def attach_metrics(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Pairs with ``left_<metric>`` and ``right_<metric>``; a file in very many pairs is salted."""
    out, rows = pairs, pairs.count()
    for side in ("left", "right"):
        named = metrics.select(
            F.col("file_id").alias(f"{side}_id"),
            *[F.col(m).cast("double").alias(f"{side}_{m}") for m in METRICS],
        )
        out = salted_join(out, named, f"{side}_id", "pair_id", rows=rows)
    return out


def pair_features(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """(pair_id, label, 34 doubles)."""
    columns = []
    for m in METRICS:
        a, b = F.col(f"left_{m}"), F.col(f"right_{m}")
        columns += [diff(a, b).alias(f"{m}_diff"), ratio(a, b).alias(f"{m}_ratio")]
    return attach_metrics(pairs, metrics).select("pair_id", "label", *columns)


def as_vectors(features: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, label, keep..., x array<double>) in the order of FEATURES."""
    return features.select(
        F.col("pair_id").alias("row_id"), "label", *keep, F.array(*FEATURES).alias("x")
    )
