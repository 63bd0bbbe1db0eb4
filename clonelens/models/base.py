"""The common form of a model: ``fit(train) -> fitted``, ``fitted.score(rows)``.

``train`` and ``rows`` are (row_id, label, x array<double>); a score table is
(row_id, label, score, prediction).  ``score`` is the probability of class 1 if
the model offers one, else the hard prediction; it is NULL where undefined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Fitted(Protocol):
    def score(self, rows: DataFrame) -> DataFrame: ...


class Estimator(Protocol):
    def fit(self, train: DataFrame) -> Fitted: ...


def score_table(rows: DataFrame, score: Column, prediction: Column) -> DataFrame:
    return rows.select(
        "row_id", "label", score.cast("double").alias("score"), prediction.cast("bigint").alias("prediction")
    )


def weighted_sum(x: str, weights: Sequence[float], bias: float = 0.0) -> Column:
    """bias + sum(x[i] * w[i]) as plain arithmetic, so it stays in generated code."""
    terms = "".join(f" + {x}[{at}] * ({float(w)!r}D)" for at, w in enumerate(weights))
    return F.expr(f"({float(bias)!r}D){terms}")


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


@dataclass
class Linear:
    """A fitted hyperplane; ``probability`` maps the margin to a score if the model offers one."""

    weights: list[float]
    bias: float
    probability: Callable[[Column], Column] | None = None

    def margin(self) -> Column:
        return weighted_sum("x", self.weights, self.bias)

    def score(self, rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("__m", self.margin())
        prediction = (F.col("__m") > 0).cast("bigint")
        score = self.probability(F.col("__m")) if self.probability else prediction
        return score_table(scored, score, prediction)
