"""Models that need only sums: one pass gives count, sum and Gram matrix per group.

Each task adds up its rows in numpy and emits one small matrix per group; Spark
sums those.  The result's size depends on the number of features only, so the
solves run on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.functions.arrays import ROWS, matrix, row_sums
from clonelens.models.base import Linear, score_table, sigmoid


def gram_by_group(rows: DataFrame, group: str) -> dict[int, np.ndarray]:
    """Per value of the integer column ``group``: the sum of z z^T with z = (1, x)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("x"))
            z = np.column_stack([np.ones(len(x)), x])
            groups = batch.column("g").to_numpy()
            for g in np.unique(groups):
                part = z[groups == g]
                sums[g] = sums.get(g, 0.0) + part.T @ part
        for g, total in sums.items():
            part = row_sums(total)
            yield part.add_column(0, "g", pa.array(np.full(part.num_rows, g), pa.int64()))

    slim = rows.select(F.col(group).cast("bigint").alias("g"), "x")
    parts = slim.mapInArrow(partial, "g bigint, " + ROWS)
    summed = parts.groupBy("g", "at").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    out: dict[int, dict[int, np.ndarray]] = {}
    for row in summed.collect():  # groups * (features + 1) rows
        out.setdefault(row["g"], {})[row["at"]] = row["v"].toArray()
    return {g: np.stack([lines[i] for i in range(len(lines))]) for g, lines in out.items()}


@dataclass
class ClassMoments:
    """Count, mean and scatter matrix of one class."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, gram: np.ndarray) -> ClassMoments:
        n = gram[0, 0]
        mean = gram[0, 1:] / n
        return cls(n, mean, gram[1:, 1:] - n * np.outer(mean, mean))


def class_moments(train: DataFrame) -> dict[int, ClassMoments]:
    return {g: ClassMoments.of(m) for g, m in gram_by_group(train, "label").items()}


def _ridge_weights(signed: np.ndarray, gram: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge on labels of +1 and -1 with a free intercept, from the Gram matrix of (1, x).

    ``signed`` is the sum of y * (1, x).
    """
    n, mean_x, mean_y = gram[0, 0], gram[0, 1:] / gram[0, 0], signed[0] / gram[0, 0]
    centred = gram[1:, 1:] - n * np.outer(mean_x, mean_x)
    target = signed[1:] - n * mean_x * mean_y
    weights = np.linalg.lstsq(centred + alpha * np.eye(len(mean_x)), target, rcond=None)[0]
    return weights, mean_y - weights @ mean_x


def _signed(by_label: dict[int, np.ndarray]) -> np.ndarray:
    return sum((1 if label == 1 else -1) * g[0] for label, g in by_label.items())


@dataclass
class Ridge:
    """Least squares on labels of +1 and -1 with an L2 penalty; no probability."""

    alpha: float = 1.0

    def fit(self, train: DataFrame) -> Linear:
        grams = gram_by_group(train, "label")
        weights, bias = _ridge_weights(_signed(grams), sum(grams.values()), self.alpha)
        return Linear(list(weights), bias)


@dataclass
class RidgeCv:
    """``Ridge`` whose penalty has the least squared error over hashed folds.

    One pass collects Gram matrices per (fold, label); every fold's fit and error
    follow from sums and differences of those matrices.
    """

    alphas: tuple[float, ...] = (0.1, 1.0, 10.0)
    folds: int = 5
    chosen: float | None = field(default=None, init=False)

    def fit(self, train: DataFrame) -> Linear:
        fold = F.pmod(F.xxhash64("row_id"), F.lit(self.folds))
        keyed = gram_by_group(train.withColumn("__g", fold * 2 + F.col("label")), "__g")
        folds: dict[int, dict[int, np.ndarray]] = {}
        for g, gram in keyed.items():
            folds.setdefault(g // 2, {})[g % 2] = gram
        whole = sum(keyed.values())
        signed = sum(_signed(f) for f in folds.values())

        def error(alpha: float) -> float:
            total = 0.0
            for held in folds.values():
                gram, target = sum(held.values()), _signed(held)
                weights, bias = _ridge_weights(signed - target, whole - gram, alpha)
                beta = np.concatenate([[bias], weights])
                total += gram[0, 0] - 2 * beta @ target + beta @ gram @ beta  # labels square to 1
            return total

        self.chosen = min(self.alphas, key=error) if len(folds) > 1 else self.alphas[0]
        weights, bias = _ridge_weights(signed, whole, self.chosen)
        return Linear(list(weights), bias)


@dataclass
class Lda:
    """Linear discriminant analysis: class means, shared covariance, observed class shares."""

    def fit(self, train: DataFrame) -> Linear:
        by_label = class_moments(train)
        zero, one = by_label[0], by_label[1]
        n = zero.n + one.n
        inverse = np.linalg.pinv((zero.scatter + one.scatter) / (n - 2), hermitian=True)
        weights = inverse @ (one.mean - zero.mean)
        bias = -0.5 * weights @ (one.mean + zero.mean) + np.log(one.n / zero.n)
        return Linear(list(weights), float(bias), sigmoid)


@dataclass
class Qda:
    """Quadratic discriminant analysis: a mean and a covariance per class."""

    def fit(self, train: DataFrame) -> FittedQda:
        by_label = class_moments(train)
        n = sum(m.n for m in by_label.values())
        parts = {}
        for label, m in by_label.items():
            values, axes = np.linalg.eigh(m.scatter / (m.n - 1))
            kept = values > values.max() * len(values) * np.finfo(float).eps
            # log density = constant - |whitened|^2 / 2 over the axes with spread
            whiten = axes[:, kept] / np.sqrt(values[kept])
            constant = np.log(m.n / n) - 0.5 * np.log(values[kept]).sum()
            parts[label] = (whiten @ whiten.T, m.mean, float(constant))
        return FittedQda(parts[0], parts[1])


@dataclass
class FittedQda:
    """Score = 1 / (1 + exp(log density of class 0 - log density of class 1))."""

    zero: tuple[np.ndarray, np.ndarray, float]
    one: tuple[np.ndarray, np.ndarray, float]

    def score(self, rows: DataFrame) -> DataFrame:
        """By matrix products in the tasks; rows are centred first, so that no large terms cancel out."""
        zero, one = self.zero, self.one

        def density(x: np.ndarray, part: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
            apart = x - part[1]
            return part[2] - 0.5 * ((apart @ part[0]) * apart).sum(axis=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("x"))
                margin = density(x, one) - density(x, zero)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(margin)], names=["row_id", "label", "__m"])

        scored = rows.select("row_id", F.col("label").cast("bigint"), "x").mapInArrow(run, "row_id bigint, label bigint, __m double")
        return score_table(scored, sigmoid(F.col("__m")), F.col("__m") > 0)


@dataclass
class NearestCentroid:
    """The class whose mean is nearest; ties go to the smaller label; no probability."""

    def fit(self, train: DataFrame) -> FittedCentroid:
        size = train.select(F.size("x")).first()[0]
        means = train.groupBy("label").agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size)])
        centroids = {r["label"]: [r[f"m{i}"] for i in range(size)] for r in means.collect()}
        return FittedCentroid(centroids)


@dataclass
class FittedCentroid:
    centroids: dict[int, list[float]]

    def score(self, rows: DataFrame) -> DataFrame:
        def gap(mean: list[float]) -> Column:
            steps = " + ".join(f"power(x[{at}] - ({float(m)!r}D), 2)" for at, m in enumerate(mean))
            return F.round(F.sqrt(F.expr(steps)), 9)

        nearest = F.array_min(
            F.array(*[F.struct(gap(m).alias("gap"), F.lit(label).alias("label")) for label, m in sorted(self.centroids.items())])
        )["label"]
        return score_table(rows, nearest, nearest)
