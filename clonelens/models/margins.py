"""Linear and kernel support vector machines with optional sigmoid calibration."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from clonelens.functions.arrays import ROWS, added_up, matrix, row_sums
from clonelens.models.base import Linear, score_table, sigmoid
from clonelens.session import staged


def _margin_sums(
    rows: DataFrame, w: np.ndarray, logistic: bool
) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of the squared hinge or logistic loss at ``w`` (bias first), one pass."""
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, curve = 0.0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("x"))
            z = np.column_stack([np.ones(len(x)), x])
            sign = np.where(batch.column("label").to_numpy() == 1, 1.0, -1.0)
            margin = sign * (z @ w)
            if logistic:
                miss = np.exp(-np.logaddexp(0.0, margin))  # probability of the other class
                loss += float(np.logaddexp(0.0, -margin).sum())
                slope -= z.T @ (sign * miss)
                curve += (z * (miss * (1.0 - miss))[:, None]).T @ z
                continue
            short = 1.0 - margin
            inside = short > 0
            z, sign, short = z[inside], sign[inside], short[inside]
            loss += float(short @ short)
            slope -= 2.0 * (z.T @ (sign * short))
            curve += 2.0 * (z.T @ z)
        yield row_sums(np.vstack([np.full(size, loss), slope, curve]))

    total = added_up(rows.select("x", "label").mapInArrow(run, ROWS), size + 2, size)
    return total[0, 0], total[1], total[2:]


def _hyperplane(
    train: DataFrame,
    c: float,
    max_iter: int,
    tolerance: float = 1e-4,
    start: Linear | None = None,
    logistic: bool = False,
) -> Linear:
    """Minimise |w|^2 / 2 + c * (summed loss) by Newton steps, halved when they overshoot.

    With the squared hinge the bias is penalised with the rest, with the logistic
    loss it is free.  Each step is one pass whose result has (features + 1)^2
    numbers, and few steps are needed.
    """
    size = train.select(F.size("x")).first()[0] + 1
    penalty = np.ones(size)
    if logistic:
        penalty[0] = 1e-9  # free, but the solve stays regular

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, curve = _margin_sums(train, w, logistic)
        return 0.5 * (penalty * w) @ w + c * loss, penalty * w + c * slope, np.diag(penalty) + c * curve

    w = np.zeros(size) if start is None else np.array([start.bias, *start.weights])
    value, slope, curve = at(w)
    first = np.linalg.norm(slope)
    for _ in range(max_iter):
        step = np.linalg.solve(curve, slope)
        share = 1.0
        while True:
            tried = at(w - share * step)
            if tried[0] <= value or share < 1e-3:
                break
            share /= 2
        w = w - share * step
        value, slope, curve = tried
        if np.linalg.norm(slope) <= tolerance * first:
            break
    else:
        if np.linalg.norm(slope) > tolerance * first:
            warnings.warn(f"no optimum after {max_iter} Newton steps", stacklevel=2)
    return Linear(list(w[1:]), float(w[0]))


def _sigmoid_of(margins: DataFrame) -> tuple[float, float]:
    """Slope and offset of the sigmoid that maps ``margin`` to the share of label 1."""
    rows = margins.select("label", array_to_vector(F.array("margin")).alias("features"))
    model = LogisticRegression(maxIter=100, standardization=False).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


@dataclass
class LinearSvm:
    """Squared hinge loss with cost ``c``; no probability."""

    c: float = 1.0
    max_iter: int = 50

    def fit(self, train: DataFrame) -> Linear:
        return _hyperplane(train, self.c, self.max_iter)


@dataclass
class Logistic:
    """Logistic regression with cost ``c``; the score is the probability."""

    c: float = 1.0
    max_iter: int = 50

    def fit(self, train: DataFrame) -> Linear:
        plane = _hyperplane(train, self.c, self.max_iter, logistic=True)
        return Linear(plane.weights, plane.bias, sigmoid)


@dataclass
class CalibratedSvm:
    """Mean of ``folds`` machines, each with a sigmoid fitted on its held-out fold."""

    folds: int = 5
    c: float = 1.0
    max_iter: int = 50

    def fit(self, train: DataFrame) -> FittedCalibrated:
        keyed = train.withColumn("__fold", F.pmod(F.xxhash64("row_id"), F.lit(self.folds)))

        def one(fold: int) -> tuple[Linear, float, float]:
            plane = _hyperplane(keyed.filter(F.col("__fold") != fold), self.c, self.max_iter)
            held = keyed.filter(F.col("__fold") == fold).select("label", plane.margin().alias("margin"))
            return (plane, *_sigmoid_of(held))

        with ThreadPool(self.folds) as pool:  # independent fits
            return FittedCalibrated(pool.map(one, range(self.folds), chunksize=1))


@dataclass
class FittedCalibrated:
    parts: list[tuple[Linear, float, float]]

    def score(self, rows: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for plane, slope, offset in self.parts:
            total = total + sigmoid(plane.margin() * F.lit(slope) + F.lit(offset))
        scored = rows.withColumn("__s", total / F.lit(float(len(self.parts))))
        return score_table(scored, F.col("__s"), F.col("__s") > 0.5)


@dataclass
class FourierMap:
    """Random cosine features whose inner products approach exp(-gamma d^2) (Rahimi and Recht 2007)."""

    directions: np.ndarray
    shifts: np.ndarray

    @classmethod
    def draw(cls, size: int, gamma: float, features: int, seed: int) -> FourierMap:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0.0, np.sqrt(2.0 * gamma), (size, features)), rng.uniform(0.0, 2 * np.pi, features)
        )

    def _cosines(self) -> Callable[[pd.Series], np.ndarray]:
        directions, shifts = self.directions, self.shifts
        norm = np.sqrt(2.0 / len(shifts))
        return lambda values: norm * np.cos(np.stack(values.to_list()) @ directions + shifts)

    def column(self, x: str) -> Column:
        """The mapped features."""
        cosines = self._cosines()

        @pandas_udf("array<double>")
        def mapped(values: pd.Series) -> pd.Series:
            return pd.Series(list(cosines(values)))

        return mapped(F.col(x))

    def margin(self, x: str, plane: Linear) -> Column:
        """The hyperplane's margin over the mapped features, without materialising them."""
        cosines, weights, bias = self._cosines(), np.array(plane.weights), plane.bias

        @pandas_udf("double")
        def margin(values: pd.Series) -> pd.Series:
            return pd.Series(cosines(values) @ weights + bias)

        return margin(F.col(x))


@dataclass
class KernelSvm:
    """A linear machine on random Fourier features, with a sigmoid on its margin.

    The kernel width is 1 / (features * variance of all values); squared hinge
    stands in for the hinge.  With ``nu`` the cost is the tried one whose share of
    rows inside the margin is closest.
    """

    c: float = 1.0
    nu: float | None = None
    features: int = 256
    max_iter: int = 50
    seed: int = 42
    tried: tuple[float, ...] = (1e-3, 1e-2, 1e-1, 1.0)

    def fit(self, train: DataFrame) -> FittedKernelSvm:
        size = train.select(F.size("x")).first()[0]
        spread = train.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0]
        gamma = 1.0 / (size * spread) if spread else 1.0
        mapping = FourierMap.draw(size, gamma, self.features, self.seed)
        mapped = staged(train.select("row_id", "label", mapping.column("x").alias("x")), "fourier")
        if self.nu is None:
            plane = _hyperplane(mapped, self.c, self.max_iter)
        else:
            planes: list[Linear] = []
            for c in self.tried:
                planes.append(_hyperplane(mapped, c, self.max_iter, start=planes[-1] if planes else None))
            sign = F.col("label") * 2 - 1
            margins = train.select(
                sign.alias("sign"), *[mapping.margin("x", p).alias(f"m{i}") for i, p in enumerate(planes)]
            )
            shares = margins.agg(
                *[
                    F.avg((F.col(f"m{i}") * F.col("sign") < 1).cast("double")).alias(f"s{i}")
                    for i in range(len(planes))
                ]
            ).first()
            plane = planes[min(range(len(planes)), key=lambda i: abs(shares[f"s{i}"] - self.nu))]
        slope, offset = _sigmoid_of(train.select("label", mapping.margin("x", plane).alias("margin")))
        return FittedKernelSvm(mapping, plane, slope, offset)


@dataclass
class FittedKernelSvm:
    mapping: FourierMap
    plane: Linear
    slope: float
    offset: float

    def score(self, rows: DataFrame) -> DataFrame:
        margin = self.mapping.margin("x", self.plane)
        scored = rows.select("row_id", "label", margin.alias("__m"))
        score = sigmoid(F.col("__m") * F.lit(self.slope) + F.lit(self.offset))
        return score_table(scored, score, F.col("__m") > 0)
