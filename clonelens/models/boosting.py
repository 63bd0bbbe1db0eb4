"""AdaBoost over one-split trees with exact cuts.

Every place between two neighbouring values of a feature is tried.  Up to
``local_rows`` rows, a constant, one task sorts each feature once and runs all
rounds.  Beyond it a round is a search over attribute lists in Spark, whose class
totals are the rows' weights; the weights are a column that is multiplied where the
round's stump misses, and staged, so a round never evaluates earlier stumps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.functions.arrays import matrix
from clonelens.models.base import score_table, sigmoid
from clonelens.models.exact_trees import best_cuts
from clonelens.models.extra_trees import LOCAL_ROWS, _impurity
from clonelens.session import staged


@dataclass
class Stump:
    feature: int
    cut: float  # rows with x <= cut go left
    left: int
    right: int
    say: float  # weight of its vote

    def side(self) -> Column:
        return F.when(F.col("x")[self.feature] <= F.lit(self.cut), self.left).otherwise(self.right)


def stump_of(feature: int, cut: float, l0: float, l1: float, zeros: float, ones: float) -> tuple[Stump, float]:
    """The stump of a cut with these weights to its left, and its share of wrong weight."""
    left, right = int(l1 > l0), int(ones - l1 > zeros - l0)
    wrong = (l0 if left else l1) + (zeros - l0 if right else ones - l1)
    error = max(wrong, 0.0) / (zeros + ones)
    say = 1.0 if error <= 0 else float(np.log((1 - error) / error)) if error < 0.5 else 0.0
    return Stump(feature, cut, left, right, say), error


class _Sorted:
    """All rows of a small table, sorted once per feature."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.x, self.ones = x, label == 1
        self.order = np.argsort(x, axis=0, kind="stable").T
        self.values = np.take_along_axis(x.T, self.order, axis=1)
        self.ends = self.values[:, 1:] > self.values[:, :-1]  # places where the value changes

    def best(self, weight: np.ndarray) -> tuple[int, float, float, float] | None:
        """(feature, cut, weight of zeros and of ones to its left)."""
        best = None
        w1 = np.where(self.ones, weight, 0.0)
        zeros, ones = weight.sum() - w1.sum(), w1.sum()
        for f, order in enumerate(self.order):
            at = np.flatnonzero(self.ends[f])
            if not len(at):
                continue
            l1 = np.cumsum(w1[order])[at]
            l0 = np.cumsum(weight[order])[at] - l1
            gain = _impurity(zeros, ones) - _impurity(l0, l1) - _impurity(zeros - l0, ones - l1)
            i = int(np.argmax(gain))
            if best is None or gain[i] > best[0]:
                low, high = self.values[f, at[i]], self.values[f, at[i] + 1]
                middle = low + (high - low) / 2
                best = (gain[i], f, float(middle if middle < high else low), float(l0[i]), float(l1[i]))
        return best and best[1:]


_STUMP = "feature int, cut double, `left` int, `right` int, say double"


@dataclass
class AdaBoost:
    """Up to ``rounds`` stumps; stops at a perfect one or one no better than chance."""

    rounds: int = 50
    local_rows: int = LOCAL_ROWS

    def fit(self, train: DataFrame) -> FittedAdaBoost:
        rows = train.select("label", "x")
        return FittedAdaBoost(self._in_one_task(rows) if rows.count() <= self.local_rows else self._in_spark(rows))

    def _in_one_task(self, rows: DataFrame) -> list[Stump]:
        rounds = self.rounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            if not parts:
                return
            table = _Sorted(np.concatenate([matrix(b.column("x")) for b in parts]), np.concatenate([b.column("label").to_numpy() for b in parts]))
            weight, found = np.full(len(table.x), 1.0 / len(table.x)), []
            for _ in range(rounds):
                best = table.best(weight)
                if best is None:
                    break
                ones = weight[table.ones].sum()
                stump, error = stump_of(*best, weight.sum() - ones, ones)
                if error >= 0.5:
                    break
                found.append(stump)
                if error <= 0:
                    break
                misses = np.where(table.x[:, stump.feature] <= stump.cut, stump.left, stump.right) != table.ones
                weight[misses] *= np.exp(stump.say)
                weight /= weight.sum()
            columns = [[getattr(s, n) for s in found] for n in ("feature", "cut", "left", "right", "say")]
            kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["feature", "cut", "left", "right", "say"])

        found = rows.coalesce(1).mapInArrow(run, _STUMP).collect()  # at most ``local_rows`` rows went in
        return [Stump(*r) for r in found]

    def _in_spark(self, rows: DataFrame) -> list[Stump]:
        weighted = staged(rows.withColumn("weight", F.lit(1.0)), "adaboost")
        stumps: list[Stump] = []
        for _ in range(self.rounds):
            of = lambda label: F.when(F.col("label") == label, F.col("weight")).otherwise(0.0)
            totals = weighted.agg(F.sum(of(0)).alias("zeros"), F.sum(of(1)).alias("ones")).first()
            every = weighted.select(F.lit(0).alias("node"), F.posexplode("x").alias("feature", "value"), of(0).alias("w0"), of(1).alias("w1"))
            found = sorted(best_cuts(every).collect(), key=lambda r: r["feature"])  # one row per feature
            if not found:
                break
            best = max(found, key=lambda r: r["gain"])
            stump, error = stump_of(best["feature"], best["cut"], best["l0"], best["l1"], totals["zeros"], totals["ones"])
            if error >= 0.5:
                break
            stumps.append(stump)
            if error <= 0:
                break
            grown = F.when(stump.side() != F.col("label"), F.lit(float(np.exp(stump.say)))).otherwise(1.0)
            share = F.lit(1.0 / (totals["zeros"] + totals["ones"]))
            weighted = staged(weighted.withColumn("weight", F.col("weight") * share * grown), "adaboost")
        return stumps


@dataclass
class FittedAdaBoost:
    stumps: list[Stump]

    def score(self, rows: DataFrame) -> DataFrame:
        vote = F.lit(0.0)
        for s in self.stumps:
            left, right = (F.lit(s.say if label == 1 else -s.say) for label in (s.left, s.right))
            vote = vote + F.when(F.col("x")[s.feature] <= F.lit(s.cut), left).otherwise(right)
        total = sum(s.say for s in self.stumps) or 1.0
        scored = rows.withColumn("__m", vote / F.lit(float(total)))
        return score_table(scored, sigmoid(F.col("__m")), F.col("__m") > 0)
