"""Models over distances to all training rows: k nearest, kernel vote, label spreading."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.functions.skew import shuffled_join
from clonelens.models.base import score_table
from clonelens.operators.neighbours import BLOCK_ROWS, KernelIndex, nearest_neighbours
from clonelens.session import staged


@dataclass
class KNearest:
    """Share of class 1 among the ``k`` nearest training rows."""

    k: int = 5
    block_rows: int = BLOCK_ROWS

    def fit(self, train: DataFrame) -> FittedKNearest:
        return FittedKNearest(train, self.k, self.block_rows)


@dataclass
class FittedKNearest:
    train: DataFrame
    k: int
    block_rows: int

    def score(self, rows: DataFrame) -> DataFrame:
        near = nearest_neighbours(rows, self.train, self.k, self.block_rows)
        votes = near.groupBy("row_id").agg(F.avg(F.col("label").cast("double")).alias("share"))
        voted = shuffled_join(rows.select("row_id", "label"), votes, "row_id", "left")
        return score_table(voted, F.col("share"), F.coalesce(F.col("share") > 0.5, F.lit(False)))


def _vote_scores(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """Score = class 1's part of the two sums; NULL, and class 0, where both are 0."""
    voted = shuffled_join(rows.select("row_id", "label"), sums, "row_id", "left")
    total = F.coalesce(F.col("s_0") + F.col("s_1"), F.lit(0.0))
    share = F.when(total > 0, F.col("s_1") / F.when(total > 0, total))
    return score_table(voted, share, F.coalesce(share > 0.5, F.lit(False)))


def _one_hot(label: Column) -> Column:
    return F.array((label == 0).cast("double"), (label == 1).cast("double"))


@dataclass
class LabelPropagation:
    """With every training label known: the kernel-weighted vote of all training rows."""

    gamma: float = 20.0
    block_rows: int = BLOCK_ROWS

    def fit(self, train: DataFrame) -> FittedKernelVote:
        index = KernelIndex.build(train, self.gamma, self.block_rows)
        return FittedKernelVote(index, train.select("row_id", _one_hot(F.col("label")).alias("v")))


@dataclass
class FittedKernelVote:
    index: KernelIndex
    votes: DataFrame

    def score(self, rows: DataFrame) -> DataFrame:
        return _vote_scores(rows, self.index.sums(self.index.place(rows), self.votes, 2))


@dataclass
class LabelSpreading:
    """F = alpha * S F + (1 - alpha) * Y until F moves less than ``tolerance`` in sum.

    S is the kernel matrix without its diagonal, normalised by the row sums on
    both sides.  It is never built: the rows are placed into blocks once, each
    round is one exact kernel sum over them, and each round's F is staged.
    """

    gamma: float = 20.0
    alpha: float = 0.2
    tolerance: float = 1e-3
    max_rounds: int = 1000
    block_rows: int = BLOCK_ROWS

    def fit(self, train: DataFrame) -> FittedKernelVote:
        index = KernelIndex.build(train, self.gamma, self.block_rows)
        base = train.select("row_id", _one_hot(F.col("label")).alias("y"))
        ones = base.select("row_id", F.array(F.lit(1.0)).alias("v"))
        reach = index.sums(index.points, ones, 1, skip_self=True)
        near = F.coalesce(F.col("s_0"), F.lit(0.0))
        root = F.when(near > 0, F.sqrt(near)).otherwise(F.lit(1.0))  # a lone row keeps its label
        state = staged(
            shuffled_join(base, reach, "row_id", "left").select(
                "row_id", "y", root.alias("root"), F.col("y").alias("f")
            ),
            "spread",
        )
        for _ in range(self.max_rounds):
            sent = state.select(
                "row_id", F.array(*[F.col("f")[i] / F.col("root") for i in (0, 1)]).alias("v")
            )
            joined = shuffled_join(state, index.sums(index.points, sent, 2, skip_self=True), "row_id", "left")
            heard = [F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) / F.col("root") for i in (0, 1)]
            f = [F.lit(self.alpha) * heard[i] + F.lit(1 - self.alpha) * F.col("y")[i] for i in (0, 1)]
            state = staged(
                joined.select("row_id", "y", "root", F.array(*f).alias("f"), F.col("f").alias("old")),
                "spread",
            )
            change = [F.abs(F.col("f")[i] - F.col("old")[i]) for i in (0, 1)]
            moved = state.agg(F.sum(change[0] + change[1])).first()[0]
            state = state.drop("old")
            if moved is None or moved < self.tolerance:
                break
        total = F.col("f")[0] + F.col("f")[1]
        safe = F.when(total == 0, F.lit(1.0)).otherwise(total)
        shares = F.array(*[F.col("f")[i] / safe for i in (0, 1)])
        return FittedKernelVote(index, state.select("row_id", shares.alias("v")))
