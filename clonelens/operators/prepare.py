"""Imputation, scaling, splits and folds.

Fitted values are one row of statistics (its size is the feature count), kept on
the driver and applied as literals, so applying them is a narrow projection.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.functions.ranking import dense_index, hash_index, hash_quota
from clonelens.functions.skew import broadcast_if_small, salted_join

_LARGEST = sys.float_info.max


def _known(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


@dataclass
class Imputer:
    """Missing and NaN values become the fitted mean; a column without values becomes 0."""

    means: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.coalesce(_known(F.col(c)), F.lit(m)) for c, m in self.means.items()}
        )


def fit_imputer(train: DataFrame, columns: Sequence[str]) -> Imputer:
    row = train.agg(*[F.avg(_known(F.col(c))).alias(c) for c in columns]).first()
    return Imputer({c: float(row[c]) if row[c] is not None else 0.0 for c in columns})


def nan_to_num(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN to 0, infinities to the largest finite doubles."""

    def finite(c: Column) -> Column:
        return (
            F.when(F.isnan(c), F.lit(0.0))
            .when(c == F.lit(float("inf")), F.lit(_LARGEST))
            .when(c == F.lit(float("-inf")), F.lit(-_LARGEST))
            .otherwise(c)
        )

    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})


@dataclass
class Scaler:
    """(x - mean) / population deviation; a constant column is only centred."""

    stats: dict[str, tuple[float, float]]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()}
        )


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[
            F.when(F.max(c) > F.min(c), F.stddev_pop(c)).otherwise(F.lit(1.0)).alias(f"s_{c}")
            for c in columns
        ],
    ).first()
    return Scaler({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"]) for c in columns})


def standard_scale(
    df: DataFrame, columns: Sequence[str], fit_on: str = "train", is_test: str = "is_test"
) -> DataFrame:
    """Scale all rows with statistics of the training rows, or of all rows (``fit_on='all'``)."""
    fitted_on = df if fit_on == "all" else df.filter(~F.col(is_test))
    return fit_scaler(fitted_on, columns).apply(df)


def vector_columns(df: DataFrame, size: int, name: str = "x") -> tuple[DataFrame, list[str]]:
    """Spread an array column over ``size`` scalar columns."""
    names = [f"{name}_{i}" for i in range(size)]
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, *[F.col(name)[i].alias(n) for i, n in enumerate(names)]), names


def stratified_split(
    df: DataFrame,
    id_col: str = "row_id",
    label: str = "label",
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add ``is_test``: the first ``ceil(test_size * n)`` rows of each label in hash order.

    The split is a column, so whatever else a row carries stays aligned with it.
    """
    return hash_quota(df, id_col, f"split-{seed}", test_size, [label], "is_test")


def grouped_split(
    pairs: DataFrame, group: str = "left_id", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """``stratified_split`` without leakage: all pairs of one left file fall on one side."""
    files = pairs.select(group).distinct().withColumn("__all", F.lit(1))
    sides = hash_quota(files, group, f"split-{seed}", test_size, ["__all"], "is_test")
    return salted_join(pairs, sides.drop("__all"), group, "pair_id")


def kfold(df: DataFrame, id_col: str = "row_id", folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: a shuffled, unstratified fold; sizes differ by at most one."""
    indexed = hash_index(df, id_col, f"fold-{seed}", name="__i")
    return indexed.withColumn("fold", F.pmod("__i", F.lit(folds))).drop("__i")


def stratified_folds(
    df: DataFrame, id_col: str = "row_id", label: str = "label", folds: int = 10
) -> DataFrame:
    """Add ``fold``: consecutive blocks of each label in id order, sizes within one."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    indexed = dense_index(df, [id_col], by=[label], name="__i").join(
        broadcast_if_small(sizes), label
    )
    base, extra = F.floor(F.col("__n") / F.lit(folds)), F.pmod("__n", F.lit(folds))
    wide = extra * (base + 1)  # rows in the first blocks, which are one longer
    fold = F.when(F.col("__i") < wide, F.floor(F.col("__i") / (base + 1))).otherwise(
        extra + F.floor((F.col("__i") - wide) / F.greatest(base, F.lit(1)))
    )
    return indexed.withColumn("fold", fold.cast("bigint")).select(*df.columns, "fold")


_PIECES = 8  # tasks that write one fold


def dealt(df: DataFrame, by: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """Rows of equal ``by`` in a few tasks, for ``staged(by=...)``."""
    return df.repartition(*by, F.pmod(F.xxhash64(id_col), F.lit(_PIECES)))


# The shares of a training fold used for learning curves.
LEARNING_SHARES = (0.1, 0.325, 0.55, 0.775, 1.0)


def learning_subsets(
    df: DataFrame, id_col: str = "row_id", folds: int = 5, seed: int = 42
) -> DataFrame:
    """(id, held_out, size_no): the smallest subset of each training fold that holds the row.

    Subsets are hash-ordered prefixes of ``floor(share * n)`` rows, so they are
    nested and ``size_no <= s`` selects subset s; each row appears once per fold
    that trains on it instead of once per subset.
    """
    folded = kfold(df.select(id_col), id_col, folds, seed)
    others = F.filter(
        F.array(*[F.lit(f).cast("bigint") for f in range(folds)]), lambda f: f != F.col("fold")
    )
    training = folded.select(id_col, F.explode(others).alias("held_out"))
    sizes = training.groupBy("held_out").agg(F.count(F.lit(1)).alias("__n"))
    ranked = hash_index(training, id_col, f"subset-{seed}", by=["held_out"], name="__i")
    size_no = F.lit(len(LEARNING_SHARES) - 1)
    for at in reversed(range(len(LEARNING_SHARES) - 1)):
        within = F.col("__i") < F.floor(F.col("__n") * F.lit(LEARNING_SHARES[at]))
        size_no = F.when(within, F.lit(at)).otherwise(size_no)
    return ranked.join(F.broadcast(sizes), "held_out").select(
        id_col, "held_out", size_no.cast("bigint").alias("size_no")
    )
