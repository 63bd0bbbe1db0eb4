"""From code files to a labelled, split and scaled training table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonelens.operators.metrics import file_metrics
from clonelens.operators.pair_features import FEATURES, as_vectors, pair_features
from clonelens.operators.pairs import PairSample, files_of_pairs, sample_pairs
from clonelens.operators.prepare import grouped_split, standard_scale, stratified_split
from clonelens.session import staged


@dataclass
class Dataset:
    """Pairs, their files and features, and the two sides of the split as vectors.

    ``shortfall`` is how many of the wanted pairs do not exist.
    """

    pairs: DataFrame
    files: DataFrame
    features: DataFrame
    train: DataFrame
    test: DataFrame
    shortfall: int = 0


def labelled_features(
    code_files: DataFrame,
    num_pairs: int = 1000,
    clone_types: str = "mixed",
    negatives: str = "same_repo",
    seed: int = 42,
) -> tuple[PairSample, DataFrame, DataFrame]:
    """(sample, files, features), each staged: texts are read, drawn, mutated and parsed once."""
    code_files = staged(code_files, "code-files")
    sample = sample_pairs(code_files, num_pairs, clone_types, negatives, seed)
    pairs = staged(sample.pairs, "pairs")
    files = staged(files_of_pairs(code_files, pairs, seed), "pair-files")
    metrics = staged(file_metrics(files), "metrics")
    return PairSample(pairs, sample.shortfall), files, staged(pair_features(pairs, metrics), "features")


def split_and_scale(
    features: DataFrame, fit_on: str = "train", group_by: str | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test vectors of (pair_id, label, features): 80/20, stratified, scaled.

    ``group_by`` names a column whose rows must not fall on both sides.
    """
    if group_by:
        split = grouped_split(features, group_by, seed=seed)
    else:
        split = stratified_split(features, "pair_id", seed=seed)
    scaled = standard_scale(split, FEATURES, fit_on)
    vectors = staged(as_vectors(scaled, ("is_test",)), "vectors")
    return vectors.filter(~F.col("is_test")).drop("is_test"), vectors.filter("is_test").drop("is_test")


def build(code_files: DataFrame, num_pairs: int = 1000, **options) -> Dataset:
    """The whole way from files to train and test vectors."""
    sample, files, features = labelled_features(code_files, num_pairs, **options)
    train, test = split_and_scale(features)
    return Dataset(sample.pairs, files, features, train, test, sample.shortfall)
