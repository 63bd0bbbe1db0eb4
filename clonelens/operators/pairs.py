"""Labelled pairs by deterministic sampling: clones of files, non-clones by hash draws.

Pairs carry ids only; text is joined in where a step needs it.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.functions.hashing import seeded_hash
from clonelens.functions.ranking import dense_index
from clonelens.functions.skew import BROADCAST_ROWS, broadcast_if_small, salted_join, shuffled_join
from clonelens.operators.rewrite import mutant_id, mutate_code
from clonelens.session import spread, staged

EXACT, MUTATED, NEGATIVE = "exact", "mutated", "negative"
_SPARE = 64  # draws added to every batch


def _first(df: DataFrame, order: list[str], n: int, name: str) -> DataFrame:
    """The first ``n`` rows in ``order``, numbered from 0."""
    return dense_index(df, order, name=name).filter(F.col(name) < n)


def positive_pairs(code_files: DataFrame, count: int, clone_types: str = "mixed") -> DataFrame:
    """Clones of the first ``count`` files in path order.

    ``mixed``: even positions are exact copies, odd ones mutants; ``exact``: all
    are copies.  Fewer files give fewer pairs.
    """
    chosen = _first(code_files.select("path", "file_id"), ["path", "file_id"], count, "pair_id")
    mutated = (F.col("pair_id") % 2 == 1) & F.lit(clone_types == "mixed")
    return chosen.select(
        F.col("pair_id").cast("bigint").alias("pair_id"),
        F.col("file_id").alias("left_id"),
        F.when(mutated, mutant_id(F.col("file_id"))).otherwise(F.col("file_id")).alias("right_id"),
        F.when(mutated, F.lit(MUTATED)).otherwise(F.lit(EXACT)).alias("kind"),
        F.lit(1).cast("bigint").alias("label"),
    )


def files_per_repo(code_files: DataFrame) -> DataFrame:
    """(repo, n_files); files without a repository share the repository 'default'."""
    repo = F.coalesce(F.col("repo"), F.lit("default")).alias("repo")
    return code_files.groupBy(repo).agg(F.count(F.lit(1)).alias("n_files"))


def multi_file_repos(code_files: DataFrame) -> DataFrame:
    """Repositories with several files, numbered by name from 0."""
    return dense_index(files_per_repo(code_files).filter("n_files > 1"), ["repo"], name="repo_no")


def drawable_repos(slots: DataFrame) -> DataFrame:
    """Repositories that hold two different texts, numbered by name from 0, with their file counts.

    Others can never give a pair, so draws do not go there.
    """
    texts = slots.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("sha").alias("least"), F.max("sha").alias("largest")
    )
    several = texts.filter("least < largest").select("repo", "n_files")
    return dense_index(several, ["repo"], name="repo_no")


def files_in_repos(code_files: DataFrame) -> DataFrame:
    """(file_id, repo, idx, sha): files numbered inside their repository, multi-file ones only.

    A repository holding most of the files is ranked in buckets, not in one task.
    """
    slim = staged(  # texts are read and hashed once
        spread(code_files).select(
            "file_id",
            F.coalesce(F.col("repo"), F.lit("default")).alias("repo"),
            F.sha2("content", 256).alias("sha"),
        ),
        "file-hashes",
    )
    several = broadcast_if_small(files_per_repo(slim).filter("n_files > 1").select("repo"))
    return dense_index(slim.join(several, "repo", "left_semi"), ["file_id"], by=["repo"])


def _two_slots(draw: Column, size: Column, seed: str) -> tuple[Column, Column]:
    """Two different positions below ``size``, drawn by hash."""
    first = F.pmod(seeded_hash(f"{seed}-first", draw), size)
    step = F.pmod(seeded_hash(f"{seed}-second", draw), size - 1)
    return first, F.pmod(first + 1 + step, size)


@dataclass
class Negatives:
    """Non-clone pairs, numbered by ``place``, and how many of the wanted ones do not exist.

    The shortfall is 0 unless no repository holds two different texts; then it is
    the number wanted.
    """

    pairs: DataFrame
    shortfall: int


def same_repo_negatives(code_files: DataFrame, count: int, seed: int = 42) -> Negatives:
    """``count`` pairs of different texts, each from one hash-drawn repository.

    Draw d picks a repository that holds different texts and two of its files;
    equal texts are rejected and the draws go on until ``count`` are left.  Draws
    are numbered, so the batches never change the result; each batch is as large
    as the share accepted so far asks for.
    """
    spark = code_files.sparkSession
    slots = staged(files_in_repos(code_files), "repo-files")
    repos = staged(drawable_repos(slots), "drawable-repos")
    n_repos = repos.count()
    if n_repos == 0 or count <= 0:
        empty = "draw bigint, left_id bigint, right_id bigint, place bigint"
        return Negatives(spark.createDataFrame([], empty), max(count, 0))
    if n_repos <= BROADCAST_ROWS:
        repos = F.broadcast(repos)

    def batch(start: int, size: int) -> DataFrame:
        draws = spark.range(start, start + size).withColumnRenamed("id", "draw")
        draws = draws.withColumn(
            "repo_no", F.pmod(seeded_hash(f"repo-{seed}", F.col("draw")), F.lit(n_repos))
        ).join(repos, "repo_no")
        one, two = _two_slots(F.col("draw"), F.col("n_files"), f"file-{seed}")
        draws = draws.select("draw", "repo", one.alias("i"), two.alias("j"))
        left = slots.select("repo", F.col("idx").alias("i"), F.col("file_id").alias("left_id"), F.col("sha").alias("left_sha"))
        right = slots.select("repo", F.col("idx").alias("j"), F.col("file_id").alias("right_id"), F.col("sha").alias("right_sha"))
        both = salted_join(draws, left, ["repo", "i"], "draw", rows=size)
        both = salted_join(both, right, ["repo", "j"], "draw", rows=size)
        return both.filter("left_sha <> right_sha").select("draw", "left_id", "right_id")

    found, have, start, size = None, 0, 0, math.ceil(count * 1.3) + _SPARE
    while have < count:
        part = staged(batch(start, size), "draws")
        have += part.count()
        start += size
        found = part if found is None else found.unionByName(part)
        accepted = max(have, 1) / start
        size = math.ceil((count - have) / accepted * 1.2) + _SPARE
    return Negatives(_first(found, ["draw"], count, "place"), 0)


def any_repo_negatives(code_files: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """Pairs of two independent draws over all files; equal draws are left out, not redrawn.

    As in the original flow there are never more draws than files less one.
    """
    spark = code_files.sparkSession
    slots = staged(dense_index(code_files.select("file_id"), ["file_id"]), "files")
    n_files = slots.count()
    drawn = spark.range(min(draws, max(n_files - 1, 0))).withColumnRenamed("id", "draw")
    i = F.pmod(seeded_hash(f"any-first-{seed}", F.col("draw")), F.lit(n_files))
    j = F.pmod(seeded_hash(f"any-second-{seed}", F.col("draw")), F.lit(n_files))
    drawn = drawn.select("draw", i.alias("i"), j.alias("j")).filter("i <> j")
    left = slots.select(F.col("idx").alias("i"), F.col("file_id").alias("left_id"))
    right = slots.select(F.col("idx").alias("j"), F.col("file_id").alias("right_id"))
    both = salted_join(salted_join(drawn, left, "i", "draw", rows=draws), right, "j", "draw", rows=draws)
    return both.select("draw", "left_id", "right_id")


@dataclass
class PairSample:
    """A labelled pair set and how many of the wanted pairs do not exist."""

    pairs: DataFrame
    shortfall: int


def sample_pairs(
    code_files: DataFrame,
    num_pairs: int = 1000,
    clone_types: str = "mixed",
    negatives: str = "same_repo",
    seed: int = 42,
) -> PairSample:
    """Pairs (pair_id, left_id, right_id, kind, label): positives, then negatives.

    With ``same_repo`` the negatives fill all the places the positives leave;
    with ``any`` they are ``num_pairs // 2`` draws, minus the equal ones.
    """
    wanted = num_pairs // 2
    n_files = code_files.count()
    n_positive = min(wanted, n_files)
    positives = positive_pairs(code_files, wanted, clone_types)
    if negatives == "any":
        drawn = dense_index(any_repo_negatives(code_files, wanted, seed), ["draw"], name="place")
        shortfall = 0
    else:
        found = same_repo_negatives(code_files, num_pairs - n_positive, seed)
        drawn, shortfall = found.pairs, found.shortfall
    others = drawn.select(
        (F.col("place") + n_positive).cast("bigint").alias("pair_id"),
        "left_id",
        "right_id",
        F.lit(NEGATIVE).alias("kind"),
        F.lit(0).cast("bigint").alias("label"),
    )
    return PairSample(positives.unionByName(others), shortfall)


def pair_set(code_files: DataFrame, num_pairs: int = 1000, *args, **kwargs) -> DataFrame:
    """The pairs of ``sample_pairs``; warns if some of the wanted ones do not exist."""
    found = sample_pairs(code_files, num_pairs, *args, **kwargs)
    if found.shortfall:
        warnings.warn(f"{found.shortfall} of {num_pairs} pairs do not exist: no repository holds two different texts", stacklevel=2)
    return found.pairs


def mutants_of(code_files: DataFrame, pairs: DataFrame, seed: int = 42) -> DataFrame:
    """The mutated files the pairs refer to, as further ``code_files`` rows."""
    wanted = pairs.filter(F.col("kind") == MUTATED).select(F.col("left_id").alias("file_id"))
    originals = shuffled_join(code_files, wanted, "file_id", "left_semi")
    changed = mutate_code(originals, seed)
    return changed.select(mutant_id(F.col("file_id")).alias("file_id"), "content")


def files_of_pairs(code_files: DataFrame, pairs: DataFrame, seed: int = 42) -> DataFrame:
    """(file_id, content) of every file in a pair, each once, mutants included."""
    used = pairs.select(F.explode(F.array("left_id", "right_id")).alias("file_id")).distinct()
    originals = shuffled_join(code_files.select("file_id", "content"), used, "file_id", "left_semi")
    return originals.unionByName(mutants_of(code_files, pairs, seed))


def class_distribution(pairs: DataFrame) -> DataFrame:
    """(label, n)."""
    return pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def dataset_shape(features: DataFrame, feature_columns: list[str]) -> DataFrame:
    """(n_rows, n_columns)."""
    return features.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(feature_columns)).cast("bigint").alias("n_columns")
    )


def pair_texts(pairs: DataFrame, files: DataFrame, separator: str) -> DataFrame:
    """(pair_id, label, text): both contents joined by ``separator``."""
    left = files.select(F.col("file_id").alias("left_id"), F.col("content").alias("left_content"))
    right = files.select(F.col("file_id").alias("right_id"), F.col("content").alias("right_content"))
    rows = pairs.count()
    both = salted_join(pairs, left, "left_id", "pair_id", rows=rows)
    both = salted_join(both, right, "right_id", "pair_id", rows=rows)
    return both.select(
        "pair_id", "label", F.concat_ws(separator, "left_content", "right_content").alias("text")
    )
