"""Pair sampling: batch size, shortfall, degenerate inputs, plans."""

import pytest
from pyspark.sql import functions as F

from clonelens.operators import pairs as pr
from clonelens.operators.metrics import METRICS, file_metrics
from clonelens.operators.pair_features import FEATURES, pair_features


def _files(spark, rows):
    return spark.createDataFrame(rows, "file_id bigint, repo string, path string, content string")


def test_equal_texts_give_a_shortfall(spark):
    files = _files(spark, [(i, "r", f"r/{i}.py", "x = 1") for i in range(5)])
    found = pr.same_repo_negatives(files, 4)
    assert found.pairs.count() == 0 and found.shortfall == 4


def test_single_file_repositories_are_not_drawn(spark):
    files = _files(spark, [(1, "a", "a/1.py", "x"), (2, "b", "b/1.py", "y")])
    assert pr.same_repo_negatives(files, 3).shortfall == 3
    assert pr.multi_file_repos(files).count() == 0


def test_short_positives_are_filled_with_negatives(spark):
    files = _files(spark, [(i, "r", f"r/{i}.py", f"x = {i}") for i in range(4)])
    pairs = pr.pair_set(files, 20).toPandas()
    assert (pairs["label"] == 1).sum() == 4 and len(pairs) == 20
    assert sorted(pairs["pair_id"]) == list(range(20))
    assert (pairs[pairs["label"] == 0]["left_id"] != pairs[pairs["label"] == 0]["right_id"]).all()


def test_exact_copies_have_no_difference(spark):
    files = _files(spark, [(i, "r", f"r/{i}.py", f"def f(a):\n    return a + {i}\n") for i in range(6)])
    pairs = pr.pair_set(files, 6, clone_types="exact")
    found = pair_features(pairs, file_metrics(pr.files_of_pairs(files, pairs))).toPandas()
    clones = found[found["label"] == 1]
    assert (clones[[f"{m}_diff" for m in METRICS]] == 0).all().all()
    assert found.columns.tolist() == ["pair_id", "label", *FEATURES]
    assert pr.dataset_shape(pair_features(pairs, file_metrics(files)), FEATURES).first()["n_columns"] == 34


def test_mutants_are_extra_files(spark):
    files = _files(spark, [(i, "r", f"r/{i}.py", f"def f(a):\n    return a + {i}\n") for i in range(6)])
    pairs = pr.pair_set(files, 6)
    mutated = pairs.filter(F.col("kind") == pr.MUTATED)
    assert mutated.count() == 1 and mutated.first()["right_id"] == -2
    texts = {r["file_id"]: r["content"] for r in pr.files_of_pairs(files, pairs).collect()}
    assert texts[-2] != texts[1]


@pytest.mark.parametrize("n", [7, 200])
def test_positives_are_the_first_files_in_path_order(spark, n):
    rows = [(i, "r", f"r/{i * 7919 % 500:03d}.py", "x") for i in range(300)]
    found = pr.positive_pairs(_files(spark, rows), n, "exact").collect()
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))[:n]]
    assert [r["left_id"] for r in sorted(found, key=lambda r: r["pair_id"])] == want


def test_the_set_is_filled_from_one_differing_text(spark):
    files = _files(spark, [(i, "r", f"r/{i:04d}.py", "x = 2" if i == 500 else "x = 1") for i in range(1000)])
    sample = pr.sample_pairs(files, 40, "exact")
    pairs = sample.pairs.toPandas()
    negatives = pairs[pairs["label"] == 0]
    assert sample.shortfall == 0 and len(pairs) == 40 and len(negatives) == 20
    assert ((negatives["left_id"] == 500) ^ (negatives["right_id"] == 500)).all()


def test_a_shortfall_is_told(spark):
    files = _files(spark, [(i, "r", f"r/{i}.py", "x = 1") for i in range(6)])
    assert pr.sample_pairs(files, 6, "exact").shortfall == 3
    with pytest.warns(UserWarning, match="3 of 6 pairs"):
        assert pr.pair_set(files, 6, "exact").count() == 3
