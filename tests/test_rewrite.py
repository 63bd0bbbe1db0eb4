"""Mutants: same shape, consistent and injective names, termination."""

import ast
import keyword

import pytest
from pyspark.sql import functions as F

from clonelens.operators import rewrite
from clonelens.operators.metrics import METRICS, file_metrics

SAMPLE = '''
def my_function(a, b, *rest, key=None, **more):
    # a comment
    result = a + b.attribute
    return [print(result, i) for i in rest]

class Thing:
    async def run(self):
        x = True
        del x

x = 10
z = my_function(x, 20, key=3)
'''
ONE_LETTER = "\n".join(f"{c} = 1" for c in "abcdefghijklmnopqrstuvwxyzABCD")
LONG = "a_very_long_name_that_is_longer_than_thirty_two_characters = 1\n"


@pytest.fixture(scope="module")
def sources(spark):
    texts = [SAMPLE, ONE_LETTER, LONG, "def broken(:", "x = 1\n", ""]
    return spark.createDataFrame(list(enumerate(texts)), "file_id bigint, content string").cache()


def _texts(df):
    return {r["file_id"]: r["content"] for r in df.collect()}


def _shape(text):
    return [type(n).__name__ for n in ast.walk(ast.parse(text))]


def test_renaming_keeps_the_shape(sources):
    before, after = _texts(sources), _texts(rewrite.rename_variables(sources))
    assert after[3] == before[3]  # unparsable: unchanged
    for i in (0, 1, 2, 4, 5):
        assert _shape(before[i]) == _shape(after[i])
    assert "attribute" in after[0] and "Thing" in after[0] and "key" in after[0] and "comment" not in after[0]
    assert "my_function" not in after[0] and "print" not in after[0]


def test_names_are_consistent_and_injective(sources):
    for row in rewrite.rename_maps(sources).collect():
        if row["renames"] is None:
            continue
        new = list(row["renames"].values())
        assert len(set(new)) == len(new)
        for old, name in row["renames"].items():
            assert name != old and not keyword.iskeyword(name) and name.isidentifier()
            assert len(name) == len(old) or name[-1].isdigit()


def test_names_not_to_change(sources):
    names = {r["file_id"]: r["renames"] for r in rewrite.rename_maps(sources).collect()}
    assert set(names[0]) == {"my_function", "a", "b", "result", "print", "i", "rest", "x", "z"}
    assert len(names[1]) == 30 and names[3] is None


def test_redundant_statement(sources):
    before, after = _texts(sources), _texts(rewrite.add_redundant_statement(sources))
    assert _shape(after[0]).count("Pass") == _shape(before[0]).count("Pass") + 1
    assert "my_function" not in after[0]
    assert after[4] == before[4]  # no function: unchanged, names too
    kept = _texts(rewrite.add_redundant_statement(sources, also_rename=False))
    assert "def my_function(a, b" in kept[0] and "pass" in kept[0]


def test_mutants_keep_the_syntax_metrics(sources):
    line_based = {"num_lines", "avg_line_length", "num_comments", "maintainability_index"}
    before = {r["file_id"]: r for r in file_metrics(sources).collect()}
    after = {r["file_id"]: r for r in file_metrics(rewrite.mutate_code(sources)).collect()}
    # a deleted name keeps its old name, so the sample with 'del x' has one name more
    named = {"vocabulary_size", "halstead_volume"}
    assert after[0]["vocabulary_size"] == before[0]["vocabulary_size"] + 1
    for i, row in before.items():
        for m in set(METRICS) - line_based - (named if i == 0 else set()):
            assert row[m] == after[i][m], (i, m)


def test_both_mutations_occur(spark):
    ids = spark.range(1000).select("id", rewrite.chosen_mutation(F.col("id")).alias("m"))
    counts = {r["m"]: r["count"] for r in ids.groupBy("m").count().collect()}
    assert 400 < counts[rewrite.RENAME] < 600 and sum(counts.values()) == 1000
