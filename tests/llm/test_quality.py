import numpy as np
import pytest

from clonelens.llm import quality as q


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = q.op4_quality(spark, sf).filter("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    score, label = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    above = (score[label == 1][:, None] > score[label == 0][None, :]).mean()
    assert above > 0.95 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_paths_of_a_printed_tree():
    printed = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 3 <= 0.5)
   If (feature 1 <= -2.0)
    Predict: 0.0
   Else (feature 1 > -2.0)
    Predict: 1.0
  Else (feature 3 > 0.5)
   Predict: 1.0
"""
    assert q.tree_paths(printed) == [
        ((3, False, 0.5),), ((1, False, -2.0), (3, False, 0.5)), ((1, True, -2.0), (3, False, 0.5)), ((3, True, 0.5),),
    ]


def test_the_expression_equals_the_rules(spark):
    rules = q.RuleEnsemble([(((0, True, 1.0), (2, False, 5.0)), 2.0), (((1, False, 0.0),), -1.5)], 0.25)
    rows = [[float(i + j) for j in range(len(q.STATISTICS))] for i in range(-3, 4)]
    got = [r[0] for r in spark.createDataFrame(rows, list(q.STATISTICS)).select(rules.score()).collect()]
    odds = [0.25 + 2.0 * (r[0] > 1.0 and r[2] <= 5.0) - 1.5 * (r[1] <= 0.0) for r in rows]
    assert got == pytest.approx([1 / (1 + np.exp(-o)) for o in odds])


@pytest.mark.parametrize("labels", [[], [(1, 1), (4, 1), (99, 0)], [(1, 0), (None, 1), (4, None)]])
def test_odd_documents(documents, odd_documents, spark, labels):
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    rows = q.scored(documents(odd_documents), table).collect()
    assert len(rows) == len(odd_documents)
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] in (0, 1) for r in rows)


def test_empty_table(documents, spark):
    assert q.scored(documents([]), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).count() == 0


def test_statistics_of_odd_texts(odd_documents):
    for _, text, *_ in odd_documents:
        assert np.isfinite(q.statistics((text or "").encode())).all()
