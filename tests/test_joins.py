"""Joins of two growing tables are not broadcast, whatever their files' sizes suggest."""

from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from clonelens.functions import skew
from clonelens.operators.graph import propagate
from clonelens.operators.syntax import bigram_maps
from clonelens.session import staged, staging_root


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bigram_maps_are_not_broadcast(spark):
    files = spark.createDataFrame([(1, "x = 1"), (2, "y = (")], "file_id bigint, content string")
    found = bigram_maps(staged(files, "files"))
    assert "BroadcastHashJoin" not in _plan(found)
    got = {r["file_id"]: r["bigrams"] for r in found.collect()}
    assert got[2] == {} and got[1]["Module_Assign"] == 1


def test_salted_join_of_a_small_looking_table_is_shuffled(spark):
    many = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("a"))
    one = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("b"))
    joined = skew.salted_join(many, one, "k", "a")
    assert "BroadcastHashJoin" not in _plan(joined) and joined.count() == 10


def test_propagation_does_not_broadcast_nodes(spark, monkeypatch):
    from clonelens.operators import graph

    plans = []

    def watched(df, name, *rest):
        plans.append(_plan(df))
        return real(df, name, *rest)

    real = graph.staged
    monkeypatch.setattr(graph, "staged", watched)
    nodes = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "graph_id bigint, node bigint, x double")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "graph_id bigint, src bigint, dst bigint")
    assert {r["node"]: round(r["x"], 9) for r in propagate(nodes, edges, 1).collect()} == {0: 1.5, 1: 1.5}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_rounds_leave_one_staged_table_and_no_shuffle_files(spark, monkeypatch):
    """What a round has replaced is removed, while the result is that of all messages, repeated nodes and all."""
    root = Path(staging_root(spark))
    local = Path(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].getPath())
    shuffles = lambda: {f.name for f in local.rglob("shuffle_*.data")}
    nodes = [("a", i, float(i)) for i in range(6)] + [("b", 0, 2.0), ("b", 0, 3.0), ("b", 1, 1.0), (None, 1, 1.0)]
    edges = [("a", i, j) for i in range(6) for j in range(i)] + [("b", 0, 1), ("b", 1, 0), ("b", 1, 0), ("a", None, 1)]
    monkeypatch.setattr(skew, "SMALL_GROUP", 4)
    before, files = set(root.iterdir()), shuffles()
    out = propagate(
        spark.createDataFrame(nodes, "graph_id string, node bigint, x double"),
        spark.createDataFrame(edges, "graph_id string, src bigint, dst bigint"),
        2,
    )
    assert len(set(root.iterdir()) - before) == 1 and not shuffles() - files
    links = edges + [(g, n, n) for g, n, _ in nodes]
    degree = Counter((g, d) for g, _, d in links)
    state = [row for row in nodes if row[0] is not None]
    for _ in range(2):
        total = Counter()
        for g, s, d in links:
            for h, n, x in state:
                if (g, s) == (h, n):
                    total[g, d] += x / degree[h, n] ** 0.5
        state = [(g, n, total[g, n] / degree[g, n] ** 0.5) for g, n, _ in state]
    got = sorted((r["graph_id"], r["node"], round(r["x"], 9)) for r in out.collect())
    assert got == sorted((g, n, round(x, 9)) for g, n, x in state)
