import random
import re
from collections import Counter

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from clonelens.llm import mixing as mx


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _targets(sizes):
    """Targets by sharing and cutting until none is above three times its size."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in capped]
        left = total - sum(3 * sizes[n] for n in capped)
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if share[n] > 3 * sizes[n]}
        if not over:
            return {**share, **{n: 3.0 * sizes[n] for n in capped}}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 300}, {"x": 7}, {"a": 0, "b": 0}, {"a": 1, "b": 2, "c": 0, "d": 10_000}])
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(n, s) for n, s in sizes.items()], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mx.source_targets(rows).collect()}
    assert got == pytest.approx(_targets(sizes))


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mx.copies(docs)
    by = plan.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest"),
        F.max("copies").alias("most"),
    ).collect()
    assert len(by) == 20
    for r in by:
        assert abs(r["taken"] - r["target"]) <= 0.5 * r["largest"] and r["most"] <= mx.MAX_COPIES


def test_rows_come_out_as_often_as_planned(documents, odd_documents):
    docs = documents(odd_documents)
    want = Counter()
    for r in mx.copies(docs).collect():
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    out = mx.mix(docs)
    assert out.schema == docs.schema
    got = Counter((r["doc_id"], r["source"], _words(r["text"])) for r in out.collect())
    assert got == +want


def test_a_repeated_row_counts_as_often_as_it_stands_there(documents):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(50, 400)), "a" if i % 2 else "b") for i in range(400)]
    rows += [(1000, " ".join(["v"] * 700), "a")] * 151
    docs = documents(rows)
    plan = mx.copies(docs).collect()
    assert len(plan) == len(rows)
    for source in "ab":
        own = [r for r in plan if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 700 and max(r["copies"] for r in own) <= mx.MAX_COPIES
    repeated = [r["copies"] for r in plan if r["doc_id"] == 1000]
    assert len(repeated) == 151 and max(repeated) - min(repeated) <= 1
    assert mx.mix(docs).filter("doc_id = 1000").count() == sum(repeated)


def test_reruns_and_other_partitions_agree(documents, odd_documents, spark):
    first = mx.copies(documents(odd_documents)).select("doc_id", "size", "copies").collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = mx.copies(documents(odd_documents[::-1]).repartition(5)).select("doc_id", "size", "copies").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(repr, first)) == sorted(map(repr, again))


def test_empty_table(documents):
    assert mx.copies(documents([])).count() == 0 and mx.mix(documents([])).count() == 0


def test_query_equals_sql(spark):
    assert differences(mx.op1_mixing(spark, "/root/testdata/sf0.001"), connect("0.001"), mx.OP1_SQL) == []
