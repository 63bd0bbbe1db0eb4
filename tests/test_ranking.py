"""Exact ranks and splits against pandas, with hot keys, ties and missing groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clonelens.functions import skew
from clonelens.functions.ranking import dense_index, hash_index, hash_quota, running_totals
from clonelens.operators import prepare


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    n = 3000
    group = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abc"), n))
    return pd.DataFrame({"id": rng.permutation(n), "g": group, "v": rng.integers(0, 20, n).astype(float)})


def test_dense_index(spark, rows):
    got = dense_index(spark.createDataFrame(rows), ["v", "id"]).toPandas().sort_values("idx")
    want = rows.sort_values(["v", "id"])
    assert got["idx"].tolist() == list(range(len(rows))) and got["id"].tolist() == want["id"].tolist()


def test_dense_index_per_group_with_missing_group(spark, rows):
    df = spark.createDataFrame(rows).withColumn("g", F.when(F.col("g") != "a", F.col("g")))
    got = dense_index(df, ["id"], by=["g"]).toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("g", dropna=False):
        assert part.sort_values("id")["idx"].tolist() == list(range(len(part)))


def test_running_totals(spark, rows):
    df = spark.createDataFrame(rows)
    got = running_totals(df, ["id"], {"before": F.col("v")}, by=["g"]).toPandas().sort_values("id")
    want = rows.sort_values("id").groupby("g")["v"].cumsum() - rows.sort_values("id")["v"]
    assert np.allclose(got["before"], want)


def test_one_value_and_empty(spark):
    one = spark.createDataFrame([(1, 5.0)] , "id bigint, v double")
    assert dense_index(one, ["v", "id"]).first()["idx"] == 0
    assert dense_index(one.filter("id > 1"), ["v"]).count() == 0


def test_hash_order_does_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame(rows)
    a = {r["id"]: r["idx"] for r in hash_index(df.repartition(2), "id", "s").collect()}
    b = {r["id"]: r["idx"] for r in hash_index(df.repartition(13), "id", "s").collect()}
    assert a == b and sorted(a.values()) == list(range(len(rows)))


def test_quota_per_group(spark, rows):
    got = hash_quota(spark.createDataFrame(rows), "id", "s", 0.2, ["g"]).toPandas()
    for g, part in rows.groupby("g"):
        chosen = got[(got["g"] == g) & got["chosen"]]
        assert len(chosen) == int(np.ceil(0.2 * len(part)))


def test_fold_sizes(spark, rows):
    df = spark.createDataFrame(rows)
    sizes = prepare.kfold(df, "id").groupBy("fold").count().toPandas()["count"]
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1
    per = prepare.stratified_folds(df, "id", "g").groupBy("g", "fold").count().toPandas()
    spread = per.groupby("g")["count"].agg(["min", "max", "size"])
    assert (spread["max"] - spread["min"] <= 1).all() and (spread["size"] == 10).all()


def test_fewer_rows_than_folds(spark):
    df = spark.range(4).select(F.col("id").alias("row_id"), F.lit(1).alias("label"))
    assert sorted(r["fold"] for r in prepare.stratified_folds(df).collect()) == [0, 1, 2, 3]


def test_grouped_split_keeps_files_together(spark, rows):
    df = spark.createDataFrame(rows).withColumnRenamed("id", "pair_id").withColumn("left_id", F.col("v"))
    got = prepare.grouped_split(df).toPandas()
    assert len(got) == len(rows) and got.groupby("left_id")["is_test"].nunique().max() == 1


def test_salted_join_equals_a_plain_join(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_GROUP", 100)  # the hot key gets a dozen salts
    many = spark.createDataFrame(rows)
    one = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3)], "g string, w int")
    for how, size in (("inner", rows["g"].isin(["hot", "a", "b"]).sum()), ("left", len(rows))):
        got = skew.salted_join(many, one, "g", "id", how)
        want = many.join(one, "g", how)
        assert got.count() == size
        assert sorted(map(str, got.select("id", "w").collect())) == sorted(map(str, want.select("id", "w").collect()))


def test_scaler_constant_column_and_imputer(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 2.0), (5.0, 5.0, float("nan"))], "a double, b double, c double")
    scaled = prepare.fit_scaler(df, ["a", "b"]).apply(df).toPandas()
    assert np.allclose(scaled["b"], 0) and np.isclose(scaled["a"].std(ddof=0), 1)
    filled = prepare.fit_imputer(df, ["c"]).apply(df).toPandas()
    assert filled["c"].tolist() == [2.0, 2.0, 2.0]
