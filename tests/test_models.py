"""Models against direct numpy solutions, and quality floors on separable data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonelens.models import margins, moments, neighbours, online
from clonelens.models.extra_trees import ExtraTrees
from clonelens.models.registry import MODELS, NEURAL_MODELS, make
from clonelens.operators import stacking
from clonelens.operators.evaluate import all_scores, class_scores, roc_auc, roc_points, trapezoid_area
from clonelens.operators.leaderboard import feature_importance
from clonelens.operators.neighbours import nearest_neighbours
from clonelens.operators.prepare import kfold, standard_scale, stratified_split, vector_columns
from clonelens.plans import bakeoff, experiments
from clonelens.session import staged
from clonelens.sources.synthetic import synthetic
from clonelens.sources.tables import RESULTS, export_report, read_table


@pytest.fixture(scope="module")
def data(spark):
    rows = staged(stratified_split(synthetic(spark, 400, 6)), "rows")
    return rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test").drop("is_test")


@pytest.fixture(scope="module")
def arrays(data):
    pdf = data[0].toPandas()
    return np.stack(pdf["x"].to_list()), pdf["label"].to_numpy()


def test_synthetic_moments(spark):
    pdf = synthetic(spark, 4000, 2).toPandas()
    x = np.stack(pdf["x"].to_list())
    for label, mean, std in ((0, 3.0, 2.0), (1, 1.0, 1.5)):
        part = x[pdf["label"] == label]
        assert len(part) == 2000
        assert np.allclose(part.mean(axis=0), mean, atol=0.2) and np.allclose(part.std(axis=0), std, atol=0.2)


def _ridge(x, y, alpha):
    s = np.where(y == 1, 1.0, -1.0)
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (s - s.mean()))
    return w, s.mean() - x.mean(axis=0) @ w


def test_ridge(data, arrays):
    fitted = moments.Ridge().fit(data[0])
    w, b = _ridge(*arrays, 1.0)
    assert np.allclose(fitted.weights, w) and np.isclose(fitted.bias, b)


def test_ridge_cv(data, arrays):
    model = moments.RidgeCv()
    fitted = model.fit(data[0])
    w, b = _ridge(*arrays, model.chosen)
    assert model.chosen in (0.1, 1.0, 10.0) and np.allclose(fitted.weights, w) and np.isclose(fitted.bias, b)


def test_lda_and_qda(data, arrays):
    x, y = arrays
    means = [x[y == c].mean(axis=0) for c in (0, 1)]
    scatter = sum((x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in (0, 1))
    w = np.linalg.solve(scatter / (len(x) - 2), means[1] - means[0])
    assert np.allclose(moments.Lda().fit(data[0]).weights, w)
    got = moments.Qda().fit(data[0]).score(data[0]).toPandas().sort_values("row_id")
    pdf = data[0].toPandas().sort_values("row_id")
    x = np.stack(pdf["x"].to_list())
    logs = []
    for c in (0, 1):
        cov = np.cov(x[pdf["label"] == c].T)
        d = x - x[pdf["label"] == c].mean(axis=0)
        prior = np.log((pdf["label"] == c).mean())
        logs.append(prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(got["score"], 1 / (1 + np.exp(logs[0] - logs[1])))


def test_constant_feature_does_not_break_the_solves(spark, data):
    rows = data[0].withColumn("x", F.concat("x", F.array(F.lit(0.0))))
    for model in (moments.Ridge(), moments.Lda(), moments.Qda(), margins.LinearSvm()):
        assert class_scores(model.fit(rows).score(rows)).first()["accuracy"] > 0.8


def test_linear_svm_is_at_the_minimum(data, arrays):
    x, y = arrays
    z, s = np.column_stack([np.ones(len(x)), x]), np.where(y == 1, 1.0, -1.0)
    fitted = margins.LinearSvm().fit(data[0])
    w = np.array([fitted.bias, *fitted.weights])
    short = np.maximum(0, 1 - s * (z @ w))
    gradient = w - 2 * z.T @ (s * short)
    assert np.linalg.norm(gradient) < 1e-2


def test_logistic_is_at_the_minimum(data, arrays):
    x, y = arrays
    z, s = np.column_stack([np.ones(len(x)), x]), np.where(y == 1, 1.0, -1.0)
    fitted = margins.Logistic().fit(data[0])
    w = np.array([fitted.bias, *fitted.weights])
    gradient = np.array([0.0, *w[1:]]) - z.T @ (s / (1 + np.exp(s * (z @ w))))
    assert np.linalg.norm(gradient) < 0.05


def _clustered(spark, n=300, size=5):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (6, size))
    x = centres[rng.integers(0, 6, n)] + rng.normal(0, 0.3, (n, size))
    x[: n // 3] = x[0]  # a third of all rows is the same vector
    y = rng.integers(0, 2, n)
    rows = [(i, int(y[i]), x[i].tolist()) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "row_id bigint, label bigint, x array<double>")


def test_nearest_neighbours_equal_brute_force(spark):
    x, y, df = _clustered(spark)
    got = nearest_neighbours(df.filter("row_id % 3 = 0"), df, 5, block_rows=16).collect()
    near = {}
    for r in got:
        near.setdefault(r["row_id"], {})[r["rank"]] = r["neighbour_id"]
    gaps = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    for i in range(0, len(x), 3):
        want = sorted(range(len(x)), key=lambda j: (gaps[i, j], j))[:5]
        assert [near[i][k] for k in range(1, 6)] == want


def test_neighbours_far_from_the_origin_stay_exact(spark):
    """The matrix product that selects candidates rounds; what it selects is computed anew."""
    x, _, df = _clustered(spark)
    moved = df.withColumn("x", F.transform("x", lambda v: v + 1e5))
    x = x + 1e5
    got = nearest_neighbours(moved.filter("row_id % 7 = 0"), moved, 5, block_rows=16).collect()
    gaps = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    found = {(r["row_id"], r["rank"]): (r["distance"], r["neighbour_id"]) for r in got}
    for i in range(0, len(x), 7):
        want = sorted((gaps[i, j], j) for j in range(len(x)))[:5]
        assert [found[i, k] for k in range(1, 6)] == want


def test_groups_of_queries_are_bounded():
    """Neighbouring small cells share a group, a large cell has several: points are not sent once per cell."""
    from clonelens.operators.neighbours import _Cells, _groups

    pivots = np.arange(10.0)[:, None]
    counts = {c: 10 for c in range(9)} | {9: 95}
    groups = _groups(_Cells(None, counts, {}), pivots, 40)
    assert groups[9] == (3, 3) and sorted({groups[c] for c in range(9)}) == [(0, 1), (1, 1), (2, 1)]


def test_fewer_points_than_k(spark):
    _, _, df = _clustered(spark, 9)
    got = nearest_neighbours(df, df.filter("row_id < 2"), 5).groupBy("row_id").count().collect()
    assert len(got) == 9 and {r["count"] for r in got} == {2}


def test_kernel_vote_and_spreading_equal_dense_matrices(spark):
    x, y, df = _clustered(spark)
    gamma, alpha = 2.0, 0.2
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    hot = np.eye(2)[y]
    got = neighbours.LabelPropagation(gamma, 16).fit(df).score(df).toPandas().sort_values("row_id")
    votes = kernel @ hot
    assert np.allclose(got["score"], votes[:, 1] / votes.sum(axis=1))
    w = kernel - np.diag(np.diag(kernel))
    degree = w.sum(axis=1)
    root = np.sqrt(np.where(degree > 0, degree, 1.0))
    s = w / root[:, None] / root[None]
    f = hot
    for _ in range(30):
        new = alpha * s @ f + (1 - alpha) * hot
        moved, f = np.abs(new - f).sum(), new
        if moved < 1e-3:
            break
    f = f / f.sum(axis=1, keepdims=True)
    votes = kernel @ f
    got = neighbours.LabelSpreading(gamma, alpha, block_rows=16).fit(df).score(df).toPandas().sort_values("row_id")
    assert np.allclose(got["score"], votes[:, 1] / votes.sum(axis=1), atol=1e-9)


def test_far_query_has_no_score(spark):
    _, _, df = _clustered(spark, 30)
    far = spark.createDataFrame([(1, 1, [1e6] * 5)], "row_id bigint, label bigint, x array<double>")
    row = neighbours.LabelPropagation().fit(df).score(far).first()
    assert row["score"] is None and row["prediction"] == 0


def test_one_step_updates():
    z, sign = np.array([[1.0, 1.0, 0.0], [1.0, 0.0, 1.0]]), np.array([1.0, -1.0])
    w, loss = online.one_step("perceptron", z, sign, np.zeros(3), 0.0)
    assert w.tolist() == [0.0, 0.5, -0.5] and loss == 0.0
    w, loss = online.one_step("passive_aggressive", z[:1], sign[:1], np.zeros(3), 0.0)
    assert np.allclose(w, [0.5, 0.5, 0.0]) and loss == 1.0
    assert online._sgd_rate(1000.0) < online._sgd_rate(0.0)


@pytest.mark.parametrize("kind", ["sgd", "perceptron", "passive_aggressive"])
def test_online_models_do_not_depend_on_partitions(wide_data, kind):
    train, test = wide_data
    fitted = [online.Online(kind, max_epochs=4).fit(train.repartition(n)) for n in (1, 4, 8)]
    assert fitted[0].weights == fitted[1].weights == fitted[2].weights
    assert [f.bias for f in fitted] == [fitted[0].bias] * 3


@pytest.fixture(scope="module")
def wide_data(spark):
    """The two Gaussian classes with all 34 features, split and scaled as the models' input always is."""
    wide, names = vector_columns(stratified_split(staged(synthetic(spark, 400), "raw")), 34)
    scaled = standard_scale(wide, names)
    rows = staged(scaled.select("row_id", "label", "is_test", F.array(*names).alias("x")), "rows")
    return rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test").drop("is_test")


# a single tree is weaker by nature than the rest
FLOORS = {"DecisionTree": 0.7}


@pytest.mark.parametrize("name", [*MODELS, *NEURAL_MODELS])
def test_quality_floor(wide_data, name):
    train, test = wide_data
    if name in ("LabelPropagation", "LabelSpreading"):
        model = type(make(name))(gamma=0.05)  # the default width is meant for scaled features
    else:
        model = make(name)
    scored = staged(model.fit(train).score(test), "floor")
    assert scored.columns == ["row_id", "label", "score", "prediction"]
    assert scored.count() == test.count()
    assert all_scores(scored)["accuracy"] > FLOORS.get(name, 0.8)


def test_extra_trees_fit_the_training_rows(data):
    fitted = ExtraTrees(trees=10).fit(data[0])
    assert class_scores(fitted.score(data[0])).first()["accuracy"] == 1.0
    assert np.isclose(sum(fitted.importances()), 1.0)
    names = [f"x{i}" for i in range(6)]
    top = feature_importance(experiments.named_importances(fitted, names, data[0]), 3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[1]["importance"]


def test_extra_trees_split_in_spark_and_locally(data):
    """A forest whose top is split in Spark and one grown by single tasks are both whole."""
    n = data[0].count()
    for local in (10**6, n // 4):
        fitted = ExtraTrees(trees=5, local_rows=local).fit(data[0])
        assert class_scores(fitted.score(data[0])).first()["accuracy"] == 1.0
        assert (fitted.forest.feature >= 0).any() == (local < n)
        assert fitted.score(data[1]).count() == data[1].count()
    alone = [ExtraTrees(trees=3).fit(data[0].repartition(k)).score(data[1]).orderBy("row_id").collect() for k in (1, 6)]
    assert alone[0] == alone[1]


def test_extra_trees_one_class(data):
    ones = data[0].filter("label = 1")
    assert ExtraTrees(trees=3).fit(ones).score(ones).agg(F.min("score")).first()[0] == 1.0


LIGHT = ["Ridge", "LDA", "NearestCentroid", "DecisionTree"]


def test_stacking_scores_each_row_once(data):
    oof = stacking.out_of_fold_scores(data[0], ["LDA", "NearestCentroid"], make)
    counts = oof.groupBy("row_id", "model").count().toPandas()
    assert (counts["count"] == 1).all() and len(counts) == 2 * data[0].count()
    meta = stacking.meta_features(oof, ["LDA", "NearestCentroid"])
    filled, test, _ = stacking.impute_meta(meta, ["LDA", "NearestCentroid"])
    assert test is None and filled.count() == data[0].count()


def test_stack_search(data):
    found = stacking.search_stacks(data[0], data[1], LIGHT, make).toPandas()
    assert len(found) == 4 and (found["accuracy"] > 0.8).all()
    place = {name: at for at, name in enumerate(LIGHT)}
    bases = [tuple(b) for b in found.sort_values("seq")["base_classifiers"]]
    assert all(list(b) == sorted(b, key=place.get) for b in bases) and len(set(bases)) == 4 and bases == sorted(bases)


def test_best_stack_name(spark):
    rows = [(["a", "b", "c"], "d", 0.9, 0.9, 0.9, 0.8, 1.0, 0), (["a", "b", "d"], "c", 0.9, 0.9, 0.9, 0.9, 1.0, 1)]
    schema = (
        "base_classifiers array<string>, meta_classifier string, accuracy double, balanced_accuracy double, "
        "roc_auc double, f1_score double, time_ms double, seq bigint"
    )
    assert stacking.best_stack(spark.createDataFrame(rows, schema)).first()["model"] == "MetaClassifier (a, b, d)"


def test_extratrees_experiment(data):
    table = experiments.extratrees_experiment(data[0], data[1], ["LDA", "Ridge"]).toPandas()
    assert table["model"].tolist() == ["Single ExtraTrees", "Stacking_Ensemble_ET_Meta"]
    assert (table["accuracy"] > 0.8).all() and (table["time_ms"] > 0).all()


def test_cross_validation_and_learning_curve(data):
    folds = experiments.cross_validated_f1(data[0], ["LDA"], folds=4).toPandas()
    assert sorted(folds["fold"]) == [0, 1, 2, 3] and (folds["cv_f1"] > 0.8).all()
    curve = experiments.learning_curve(data[0], ["LDA"], folds=2).toPandas()
    assert len(curve) == 10 and curve.groupby("fold")["size"].apply(lambda s: s.is_monotonic_increasing).all()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_fits_leave_no_common_plan(data):
    """Every fit's scores are finished on their own: the result does not run the models again."""
    curve = experiments.learning_curve(data[0], ["LDA"], folds=2)
    folds = experiments.cross_validated_f1(data[0], ["LDA"], folds=2)
    assert "Union" not in _plan(curve) and "Union" not in _plan(folds)
    for scores in (
        stacking.out_of_fold_scores(data[0], ["DecisionTree"], make, folds=2),
        stacking.refit_scores(data[0], data[1], ["DecisionTree"], make),
    ):
        assert "InArrow" not in _plan(scores)


def test_staged_folds_are_read_apart(data):
    folded = staged(kfold(data[0]), "folded", by=["fold"])
    assert folded.columns == [*data[0].columns, "fold"] and folded.count() == data[0].count()
    one = folded.filter("fold = 2")
    assert "PartitionFilters: [isnotnull(fold" in one._jdf.queryExecution().executedPlan().toString()


class _Broken:
    def fit(self, train):
        raise ValueError("cannot fit")


def test_failures_are_listed_and_results_exported(spark, data, tmp_path):
    out = bakeoff.bake_off(
        [("LDA", "t", moments.Lda, *data), ("Broken", "t", _Broken, *data), ("Ridge", "t", moments.Ridge, *data)]
    )
    assert [r["model"] for r in out.results.orderBy("seq").collect()] == ["LDA", "Ridge"]
    assert out.failures.first()["error"] == "ValueError: cannot fit"
    export_report(out.results, str(tmp_path / "report"))
    for kind in ("csv", "json"):
        back = read_table(spark, f"{tmp_path}/report/{kind}", RESULTS, kind).toPandas()
        assert sorted(back["model"]) == ["LDA", "Ridge"] and back["f1_score"].notna().all()


def test_auc_equals_curve_area_and_hard_labels(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.random() < 0.4), float(rng.integers(0, 30)), int(rng.random() < 0.5)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id bigint, label bigint, score double, prediction bigint")
    auc = roc_auc(df).first()[0]
    for drop in (True, False):
        assert np.isclose(trapezoid_area(roc_points(df, drop_intermediate=drop)).first()[0], auc)
    balanced = class_scores(df).first()["balanced_accuracy"]
    assert np.isclose(roc_auc(df, "prediction").first()[0], balanced)
    missing = df.withColumn("score", F.when(F.col("row_id") > 0, F.col("score")))
    assert roc_auc(missing).first()[0] == 0.0


def test_f1_of_nothing(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label bigint, prediction bigint")
    row = class_scores(df).first()
    assert (row["f1_score"], row["balanced_accuracy"], row["accuracy"]) == (0.0, 1.0, 1.0)


def test_the_net_handles_a_large_batch_in_steps():
    """A task's memory does not follow the size of an Arrow batch."""
    import pyarrow as pa

    from clonelens.models.net import STEP, _steps

    batch = pa.RecordBatch.from_arrays([pa.array(range(5000))], names=["at"])
    pieces = list(_steps([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in pieces) <= STEP
    assert [v for p in pieces for v in p.column("at").to_pylist()] == list(range(5000))


def test_quadratic_scores_far_from_the_origin(spark):
    """The densities' large terms do not cancel out."""
    mean = np.array([1e7 + 0.1, 3e7 + 0.7])
    fitted = moments.FittedQda((np.eye(2), mean, 0.0), (np.eye(2) * 2.0, mean + 1.0, 0.0))
    x = mean + np.array([0.3, 0.15])
    df = spark.createDataFrame([(1, 0, x.tolist())], "row_id bigint, label bigint, x array<double>")
    margin = -((x - mean - 1.0) ** 2).sum() + 0.5 * ((x - mean) ** 2).sum()
    assert fitted.score(df).first()["score"] == pytest.approx(1.0 / (1.0 + np.exp(-margin)), abs=1e-6)
