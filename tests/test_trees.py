"""Exact trees, boosting and AdaBoost against brute force, and Spark against one task."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clonelens.models import exact_trees
from clonelens.models.boosted_trees import BoostedTrees, Growth, Tree, binned, gradients, grown, histograms
from clonelens.models.boosting import AdaBoost
from clonelens.models.exact_trees import ExactSubtree, Ranks, best_cuts, bootstrap_weights, decision_tree, random_forest
from clonelens.models.registry import LEVEL_WISE
from clonelens.operators.evaluate import class_scores
from clonelens.session import staging_root

ROWS = "row_id bigint, label bigint, x array<double>"


def make_rows(n, width, digits=1, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), digits)
    label = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=n) * 0.3 > 0).astype(int)
    return x, label


@pytest.fixture(scope="module")
def small(spark):
    x, label = make_rows(500, 5)
    frame = spark.createDataFrame([(i, int(b), v.tolist()) for i, (b, v) in enumerate(zip(label, x))], ROWS)
    return frame.repartition(5), x, label


def gini(w0, w1):
    return 2 * w0 * w1 / (w0 + w1) if w0 + w1 else 0.0


def brute_cut(values, w0, w1):
    """(gain, cut) over all places between two values; the first of equal gains."""
    best = (-np.inf, None)
    distinct = np.unique(values)
    for low, high in zip(distinct, distinct[1:]):
        left = values <= low
        l0, l1, r0, r1 = w0[left].sum(), w1[left].sum(), w0[~left].sum(), w1[~left].sum()
        gain = gini(l0 + r0, l1 + r1) - gini(l0, l1) - gini(r0, r1)
        if gain > best[0] + 1e-12:
            best = (gain, low + (high - low) / 2)
    return best


def test_best_cuts_equal_brute_force(spark, small):
    _, x, label = small
    rng = np.random.default_rng(1)
    weight = rng.integers(0, 4, len(x)).astype(float)
    entries = [
        (node, f, float(x[i, f]), float(w * (1 - b)), float(w * b))
        for node, some in ((3, range(0, 300)), (8, range(250, 500)))
        for i, w, b in ((i, weight[i], label[i]) for i in some)
        for f in range(5)
    ]
    entries += [(9, 0, 1.0, 1.0, 0.0), (9, 0, 1.0, 0.0, 1.0)]  # equal values have no cut
    frame = spark.createDataFrame(entries, "node bigint, feature bigint, value double, w0 double, w1 double")
    found = {(r.node, r.feature): r for r in best_cuts(frame).collect()}
    assert set(found) == {(n, f) for n in (3, 8) for f in range(5)}
    for (node, f), r in found.items():
        some = slice(0, 300) if node == 3 else slice(250, 500)
        w, b = weight[some], label[some]
        gain, cut = brute_cut(x[some, f], w * (1 - b), w * b)
        assert np.isclose(r.gain, gain) and np.isclose(r.cut, cut)


def test_first_cut_of_a_subtree_equals_brute_force(small):
    _, x, label = small
    weight = bootstrap_weights(np.arange(len(x)), 2, 7)
    tree = ExactSubtree(x, label, weight, (1,), 1, 5)
    best = max((brute_cut(x[:, f], weight * (1 - label), weight * label) for f in range(5)), key=lambda g: g[0])
    assert np.isclose(tree.gains.sum(), best[0]) and np.isclose(tree.cut[0], best[1])


def test_tree_in_spark_equals_one_task(small):
    rows, x, label = small
    one, many = decision_tree(), decision_tree()
    many.local_rows = 60
    a = {r.row_id: r.score for r in one.fit(rows).score(rows).collect()}
    b = {r.row_id: r.score for r in many.fit(rows).score(rows).collect()}
    assert a == b and len(a) == len(x)
    distinct = {tuple(v): set() for v in x}
    for v, y in zip(x, label):
        distinct[tuple(v)].add(y)
    assert all(a[i] == label[i] for i, v in enumerate(x) if len(distinct[tuple(v)]) == 1)


def test_forest_in_spark_fits_and_does_not_depend_on_partitions(small):
    rows, x, _ = small
    forest = random_forest(trees=6)
    forest.local_rows = 200
    a = {r.row_id: r.score for r in forest.fit(rows).score(rows).collect()}
    b = {r.row_id: r.score for r in forest.fit(rows.repartition(2)).score(rows).collect()}
    assert a == b and len(a) == len(x)
    assert class_scores(forest.fit(rows).score(rows)).first()["accuracy"] > 0.9


def test_bootstrap_weights_are_poisson():
    weight = np.concatenate([bootstrap_weights(np.arange(20_000), t, 42) for t in range(5)])
    assert abs(weight.mean() - 1) < 0.02 and abs(weight.var() - 1) < 0.04
    assert abs((weight == 0).mean() - np.exp(-1)) < 0.01
    assert not np.array_equal(weight[:20_000], weight[20_000:40_000])


@pytest.mark.parametrize("growth", [Growth(leaves=9, least_rows=5), LEVEL_WISE])
def test_boosting_in_spark_equals_one_task(small, growth):
    rows, x, _ = small
    one = BoostedTrees(trees=12, growth=growth, bins=40).fit(rows)
    many = BoostedTrees(trees=12, growth=growth, bins=40, local_rows=0).fit(rows)
    assert one.trees == many.trees and len(one.trees) == 12
    assert {r.differ for r in many.leaf_rows(rows).selectExpr("n <> by_sums AS differ").collect()} == {False}
    loss = [r.loss for r in one.staged_loss(rows).orderBy("round").collect()]
    assert all(b < a for a, b in zip(loss, loss[1:]))
    assert class_scores(one.score(rows)).first()["accuracy"] > 0.75


def naive_leaf_wise(bins, g, h, growth, width):
    """The best-first tree grown split by split, every histogram counted from the rows."""
    tree, open_leaves = Tree(), {}

    def look(node):
        found = growth.best(histograms(tree, [node], bins, g, h, width)[0])
        if found:
            open_leaves[node] = found

    look(0)
    while open_leaves and tree.feature.count(-1) < growth.leaves:
        node = max(open_leaves, key=lambda n: (open_leaves[n][0], -n))
        _, f, b = open_leaves.pop(node)
        left = tree.split(node, f, b)
        look(left)
        look(left + 1)
    return tree


def test_leaf_wise_order_equals_split_by_split():
    x, label = make_rows(900, 4, digits=2, seed=3)
    cuts = [np.quantile(x[:, f], np.arange(1, 32) / 32) for f in range(4)]
    bins, growth = binned(x, cuts), Growth(leaves=14, least_rows=10)
    g, h = gradients(np.zeros(len(x)), label.astype(float))
    asked = []

    def measure(tree, nodes):
        asked.append(len(nodes))
        return histograms(tree, nodes, bins, g, h, 32)

    tree, _ = grown(measure, growth)
    want = naive_leaf_wise(bins, g, h, growth, 32)
    assert (tree.feature, tree.bin, tree.left) == (want.feature, want.bin, want.left)
    assert len(asked) < 14  # passes, fewer than splits


def test_depth_limit_and_one_class(spark, small):
    rows, *_ = small
    fitted = BoostedTrees(trees=2, growth=Growth(leaves=50, depth=2, least_rows=1)).fit(rows)
    assert all(t.feature.count(-1) <= 4 for t in fitted.trees)
    only = rows.filter("label = 1")
    assert BoostedTrees(trees=2).fit(only).score(only).filter("prediction <> 1").count() == 0


def brute_adaboost(x, label, rounds):
    weight, out = np.full(len(x), 1 / len(x)), []
    for _ in range(rounds):
        best = (-np.inf, None, None)
        for f in range(x.shape[1]):
            gain, cut = brute_cut(x[:, f], weight * (1 - label), weight * label)
            if gain > best[0] + 1e-12:
                best = (gain, f, cut)
        _, f, cut = best
        left = x[:, f] <= cut
        sides = [int(weight[s & (label == 1)].sum() > weight[s & (label == 0)].sum()) for s in (left, ~left)]
        miss = np.where(left, *sides) != label
        error = weight[miss].sum()
        say = np.log((1 - error) / error)
        out.append((f, cut, *sides, say))
        weight[miss] *= np.exp(say)
        weight /= weight.sum()
    return out


@pytest.mark.parametrize("local_rows", [50_000, 0])
def test_adaboost_stumps_equal_brute_force(small, local_rows):
    rows, x, label = small
    stumps = AdaBoost(rounds=6, local_rows=local_rows).fit(rows).stumps
    for s, (f, cut, left, right, say) in zip(stumps, brute_adaboost(x, label, 6), strict=True):
        assert (s.feature, s.left, s.right) == (f, left, right)
        assert np.isclose(s.cut, cut) and np.isclose(s.say, say)


def test_adaboost_stops_at_a_perfect_stump(spark):
    rows = spark.createDataFrame([(i, int(i > 4), [float(i), 0.0]) for i in range(10)], ROWS)
    (stump,) = AdaBoost().fit(rows).stumps
    assert (stump.feature, stump.cut, stump.left, stump.right) == (0, 4.5, 0, 1)


def test_repeated_rows_are_boosted_as_one(spark, monkeypatch):
    """Equal rows are merged with a count, so that the trees are those of all rows and the work that of the distinct ones."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 6, (40, 3)).astype(float)
    rows = [(i, int(x[i % 40, 0] + x[i % 40, 1] > 5), x[i % 40].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id bigint, label bigint, x array<double>")
    sizes = []
    one_task = BoostedTrees._in_one_task
    monkeypatch.setattr(BoostedTrees, "_in_one_task", lambda self, some, size: sizes.append(some.count()) or one_task(self, some, size))
    few = BoostedTrees(trees=5).fit(df)
    assert sizes and sizes[0] <= 40
    monkeypatch.setattr(BoostedTrees, "_merged", staticmethod(lambda some, total: (some.withColumn("n", F.lit(1.0)), total)))
    many = BoostedTrees(trees=5).fit(df)
    assert [(t.feature, t.bin, t.value, t.rows) for t in few.trees] == [(t.feature, t.bin, t.value, t.rows) for t in many.trees]


def test_rows_are_dealt_to_trees_in_small_pieces():
    """A row may go to every tree's job, so a whole Arrow batch at once could become a hundred of them."""
    import pyarrow as pa

    from clonelens.models.extra_trees import _DEALT, _slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["at"])
    pieces = list(_slices([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in pieces) <= _DEALT
    assert [v for p in pieces for v in p.column("at").to_pylist()] == list(range(1000))


def test_tree_code_ships_without_the_package(tmp_path):
    """Tasks can unpickle a model where the package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from clonelens import ship_worker_code

    ship_worker_code()
    (tmp_path / "model").write_bytes(cloudpickle.dumps(random_forest(trees=1)))
    load = "import pickle; pickle.load(open('model', 'rb'))"
    done = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env={"PATH": ""}, capture_output=True, timeout=60, check=False)
    assert done.returncode == 0, done.stderr.decode()[-300:]


def test_counted_and_sorted_values_give_the_same_tree():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 9, 600), rng.normal(size=600), rng.integers(0, 90, 600)]).astype(float)
    label, weight = (x[:, 1] + rng.normal(size=600) > 0).astype(int), rng.integers(0, 4, 600).astype(float)
    ranks = Ranks.of(x)
    trees = []
    for cells in (0, 1 << 20):  # always sorted, always counted
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(exact_trees, "_CELLS", cells)
            trees.append(ExactSubtree(x, label, weight, (3,), 50, 2, ranks))
    a, b = trees
    assert len(a.feature) > 100 and (a.feature, a.cut, a.left, a.share) == (b.feature, b.cut, b.left, b.share)


def test_packed_rows_travel_as_bytes():
    from clonelens.functions.arrays import packed_rows, unpacked_rows

    x = np.random.default_rng(1).normal(size=(7, 3))
    column = pa.chunked_array([packed_rows(x[:4]), packed_rows(x[4:]).slice(1)])
    assert column.type == pa.binary()
    assert np.array_equal(unpacked_rows(column), np.vstack([x[:4], x[5:]]))
    assert len(unpacked_rows(packed_rows(x[:0]))) == 0


def test_boosting_counts_rows_on_the_way_to_counted_leaves_only(small, spark):
    """Margins are staged after every tree, earlier tables are removed, and other branches are not walked."""
    tree = Tree()
    left = tree.split(0, 0, 4)
    below = tree.split(left, 1, 4)
    bins = np.random.default_rng(2).integers(0, 10, (500, 2)).astype(np.int16)
    ends = tree.leaves(bins)
    rows, place = tree.reached(bins, [below + 1, left + 1])
    assert sorted(rows) == np.flatnonzero((ends == below + 1) | (ends == left + 1)).tolist()
    assert np.array_equal(np.array([below + 1, left + 1])[place], ends[rows])

    given, folder = small[0], Path(staging_root(spark))
    before = set(folder.iterdir())
    fitted = BoostedTrees(trees=3, bins=40, local_rows=0).fit(given)
    assert len(fitted.trees) == 3 and set(folder.iterdir()) == before
    naive = [r.loss for r in fitted.staged_loss(given).orderBy("round").collect()]
    x, y = (np.array([r[c] for r in given.select("x", "label").collect()]) for c in ("x", "label"))
    margin, want = np.full(len(x), fitted.start), []
    for one in [None, *fitted.trees]:
        margin = margin if one is None else margin + one.margin(binned(x, fitted.cuts))
        want.append(np.mean(np.log1p(np.exp(np.where(y == 1, -margin, margin)))))
    assert np.allclose(naive, want)
