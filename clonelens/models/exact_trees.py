"""Decision tree, bagging and random forest with exact cuts and unlimited depth.

They grow like ``extra_trees``: nodes of more than ``local_rows`` rows are split
level by level in Spark, smaller ones are finished whole by one task.  A cut is the
middle of two neighbouring values, and every such place is tried.  In Spark the
values of an open node's features become attribute lists (node, feature, value,
weight of either class), equal values added up, range partitioned and sorted;
running class weights come from the list's own part plus the totals of the parts
before it, so a list is never in one task.

Bootstrap samples give a row a Poisson(1) weight per tree, drawn from a hash of
the row's id, so draws do not depend on partitions.  A node tries its features in a
drawn order; one whose drawn features are constant goes on to the next ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonelens.functions.arrays import matrix
from clonelens.models.extra_trees import ExtraTrees, Subtree, _Growing, _impurity, _Open
from clonelens.session import staged

_CELLS = 4  # cells per row up to which a level's values are counted instead of sorted
_POISSON = np.cumsum([np.exp(-1.0) / factorial(k) for k in range(18)])


def bootstrap_weights(at: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row, named by a hash, is drawn for a tree."""
    start = ((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    z = at.view(np.uint64) ^ np.uint64(start)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0**-53, side="right").astype(float)


# ---- cuts of large nodes, in Spark ---------------------------------------------------------


def _node_impurity(zeros: Column, ones: Column) -> Column:
    return F.lit(2.0) * zeros * ones / F.greatest(zeros + ones, F.lit(1e-300))


def best_cuts(entries: DataFrame) -> DataFrame:
    """(node, feature, gain, cut, l0, l1): the best cut of every attribute list that has one.

    ``entries`` is (node, feature, value, w0, w1).  Of equal gains the smallest cut counts.
    """
    keys = ["node", "feature"]
    merged = entries.groupBy(*keys, "value").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = merged.repartitionByRange(parts, *keys, "value").withColumn("part", F.spark_partition_id())
    listed = staged(ranged, "attribute-lists")
    sums = [F.sum("w0").alias("s0"), F.sum("w1").alias("s1"), F.min("value").alias("first")]
    totals = listed.groupBy(*keys, "part").agg(*sums)
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "part", F.coalesce(F.sum("s0").over(earlier), F.lit(0.0)).alias("before0"),
        F.coalesce(F.sum("s1").over(earlier), F.lit(0.0)).alias("before1"),
        F.lead("first").over(whole.orderBy("part")).alias("after"),
        F.sum("s0").over(whole).alias("all0"), F.sum("s1").over(whole).alias("all1"),
    )
    order = Window.partitionBy(*keys, "part").orderBy("value")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = listed.join(totals, [*keys, "part"])
    placed = placed.withColumns({
        "l0": F.col("before0") + F.sum("w0").over(upto), "l1": F.col("before1") + F.sum("w1").over(upto),
        "next": F.coalesce(F.lead("value").over(order), F.col("after")),
    }).filter("next is not null")
    right = _node_impurity(F.col("all0") - F.col("l0"), F.col("all1") - F.col("l1"))
    gain = _node_impurity(F.col("all0"), F.col("all1")) - _node_impurity(F.col("l0"), F.col("l1")) - right
    middle = F.col("value") + (F.col("next") - F.col("value")) / 2
    cut = F.when(middle < F.col("next"), middle).otherwise(F.col("value"))
    best = F.max(F.struct(gain.alias("gain"), (-cut).alias("back"), "l0", "l1")).alias("b")
    return placed.groupBy(*keys).agg(best).select(*keys, "b.gain", (-F.col("b.back")).alias("cut"), "b.l0", "b.l1")


# ---- small nodes, in one task ----------------------------------------------------------------


@dataclass
class Ranks:
    """Per feature the distinct values, and every row's place among them."""

    codes: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray) -> Ranks:
        codes, values = np.empty(x.shape, np.int32), []
        for f in range(x.shape[1]):
            known, codes[:, f] = np.unique(x[:, f], return_inverse=True)
            values.append(known)
        return cls(codes, values)


class ExactSubtree(Subtree):
    """One small node grown to its leaves with exact cuts; ``weight`` is how often each row counts.

    ``ranks`` are those of ``x``; a task's trees share them.
    """

    def __init__(self, x, label, weight, seed: tuple[int, ...], depth: int, candidates: int, ranks: Ranks | None = None):
        some = weight > 0
        ranks = ranks or Ranks.of(x)
        self.codes, self.values = ranks.codes[some], ranks.values
        x, label, self.weight = x[some], label[some], weight[some]
        rng = np.random.default_rng(seed)
        ones = self.weight * (label == 1)
        total = self.weight.sum()
        self.feature, self.cut, self.left, self.share = [-1], [0.0], [-1], [ones.sum() / max(total, 1e-300)]
        self.gains = np.zeros(x.shape[1])
        rows, starts, nodes = np.arange(len(x)), np.array([0]), np.array([0])
        if 0.0 < ones.sum() < total:
            while depth > 0 and len(nodes):
                rows, starts, nodes = self._level(x, ones, rows, starts, nodes, rng, candidates)
                depth -= 1

    def _level(self, x, ones, rows, starts, nodes, rng, candidates):
        sizes = np.diff(np.append(starts, len(rows)))
        k, width = len(nodes), x.shape[1]
        place = np.repeat(np.arange(k), sizes)
        order = np.tile(np.arange(width), (k, 1))
        if candidates < width:
            order = rng.permuted(order, axis=1)
        total = np.add.reduceat(self.weight[rows], starts)
        total_ones = np.add.reduceat(ones[rows], starts)
        best_gain, best_feature, best_cut = np.full(k, -np.inf), np.full(k, -1), np.zeros(k)
        for first in range(0, width, candidates):
            at = np.flatnonzero((best_feature < 0)[place])  # rows of nodes without a cut so far
            if not len(at):
                break
            inside, some = place[at], rows[at]
            w, o = self.weight[some], ones[some]
            found_gain, found_feature, found_cut = best_gain.copy(), best_feature.copy(), best_cut.copy()
            for c in range(first, min(first + candidates, width)):
                listed = self._listed(x, some, inside, order[:, c], w, o)
                gain, cut = _best_cut(*listed, total, total_ones)
                better = gain > found_gain
                found_gain[better], found_feature[better], found_cut[better] = gain[better], order[better, c], cut[better]
            best_gain, best_feature, best_cut = found_gain, found_feature, found_cut
        return self._descended(x, ones, self.weight, rows, place, nodes, best_gain, best_feature, best_cut)


    def _listed(self, x, rows, node, features, weight, ones) -> tuple[np.ndarray, ...]:
        """(value, node, weight, ones) in the order of node and value; ``features`` has one per node.

        Few values are counted, with one entry for equal ones; many are sorted.
        """
        feature = features[node]
        begins = np.concatenate([[0], np.cumsum([len(self.values[f]) for f in features])])
        if begins[-1] > _CELLS * len(rows):
            values = x[rows, feature]
            order = np.lexsort((values, node))
            return values[order], node[order], weight[order], ones[order]
        cell = begins[node] + self.codes[rows, feature]
        summed, summed_ones = (np.bincount(cell, w, begins[-1]) for w in (weight, ones))
        met = np.flatnonzero(summed)
        n = np.searchsorted(begins, met, side="right") - 1
        value = np.concatenate([self.values[f] for f in features])[met]
        return value, n, summed[met], summed_ones[met]


def _best_cut(v, n, weight, ones, total, total_ones) -> tuple[np.ndarray, np.ndarray]:
    """(gain, cut) per node, -inf where all values are equal; the entries are sorted by node ``n`` and value ``v``."""
    k = len(total)
    gain, cut = np.full(k, -np.inf), np.zeros(k)
    at = np.flatnonzero((n[1:] == n[:-1]) & (v[1:] > v[:-1]))
    if not len(at):
        return gain, cut
    begins = np.searchsorted(n, np.arange(k))
    run, run_ones = np.cumsum(weight), np.cumsum(ones)
    before = np.concatenate([[0.0], run])[begins]
    before_ones = np.concatenate([[0.0], run_ones])[begins]
    here = n[at]
    left, left_ones = run[at] - before[here], run_ones[at] - before_ones[here]
    all_rows, all_ones = total[here], total_ones[here]
    found = _impurity(all_rows - all_ones, all_ones) - _impurity(left - left_ones, left_ones)
    found = found - _impurity(all_rows - left - all_ones + left_ones, all_ones - left_ones)
    np.maximum.at(gain, here, found)
    top = np.flatnonzero(found == gain[here])
    met, first = np.unique(here[top], return_index=True)
    low, high = v[at[top[first]]], v[at[top[first]] + 1]
    middle = low + (high - low) / 2
    cut[met] = np.where(middle < high, middle, low)
    return gain, cut


# ---- the models ------------------------------------------------------------------------------


@dataclass
class ExactTrees(ExtraTrees):
    """``features`` a node tries: 'all' or 'sqrt'; with ``bootstrap`` every tree has its own sample."""

    features: str = "all"
    bootstrap: bool = False

    def _candidates(self, size: int) -> int:
        return size if self.features == "all" else super()._candidates(size)

    def _weights(self, at: np.ndarray, tree: int) -> np.ndarray:
        return bootstrap_weights(at, tree, self.seed) if self.bootstrap else np.ones(len(at))

    def _root_counts(self, rows: DataFrame) -> list[tuple[float, float]]:
        if not self.bootstrap:
            return super()._root_counts(rows)
        trees = self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((trees, 2))
            for batch in batches:
                at, label = batch.column("at").to_numpy(), batch.column("label").to_numpy()
                for tree in range(trees):
                    weight = self._weights(at, tree)
                    sums[tree] += weight[label != 1].sum(), weight[label == 1].sum()
            columns = [pa.array(np.arange(trees)), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "zeros", "ones"])

        parts = rows.select("at", "label").mapInArrow(run, "tree bigint, zeros double, ones double")
        found = parts.groupBy("tree").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect()
        return [(r["zeros"], r["ones"]) for r in sorted(found, key=lambda r: r["tree"])]

    def _prepared(self, x: np.ndarray) -> Ranks:
        return Ranks.of(x)

    def _subtree(self, x, label, at, node, tree, depth, prepared=None) -> Subtree:
        return ExactSubtree(x, label, self._weights(at, tree), (self.seed, node), depth, self._candidates(x.shape[1]), prepared)

    def _split(self, rows: DataFrame, grown: _Growing, part, candidates: int, rng, gains):
        part = sorted(part, key=lambda p: p[0])
        features = np.full((len(part), candidates), -1)
        for at, (_, order) in enumerate(part):
            features[at, : min(candidates, len(order))] = order[:candidates]
        opened, forest = _Open(np.array([n for n, _ in part]), features), grown.forest()
        trees = np.array([grown.tree[n] for n, _ in part])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, label, named = matrix(batch.column("x")), batch.column("label").to_numpy(), batch.column("at").to_numpy()
                met, place = opened.met(forest, x)
                weight = np.zeros(len(met))
                for tree in np.unique(trees[place]):
                    here = trees[place] == tree
                    weight[here] = self._weights(named[met[here]], int(tree))
                for c in range(features.shape[1]):
                    feature = features[place, c]
                    ok = (feature >= 0) & (weight > 0)
                    if ok.any():
                        is_one = label[met[ok]] == 1
                        w = weight[ok]
                        columns = [place[ok], feature[ok], x[met[ok], feature[ok]], np.where(is_one, 0.0, w), np.where(is_one, w, 0.0)]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["node", "feature", "value", "w0", "w1"])

        entries = rows.mapInArrow(run, "node bigint, feature bigint, value double, w0 double, w1 double")
        best: dict[int, tuple] = {}
        rank = {(at, f): c for at in range(len(part)) for c, f in enumerate(features[at].tolist())}
        found = best_cuts(entries).collect()  # one row per open node and candidate
        for s in sorted(found, key=lambda s: (s["node"], rank[s["node"], s["feature"]])):
            if s["node"] not in best or s["gain"] > best[s["node"]]["gain"]:
                best[s["node"]] = s
        retry, children = [], []
        for at, (node, order) in enumerate(part):
            if at not in best:
                if len(order) > candidates:
                    retry.append((node, order[candidates:]))
                continue
            s, (zeros, ones) = best[at], grown.counts[node]
            grown.feature[node], grown.cut[node] = int(s["feature"]), float(s["cut"])
            gains[s["feature"]] += max(s["gain"], 0.0)
            below, tree = grown.depth[node] + 1, grown.tree[node]
            grown.left[node] = grown.add(s["l0"], s["l1"], below, tree)
            grown.add(zeros - s["l0"], ones - s["l1"], below, tree)
            children += [c for c in (grown.left[node], grown.left[node] + 1) if min(grown.counts[c]) > 0]
        return retry, children


def decision_tree(seed: int = 42) -> ExactTrees:
    return ExactTrees(trees=1, seed=seed)


def bagging(trees: int = 10, seed: int = 42) -> ExactTrees:
    return ExactTrees(trees=trees, seed=seed, bootstrap=True)


def random_forest(trees: int = 100, seed: int = 42) -> ExactTrees:
    return ExactTrees(trees=trees, seed=seed, features="sqrt", bootstrap=True)
