"""Extra trees: random cut points, no bootstrap, big nodes split in Spark, small ones finished whole.

Nodes with more than ``LOCAL_ROWS`` rows are split level by level.  Per level two
passes run over the rows: the first finds the range of each open node's drawn
features, the driver draws one cut per feature inside that range, the second
counts the labels left of each cut.  Tasks emit one row per (node, candidate) they
met and Spark adds them up.  A node that has become small is grown to its leaves
by one task that gets its rows; finished subtrees are a staged table, which
never passes through the driver.  The driver holds the distributed top only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonelens.functions.arrays import matrix, packed_rows, unpacked_rows
from clonelens.models.base import score_table
from clonelens.session import staged

_SLICE = 50_000  # open nodes handled in one pass
LOCAL_ROWS = 200_000  # a node with at most so many rows is finished by one task
_DEALT = 256  # rows dealt to jobs in one step; each may go to every tree
_TOGETHER = 4  # trees that share a task while they still hold all rows
_PASS_ROWS = 20_000_000  # rows dealt to finishing tasks in one pass
_SCORED_ROWS = 65_536  # rows a task scores with one group of subtrees
_GROUP_NODES = 1 << 17  # nodes of subtrees that whole trees' jobs are merged up to for scoring
_GROUP_ROWS = 8192  # rows a task scores with such a merged group


@dataclass
class Forest:
    """All trees in flat arrays; the first ``trees`` nodes are the roots, a leaf has feature -1."""

    trees: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray  # the right child follows the left one
    share: np.ndarray  # share of class 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node each row reaches in each tree: (rows, trees)."""
        node = np.tile(np.arange(self.trees), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            right = x[rows, np.maximum(feature, 0)] > self.cut[node]
            node = np.where(inner, self.left[node] + right, node)


@dataclass
class _Growing:
    """Node lists while the forest grows."""

    trees: int
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    share: list[float] = field(default_factory=list)
    counts: list[tuple[float, float]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tree: list[int] = field(default_factory=list)

    def add(self, zeros: float, ones: float, depth: int, tree: int) -> int:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.left.append(-1)
        self.share.append(ones / max(zeros + ones, 1e-300))
        self.counts.append((zeros, ones))
        self.depth.append(depth)
        self.tree.append(tree)
        return len(self.feature) - 1

    def forest(self) -> Forest:
        return Forest(
            self.trees,
            np.array(self.feature),
            np.array(self.cut),
            np.array(self.left),
            np.array(self.share),
        )


def _impurity(zeros, ones):
    """Gini impurity times the number of rows."""
    return 2.0 * zeros * ones / np.maximum(zeros + ones, 1e-300)


@dataclass
class _Open:
    """The open nodes of one pass and their drawn features, as arrays the tasks use."""

    nodes: np.ndarray  # sorted node numbers
    features: np.ndarray  # (nodes, candidates); -1 where a node has no more features

    def met(self, forest: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, places in ``nodes``) of the rows that end in an open node."""
        ends = forest.leaves(x)
        place = np.searchsorted(self.nodes, ends)
        place = np.minimum(place, len(self.nodes) - 1)
        rows, trees = np.nonzero(self.nodes[place] == ends)
        return rows, place[rows, trees]


def _task(forest: Forest, opened: _Open, measure: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column("x"))
            rows, place = opened.met(forest, x)
            if len(rows) == 0:
                continue
            label = batch.column("label").to_numpy()
            for c in range(opened.features.shape[1]):
                feature = opened.features[place, c]
                ok = feature >= 0
                if not ok.any():
                    continue
                values = x[rows[ok], feature[ok]]
                yield measure(c, place[ok], values, label[rows[ok]])

    return run


def _ranges(c: int, place: np.ndarray, values: np.ndarray, _label: np.ndarray) -> pa.RecordBatch:
    met, at = np.unique(place, return_inverse=True)
    low, high = np.full(len(met), np.inf), np.full(len(met), -np.inf)
    np.minimum.at(low, at, values)
    np.maximum.at(high, at, values)
    return pa.RecordBatch.from_arrays(
        [pa.array(met, pa.int64()), pa.array(np.full(len(met), c), pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())],
        names=["place", "c", "low", "high"],
    )


def _left_counts(cuts: np.ndarray) -> Callable:
    def measure(c: int, place: np.ndarray, values: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        met, at = np.unique(place, return_inverse=True)
        goes_left = values <= cuts[place, c]
        ones = np.bincount(at, goes_left & (label == 1), len(met))
        zeros = np.bincount(at, goes_left & (label != 1), len(met))
        return pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int64()), pa.array(np.full(len(met), c), pa.int32()), pa.array(zeros, pa.float64()), pa.array(ones, pa.float64())],
            names=["place", "c", "zeros", "ones"],
        )

    return measure


class Subtree:
    """One small node grown to its leaves, level by level, all nodes of a level at once.

    ``feature``, ``cut``, ``left`` and ``share`` are lists over its nodes in the
    form of ``Forest`` with a single root; ``gains`` is the impurity decrease per
    feature.  The result depends on the rows, their order and ``seed`` only.
    """

    def __init__(self, x: np.ndarray, label: np.ndarray, seed: tuple[int, ...], depth: int, candidates: int):
        rng = np.random.default_rng(seed)
        ones = (label == 1).astype(float)
        self.feature, self.cut, self.left, self.share = [-1], [0.0], [-1], [ones.mean()]
        self.gains = np.zeros(x.shape[1])
        rows, starts, nodes = np.arange(len(x)), np.array([0]), np.array([0])
        if 0.0 < ones.mean() < 1.0:
            while depth > 0 and len(nodes):
                rows, starts, nodes = self._level(x, ones, rows, starts, nodes, rng, candidates)
                depth -= 1

    def _level(self, x, ones, rows, starts, nodes, rng, candidates):
        """Split ``nodes``, whose rows stand one after the other; returns the next level in the same form."""
        sizes = np.diff(np.append(starts, len(rows)))
        k, place = len(nodes), np.repeat(np.arange(len(nodes)), sizes)
        order = rng.permuted(np.tile(np.arange(x.shape[1]), (k, 1)), axis=1)
        total_ones = np.add.reduceat(ones[rows], starts)
        whole = _impurity(sizes - total_ones, total_ones)
        best_gain, best_feature, best_cut = np.full(k, -np.inf), np.full(k, -1), np.zeros(k)
        for first in range(0, x.shape[1], candidates):
            open_nodes = np.flatnonzero(best_feature < 0)
            if not len(open_nodes):
                break
            at = np.arange(len(rows)) if len(open_nodes) == k else np.flatnonzero((best_feature < 0)[place])
            some = sizes[open_nodes]
            begins = np.concatenate([[0], np.cumsum(some)[:-1]])
            inside = np.repeat(np.arange(len(open_nodes)), some)
            chosen_gain, chosen_feature, chosen_cut = best_gain[open_nodes], best_feature[open_nodes], best_cut[open_nodes]
            for c in range(first, min(first + candidates, x.shape[1])):
                feature = order[open_nodes, c]
                values = x[rows[at], feature[inside]]
                low, high = np.minimum.reduceat(values, begins), np.maximum.reduceat(values, begins)
                cut = low + rng.random(len(open_nodes)) * (high - low)
                goes_left = values <= cut[inside]
                left = np.add.reduceat(goes_left.astype(float), begins)
                left_ones = np.add.reduceat(goes_left * ones[rows[at]], begins)
                all_ones, all_rows = total_ones[open_nodes], some
                gain = whole[open_nodes] - _impurity(left - left_ones, left_ones)
                gain = gain - _impurity(all_rows - left - all_ones + left_ones, all_ones - left_ones)
                better = (low < high) & (left < all_rows) & (gain > chosen_gain)
                chosen_gain = np.where(better, gain, chosen_gain)
                chosen_feature = np.where(better, feature, chosen_feature)
                chosen_cut = np.where(better, cut, chosen_cut)
            best_gain[open_nodes], best_feature[open_nodes], best_cut[open_nodes] = chosen_gain, chosen_feature, chosen_cut
        return self._descended(x, ones, np.ones(len(x)), rows, place, nodes, best_gain, best_feature, best_cut)

    def _descended(self, x, ones, weight, rows, place, nodes, best_gain, best_feature, best_cut):
        """Carry out the chosen splits of ``nodes``; returns the next level."""
        k = len(nodes)
        split = np.flatnonzero(best_feature >= 0)
        np.add.at(self.gains, best_feature[split], np.maximum(best_gain[split], 0.0))
        child = np.full(k, -1)
        child[split] = len(self.feature) + 2 * np.arange(len(split))
        for i in split:
            self.feature[nodes[i]], self.cut[nodes[i]], self.left[nodes[i]] = int(best_feature[i]), float(best_cut[i]), int(child[i])
        moved = np.flatnonzero((best_feature >= 0)[place])
        rows, place = rows[moved], place[moved]
        goes_right = x[rows, best_feature[place]] > best_cut[place]
        target = child[place] + goes_right
        by_child = np.argsort(target, kind="stable")
        rows, target = rows[by_child], target[by_child]
        n_new = 2 * len(split)
        counts = np.bincount(target - len(self.feature), weight[rows], n_new)
        shares = np.bincount(target - len(self.feature), ones[rows], n_new) / np.maximum(counts, 1e-300)
        base = len(self.feature)
        self.feature += [-1] * n_new
        self.cut += [0.0] * n_new
        self.left += [-1] * n_new
        self.share += shares.tolist()
        mixed = (shares > 0.0) & (shares < 1.0)
        keep = mixed[target - base]
        rows, target = rows[keep], target[keep]
        nodes = base + np.flatnonzero(mixed)
        return rows, np.searchsorted(target, nodes), nodes


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``_DEALT`` rows: a step's output is at most that times the trees."""
    for batch in batches:
        for at in range(0, batch.num_rows, _DEALT):
            yield batch.slice(at, _DEALT)


@dataclass
class _Jobs:
    """Groups of small open nodes that hold the same rows, finished and scored together."""

    nodes: list[list[int]]

    def met(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, job numbers) of rows whose leaves ``ends`` belong to a job's first node."""
        firsts = np.array([n[0] for n in self.nodes])
        order = np.argsort(firsts)
        at = np.minimum(np.searchsorted(firsts[order], ends), len(firsts) - 1)
        rows, trees = np.nonzero(firsts[order][at] == ends)
        return rows, order[at[rows, trees]]


def _merged(jobs: _Jobs, subtrees: DataFrame) -> tuple[_Jobs, DataFrame, int]:
    """Jobs that all hold every row, made fewer where their subtrees are small, and how many rows to score at a time.

    A row to score travels once per job.
    """
    most = subtrees.groupBy("job").agg(F.sum(F.size("feature")).alias("n")).agg(F.max("n")).first()[0]
    k = _GROUP_NODES // max(most, 1)
    if k < 2:
        return jobs, subtrees, _SCORED_ROWS
    groups = [sum(jobs.nodes[i : i + k], []) for i in range(0, len(jobs.nodes), k)]
    return _Jobs(groups), subtrees.withColumn("job", F.floor(F.col("job") / F.lit(k)).cast("int")), _GROUP_ROWS


_SUBTREES = "job int, node int, feature array<int>, cut array<double>, `left` array<int>, share array<double>, gains array<double>"


@dataclass
class ExtraTrees:
    trees: int = 100
    max_depth: int = 1 << 30  # no limit
    seed: int = 42
    local_rows: int = LOCAL_ROWS

    def fit(self, train: DataFrame) -> FittedExtraTrees:
        rows = train.select("x", "label", F.xxhash64("row_id").alias("at"))
        size = rows.select(F.size("x")).first()[0]
        candidates = self._candidates(size)
        grown = _Growing(self.trees)
        rng = np.random.default_rng(self.seed)
        gains = np.zeros(size)
        # each open node: its number and its feature order; a node whose features
        # are all constant gets the next ones, until none are left
        todo: list[tuple[int, np.ndarray]] = []
        small: list[int] = []

        def opened(nodes: list[int]) -> list[tuple[int, np.ndarray]]:
            small.extend(n for n in nodes if sum(grown.counts[n]) <= self.local_rows)
            return [(n, rng.permutation(size)) for n in nodes if sum(grown.counts[n]) > self.local_rows]

        roots = [grown.add(zeros, ones, 0, tree) for tree, (zeros, ones) in enumerate(self._root_counts(rows))]
        todo = opened([n for n in roots if min(grown.counts[n]) > 0])
        while todo:
            part, todo = todo[:_SLICE], todo[_SLICE:]
            retry, children = self._split(rows, grown, part, candidates, rng, gains)
            todo += retry + opened([n for n in children if grown.depth[n] < self.max_depth])
        forest = grown.forest()
        if small and small == roots:
            jobs = _Jobs([roots[i : i + _TOGETHER] for i in range(0, len(roots), _TOGETHER)])
        else:
            jobs = _Jobs([[n] for n in small])
        subtrees = self._finish(rows, grown, forest, jobs) if small else None
        if subtrees is not None:
            for row in subtrees.select(F.posexplode("gains").alias("f", "g")).groupBy("f").agg(F.sum("g").alias("g")).collect():
                gains[row["f"]] += row["g"]
        total = gains.sum()
        chunk_rows = _SCORED_ROWS
        if subtrees is not None and small == roots:
            jobs, subtrees, chunk_rows = _merged(jobs, subtrees)
        return FittedExtraTrees(forest, list(gains / total if total > 0 else gains), jobs, subtrees, chunk_rows)

    def _candidates(self, size: int) -> int:
        """How many of ``size`` features a node tries."""
        return max(1, int(np.sqrt(size)))

    def _root_counts(self, rows: DataFrame) -> list[tuple[float, float]]:
        """(zeros, ones) of every tree's rows."""
        totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        return [(totals.get(0, 0), totals.get(1, 0))] * self.trees

    def _prepared(self, x: np.ndarray) -> object:
        """What the subtrees of a job share, from the job's rows."""
        return None

    def _subtree(self, x: np.ndarray, label: np.ndarray, at: np.ndarray, node: int, tree: int, depth: int, prepared=None) -> Subtree:
        return Subtree(x, label, (self.seed, node), depth, self._candidates(x.shape[1]))

    def _finish(self, rows: DataFrame, grown: _Growing, forest: Forest, jobs: _Jobs) -> DataFrame:
        """The staged subtrees of all jobs; a pass deals out a bounded number of rows."""
        done, part, dealt = None, [], 0.0
        for job, nodes in enumerate(jobs.nodes):
            part.append(job)
            dealt += sum(grown.counts[nodes[0]])
            if dealt >= _PASS_ROWS or job == len(jobs.nodes) - 1:
                heads = {n: (grown.tree[n], self.max_depth - grown.depth[n]) for j in part for n in jobs.nodes[j]}
                found = staged(self._grow(rows, forest, jobs, (part[0], part[-1]), heads), "subtrees")
                done, part, dealt = found if done is None else done.unionByName(found), [], 0.0
        return done

    def _grow(self, rows, forest, jobs, span, heads) -> DataFrame:

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                x = matrix(batch.column("x"))
                at, job = jobs.met(forest.leaves(x))
                here = (job >= span[0]) & (job <= span[1])
                some = batch.select(["label", "at"]).take(pa.array(at[here]))
                columns = [pa.array(job[here].astype(np.int32)), packed_rows(x[at[here]]), *some.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["job", "x", "label", "at"])

        def grow(table: pa.Table) -> pa.Table:
            job = table.column("job")[0].as_py()
            order = np.lexsort((table.column("label").to_numpy(), table.column("at").to_numpy()))
            x, label = unpacked_rows(table.column("x"))[order], table.column("label").to_numpy()[order]
            at = table.column("at").to_numpy()[order]
            prepared = self._prepared(x)
            out = [(job, n, self._subtree(x, label, at, n, *heads[n], prepared)) for n in jobs.nodes[job]]
            return pa.table(
                {
                    "job": pa.array([o[0] for o in out], pa.int32()),
                    "node": pa.array([o[1] for o in out], pa.int32()),
                    "feature": pa.array([o[2].feature for o in out], pa.list_(pa.int32())),
                    "cut": pa.array([o[2].cut for o in out], pa.list_(pa.float64())),
                    "left": pa.array([o[2].left for o in out], pa.list_(pa.int32())),
                    "share": pa.array([o[2].share for o in out], pa.list_(pa.float64())),
                    "gains": pa.array([o[2].gains.tolist() for o in out], pa.list_(pa.float64())),
                }
            )

        dealt = rows.mapInArrow(deal, "job int, x binary, label bigint, at bigint")
        return dealt.groupBy("job").applyInArrow(grow, _SUBTREES)

    def _split(
        self,
        rows: DataFrame,
        grown: _Growing,
        part: list[tuple[int, np.ndarray]],
        candidates: int,
        rng: np.random.Generator,
        gains: np.ndarray,
    ) -> tuple[list[tuple[int, np.ndarray]], list[int]]:
        """Split the open nodes of ``part``; returns the ones to retry and the open children."""
        part = sorted(part, key=lambda p: p[0])
        features = np.full((len(part), candidates), -1)
        for at, (_, order) in enumerate(part):
            features[at, : min(candidates, len(order))] = order[:candidates]
        opened = _Open(np.array([n for n, _ in part]), features)
        forest = grown.forest()
        spans = (
            rows.mapInArrow(_task(forest, opened, _ranges), "place bigint, c int, low double, high double")
            .groupBy("place", "c")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"))
            .filter("low < high")
            .collect()  # per open node and candidate
        )
        cuts = np.full(features.shape, np.nan)
        for s in sorted(spans, key=lambda s: (s["place"], s["c"])):
            cuts[s["place"], s["c"]] = rng.uniform(s["low"], s["high"])
        counted = (
            rows.mapInArrow(
                _task(forest, opened, _left_counts(cuts)), "place bigint, c int, zeros double, ones double"
            )
            .groupBy("place", "c")
            .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
            .collect()
        )
        best: dict[int, tuple] = {}
        for s in sorted(counted, key=lambda s: (s["place"], s["c"])):
            if np.isnan(cuts[s["place"], s["c"]]):
                continue
            zeros, ones = grown.counts[opened.nodes[s["place"]]]
            l0, l1 = s["zeros"], s["ones"]
            gain = _impurity(zeros, ones) - _impurity(l0, l1) - _impurity(zeros - l0, ones - l1)
            if s["place"] not in best or gain > best[s["place"]][0]:
                best[s["place"]] = (gain, s["c"], l0, l1)
        retry, children = [], []
        for at, (node, order) in enumerate(part):
            if at not in best:
                if len(order) > candidates:
                    retry.append((node, order[candidates:]))
                continue
            gain, c, l0, l1 = best[at]
            zeros, ones = grown.counts[node]
            grown.feature[node], grown.cut[node] = int(features[at, c]), float(cuts[at, c])
            gains[features[at, c]] += max(gain, 0.0)
            below = grown.depth[node] + 1
            grown.left[node] = grown.add(l0, l1, below, grown.tree[node])
            grown.add(zeros - l0, ones - l1, below, grown.tree[node])
            for child in (grown.left[node], grown.left[node] + 1):
                if min(grown.counts[child]) > 0:  # a pure node is a leaf
                    children.append(child)
        return retry, children


@dataclass
class FittedExtraTrees:
    """``forest`` is the top; a leaf that belongs to a job goes on in that job's ``subtrees``."""

    forest: Forest
    gains: list[float]
    jobs: _Jobs
    subtrees: DataFrame | None = None
    chunk_rows: int = _SCORED_ROWS

    def score(self, rows: DataFrame) -> DataFrame:
        """Mean leaf share over the trees; rows meet subtrees in bounded groups."""
        forest, jobs = self.forest, self.jobs
        open_nodes = np.array(sorted(n for some in jobs.nodes for n in some) if self.subtrees is not None else [], int)
        asked = rows.select("row_id", "label", "x")

        def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ends = forest.leaves(matrix(batch.column("x")))
                shares = np.where(np.isin(ends, open_nodes), 0.0, forest.share[ends]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shares)], names=["row_id", "label", "share"])

        parts = asked.mapInArrow(closed, "row_id bigint, label bigint, share double")
        if self.subtrees is not None:
            parts = parts.unionByName(self._below(asked))
        mean = parts.groupBy("row_id", "label").agg((F.sum("share") / F.lit(float(forest.trees))).alias("__s"))
        return score_table(mean, F.col("__s"), F.col("__s") > 0.5)

    def _below(self, asked: DataFrame) -> DataFrame:
        """(row_id, label, share): per job, the sum of its subtrees' leaf shares."""
        forest, jobs = self.forest, self.jobs
        chunks = max(1, -(-asked.count() // self.chunk_rows))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                x = matrix(batch.column("x"))
                at, job = jobs.met(forest.leaves(x))
                some = batch.select(["row_id", "label"]).take(pa.array(at))
                columns = [pa.array(job.astype(np.int32)), *some.columns, packed_rows(x[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["job", "row_id", "label", "x"])

        def add_up(trees: pa.Table, rows: pa.Table) -> pa.Table:
            x, total = unpacked_rows(rows.column("x")), np.zeros(rows.num_rows)
            trees = trees.sort_by("node")
            columns = [trees.column(c) for c in ("feature", "cut", "left", "share")]
            for i in range(trees.num_rows if rows.num_rows else 0):
                one = Forest(1, *[c[i].values.to_numpy() for c in columns])
                total += one.share[one.leaves(x)[:, 0]]
            return pa.table({"row_id": rows.column("row_id"), "label": rows.column("label"), "share": pa.array(total)})

        chunk = F.pmod(F.xxhash64("row_id"), F.lit(chunks)).cast("int").alias("chunk")
        dealt = asked.mapInArrow(deal, "job int, row_id bigint, label bigint, x binary").select("*", chunk)
        every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
        trees = self.subtrees.drop("gains").select("*", every)
        return (
            trees.groupBy("job", "chunk")
            .cogroup(dealt.groupBy("job", "chunk"))
            .applyInArrow(add_up, "row_id bigint, label bigint, share double")
        )

    def importances(self) -> list[float]:
        """Share of the total impurity decrease per feature."""
        return [float(g) for g in self.gains]
