"""Gradient boosting on binned features: leaf-wise or level-wise trees from summed histograms.

Rows carry one bin number per feature and their margin; a pass adds up, per open
leaf, feature and bin, the gradients, curvatures and rows.  Only the smaller child of
a split is counted; its sibling is the parent minus it.  Gradients are summed as
whole multiples of 1 / ``_UNIT``, so sums do not depend on partitions.

A tree grows best first: the leaf with the largest gain is split next, until
``leaves`` are reached.  Which leaves that will be is known only afterwards, so a
pass counts all leaves the queue would split next, and the queue is replayed with
what is then known; a tree takes as many passes as it is deep, not one per split.
With 2 ** depth leaves and a depth limit the same queue grows whole levels.

Rows with equal bins and label are one row with a count, where that at least halves the
table.  Up to ``local_rows`` of them, a constant, the same loop runs inside one task; beyond
it runs on the driver and every pass is one Spark job.  Margins are staged after every
tree, so a pass routes its rows through the tree that grows only, and only on the way to
the leaves it counts.  The driver holds the trees and leaves x features x bins sums.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonelens.functions.arrays import ROWS, added_up, matrix, row_sums
from clonelens.models.base import score_table
from clonelens.models.extra_trees import Forest
from clonelens.session import staged, unstaged

LOCAL_ROWS = 400_000  # so many rows of bins are fitted by one task
_CHUNK = 1 << 16  # rows a task measures in one step
_UNIT = float(1 << 26)


@dataclass
class Tree:
    """A tree over bins; a leaf has feature -1.  Rows with a bin up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[float] = field(default_factory=lambda: [0.0])  # rows of a leaf, by its sums

    def split(self, node: int, feature: int, at: int) -> int:
        """Give ``node`` two children and return the left one; the right one follows it."""
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.feature)
        self.feature += [-1, -1]
        self.bin += [0, 0]
        self.left += [-1, -1]
        self.value += [0.0, 0.0]
        self.rows += [0.0, 0.0]
        return self.left[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins), np.int64)
        todo = [(0, np.arange(len(bins)))]  # nodes with the rows that reach them
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0 or not len(rows):
                out[rows] = node
                continue
            right = bins[rows, self.feature[node]] > self.bin[node]
            todo += [(self.left[node], rows[~right]), (self.left[node] + 1, rows[right])]
        return out

    def reached(self, bins: np.ndarray, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, places in ``nodes``) of the rows that come to one of ``nodes``, which no other of them lies below."""
        place, ways = dict(zip(nodes, range(len(nodes)))), set(nodes)
        for node in reversed(range(len(self.feature))):  # children follow their parents
            if self.feature[node] >= 0 and (self.left[node] in ways or self.left[node] + 1 in ways):
                ways.add(node)
        columns = np.ascontiguousarray(bins.T)
        found, todo = [], [(0, np.arange(len(bins)))] if 0 in ways else []
        while todo:
            node, rows = todo.pop()
            if node in place:
                found.append((rows, np.full(len(rows), place[node])))
                continue
            left = self.left[node]
            right = columns[self.feature[node]][rows] > self.bin[node]
            todo += [(child, rows[side]) for child, side in ((left, ~right), (left + 1, right)) if child in ways]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r for r, _ in found]), np.concatenate([p for _, p in found])

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling gradient and curvature of the log loss, as whole multiples of 1 / _UNIT."""
    p = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
    return np.rint((label - p) * _UNIT), np.rint(p * (1.0 - p) * _UNIT)


def histograms(
    tree: Tree, nodes: list[int], bins: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, n: np.ndarray | None = None
) -> np.ndarray:
    """(nodes, features, width, 3) sums of gradient, curvature and rows that end in ``nodes``; ``n`` is how often a row counts."""
    some, at = tree.reached(bins, nodes)
    return _summed(at, len(nodes), bins[some], g[some], h[some], width, np.ones(len(some)) if n is None else n[some])


def _summed(at: np.ndarray, nodes: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, n: np.ndarray) -> np.ndarray:
    """``histograms`` of rows whose places among the nodes are ``at``."""
    weights, at = (g * n, h * n, n), at * width
    out = np.zeros((nodes, bins.shape[1], width, 3))
    for f in range(bins.shape[1]):
        cell = at + bins[:, f]
        for i, weight in enumerate(weights):
            out[:, f, :, i] = np.bincount(cell, weight, nodes * width).reshape(nodes, width)
    return out


@dataclass
class Growth:
    """How trees grow: limits, and what a split is worth.

    With ``newton`` a leaf is worth gradient squared over curvature, else over rows.
    """

    leaves: int = 31
    depth: int = 1 << 30
    least_rows: int = 20
    least_curvature: float = 1e-3
    newton: bool = True
    rate: float = 0.1

    def worth(self, cells: np.ndarray) -> np.ndarray:
        below = cells[..., 1] if self.newton else cells[..., 2] * _UNIT
        return cells[..., 0] ** 2 / np.maximum(below, 1.0)

    def best(self, histogram: np.ndarray) -> tuple[float, int, int] | None:
        """(gain, feature, bin) of the best split; of equal ones the first."""
        whole = histogram[0].sum(axis=0)
        left = histogram.cumsum(axis=1)
        right = whole - left
        sides = np.minimum(left[..., 2], right[..., 2]) >= max(self.least_rows, 1)
        curved = np.minimum(left[..., 1], right[..., 1]) >= self.least_curvature * _UNIT
        gain = np.where(sides & curved, self.worth(left) + self.worth(right) - self.worth(whole), -np.inf)
        at = int(np.argmax(gain))
        if not gain.flat[at] > 1e-9 * _UNIT:
            return None
        return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


Measure = Callable[[Tree, list[int]], np.ndarray]


def grown(measure: Measure, growth: Growth) -> tuple[Tree, np.ndarray]:
    """(tree, gain per feature) from ``measure``, which returns the histograms of leaves of a tree."""
    known = Tree()  # every split that was looked at, in the order of looking
    sums = {0: measure(known, [0])[0]}
    splits, depths = {0: growth.best(sums[0])}, {0: 0}
    while True:
        taken, pending = _replayed(known, splits, depths, growth)
        if not pending:
            break
        counted, others = [], []
        for node in pending:
            _, f, b = splits[node]
            left = known.split(node, f, b)
            rows = sums[node][f, : b + 1, 2].sum()
            small = left if 2 * rows <= sums[node][f, :, 2].sum() else left + 1
            counted.append(small)
            others.append(2 * left + 1 - small)
            depths[left] = depths[left + 1] = depths[node] + 1
        for node, small, other, found in zip(pending, counted, others, measure(known, counted)):
            sums[small], sums[other] = found, sums[node] - found
            for child in (small, other):
                splits[child] = growth.best(sums[child]) if depths[child] < growth.depth else None
    return _pruned(known, taken, splits, sums, growth)


def _replayed(known: Tree, splits: dict, depths: dict, growth: Growth) -> tuple[list[int], list[int]]:
    """(splits in best-first order, those among them whose children are not counted yet)."""
    queue = [(-splits[0][0], 0)] if splits[0] and growth.depth > 0 else []
    taken, pending = [], []
    while queue and len(taken) < growth.leaves - 1:
        _, node = heapq.heappop(queue)
        taken.append(node)
        if known.left[node] < 0:
            pending.append(node)
            continue
        for child in (known.left[node], known.left[node] + 1):
            if splits[child]:
                heapq.heappush(queue, (-splits[child][0], child))
    return taken, pending


def _pruned(known: Tree, taken: list[int], splits: dict, sums: dict, growth: Growth) -> tuple[Tree, np.ndarray]:
    """The tree of the ``taken`` splits with its leaf values."""
    gains = np.zeros(len(sums[0]))
    tree, place = Tree(), {0: 0}
    for node in taken:
        gain, f, b = splits[node]
        gains[f] += gain
        left = tree.split(place[node], f, b)
        place[known.left[node]], place[known.left[node] + 1] = left, left + 1
    for node, at in place.items():
        if tree.feature[at] < 0:
            g, h, rows = sums[node][0].sum(axis=0)
            tree.value[at], tree.rows[at] = float(growth.rate * g / max(h, 1.0)), float(rows)
    return tree, gains


def cut_points(train: DataFrame, size: int, bins: int) -> list[np.ndarray]:
    """Per feature at most ``bins`` - 1 cut points: all values if there are few, else quantiles."""
    wide = train.select(*[F.col("x")[i].alias(f"x{i}") for i in range(size)])
    shares = [i / bins for i in range(1, bins)]
    found = wide.approxQuantile(wide.columns, shares, 1.0 / (4 * bins))
    return [np.unique(q) for q in found]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.int16)


def _bin_column(bins: np.ndarray) -> pa.Array:
    offsets = np.arange(len(bins) + 1, dtype=np.int32) * bins[:1].nbytes
    return pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bins))])


def _bins_of(column: pa.Array, size: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2][int(offsets[0]) : int(offsets[-1])], np.int16).reshape(-1, size)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``_CHUNK``, so that a step's fixed cost is shared by many rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _CHUNK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class BoostedTrees:
    trees: int = 100
    growth: Growth = field(default_factory=Growth)
    bins: int = 255
    local_rows: int = LOCAL_ROWS

    def fit(self, train: DataFrame) -> FittedBoostedTrees:
        counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        size = train.select(F.size("x")).first()[0]
        ones, total = counts.get(1, 0), sum(counts.values())
        share = min(max(ones / total, 1e-12), 1 - 1e-12)
        start = float(np.log(share / (1.0 - share)))
        cuts = cut_points(train, size, self.bins)
        rows, total_rows = self._merged(staged(self._rows(train, cuts, start), "bins"), total)
        grow = self._in_one_task if total_rows <= self.local_rows else self._in_spark
        trees, gains = grow(rows, size) if 0 < ones < total else ([], np.zeros(size))
        return FittedBoostedTrees(start, trees, cuts, (gains / gains.sum() if gains.sum() else gains).tolist())

    def _rows(self, train: DataFrame, cuts: list[np.ndarray], start: float) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    margin = pa.array(np.full(batch.num_rows, start))
                    bins = _bin_column(binned(matrix(batch.column("x")), cuts))
                    yield pa.RecordBatch.from_arrays([batch.column("label"), bins, margin], names=["label", "bins", "margin"])

        return train.select("label", "x").mapInArrow(run, "label bigint, bins binary, margin double")

    @staticmethod
    def _merged(rows: DataFrame, total: int) -> tuple[DataFrame, int]:
        """Rows with their count ``n``, equal ones as one if about half of them are repeated, and their number."""
        about = rows.agg(F.approx_count_distinct(F.xxhash64("label", "bins"))).first()[0]
        if 2 * about > total:
            return rows.withColumn("n", F.lit(1.0)), total
        merged = rows.groupBy("label", "bins").agg(F.first("margin").alias("margin"), F.count(F.lit(1)).cast("double").alias("n"))
        merged = staged(merged, "binned")  # all margins are the start value
        unstaged(rows)
        return merged, merged.count()

    def _in_one_task(self, rows: DataFrame, size: int) -> tuple[list[Tree], np.ndarray]:
        width, growth, count = self.bins, self.growth, self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            label = np.concatenate([b.column("label").to_numpy() for b in parts]).astype(float)
            bins = np.concatenate([_bins_of(b.column("bins"), size) for b in parts])
            margin = np.concatenate([b.column("margin").to_numpy() for b in parts])
            n = np.concatenate([b.column("n").to_numpy() for b in parts])
            for _ in range(count):
                g, h = gradients(margin, label)
                tree, gains = grown(lambda t, nodes: histograms(t, nodes, bins, g, h, width, n), growth)  # noqa: B023
                margin = margin + tree.margin(bins)
                columns = [tree.feature, tree.bin, tree.left, tree.value, tree.rows, gains.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=_TREE_NAMES)

        found = rows.coalesce(1).mapInArrow(run, _TREE)  # at most ``local_rows`` rows
        trees = [(Tree(*[r[n] for n in _TREE_NAMES[:-1]]), np.array(r["gains"])) for r in found.collect()]
        unstaged(rows)
        return [t for t, _ in trees], sum((g for _, g in trees), np.zeros(size))

    def _in_spark(self, rows: DataFrame, size: int) -> tuple[list[Tree], np.ndarray]:
        width, trees, gains = self.bins, [], np.zeros(size)
        for turn in range(self.trees):
            if turn:
                before, rows = rows, staged(_moved(rows, trees[-1], size), "boosting")
                unstaged(before)
            tree, gain = grown(self._measure(rows, size, width), self.growth)
            trees.append(tree)
            gains += gain
        unstaged(rows)
        return trees, gains

    @staticmethod
    def _measure(rows: DataFrame, size: int, width: int) -> Measure:
        def measure(tree: Tree, nodes: list[int]) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(nodes), size, width, 3))
                for batch in _together(batches):
                    margin, label, n = (batch.column(c).to_numpy() for c in ("margin", "label", "n"))
                    bins = _bins_of(batch.column("bins"), size)
                    some, at = tree.reached(bins, nodes)
                    total += _summed(at, len(nodes), bins[some], *gradients(margin[some], label[some]), width, n[some])
                yield row_sums(total.reshape(len(nodes) * size, width * 3))

            found = added_up(rows.mapInArrow(run, ROWS), len(nodes) * size, width * 3)
            return np.rint(found).reshape(len(nodes), size, width, 3)  # whole numbers, which Spark adds up with a rounding error

        return measure


_TREE_NAMES = ["feature", "bin", "left", "value", "rows", "gains"]
_TREE = "feature array<bigint>, bin array<bigint>, `left` array<bigint>, value array<double>, rows array<double>, gains array<double>"


def _moved(rows: DataFrame, tree: Tree, size: int) -> DataFrame:
    """The rows with the margin of ``tree`` added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            if batch.num_rows:
                bins = _bins_of(batch.column("bins"), size)
                margin = batch.column("margin").to_numpy() + tree.margin(bins)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), batch.column("bins"), pa.array(margin), batch.column("n")], names=["label", "bins", "margin", "n"]
                )

    return rows.mapInArrow(run, "label bigint, bins binary, margin double, n double")


@dataclass
class FittedBoostedTrees:
    start: float
    trees: list[Tree]
    cuts: list[np.ndarray]
    gains: list[float]

    def _margins(self, rows: DataFrame) -> DataFrame:
        trees, cuts, start = self.trees, self.cuts, self.start

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = binned(matrix(batch.column("x")), cuts)
                steps = np.stack([np.full(len(bins), start), *[t.margin(bins) for t in trees]], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(steps.sum(axis=1))], names=["row_id", "label", "m"])

        return rows.select("row_id", "label", "x").mapInArrow(run, "row_id bigint, label bigint, m double")

    def score(self, rows: DataFrame) -> DataFrame:
        scored = self._margins(rows)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("m")))
        return score_table(scored, p, F.col("m") > 0)

    def leaf_rows(self, rows: DataFrame) -> DataFrame:
        """(tree, leaf, n, by_sums): rows that reach each leaf, counted anew, beside what the fit's sums say."""
        trees, cuts = self.trees, self.cuts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = binned(matrix(batch.column("x")), cuts) if batch.num_rows else None
                for i, tree in enumerate(trees if batch.num_rows else []):
                    leaf, n = np.unique(tree.leaves(bins), return_counts=True)
                    columns = [pa.array(np.full(len(leaf), i)), pa.array(leaf), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "n"])

        counted = rows.select("x").mapInArrow(run, "tree bigint, leaf bigint, n bigint").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
        known = [(i, j, t.rows[j]) for i, t in enumerate(trees) for j, f in enumerate(t.feature) if f < 0]
        sums = rows.sparkSession.createDataFrame(known, "tree bigint, leaf bigint, by_sums double")
        return sums.join(counted, ["tree", "leaf"], "full")

    def staged_loss(self, rows: DataFrame) -> DataFrame:
        """(round, loss): mean log loss after each round; round 0 is the start value alone."""
        trees, cuts, start = self.trees, self.cuts, self.start

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(trees) + 1), 0
            for batch in _together(batches):
                bins = binned(matrix(batch.column("x")), cuts)
                sign = np.where(pc.fill_null(pc.equal(batch.column("label"), 1), False).to_numpy(zero_copy_only=False), -1.0, 1.0)
                margin = np.full(len(bins), start)
                for i in range(len(total)):
                    margin = margin + trees[i - 1].margin(bins) if i else margin
                    total[i] += np.logaddexp(0.0, sign * margin).sum()
                n += len(bins)
            if n:
                columns = [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))]
                yield pa.RecordBatch.from_arrays(columns, names=["round", "total", "n"])

        parts = rows.select("label", "x").mapInArrow(run, "round int, total double, n bigint")
        return parts.groupBy("round").agg((F.sum("total") / F.sum("n")).alias("loss"))

    def importances(self) -> list[float]:
        return list(self.gains)
