"""Exact nearest neighbours and kernel sums without emitting row pairs.

Rows go to the nearest of a few pivots.  Queries of neighbouring cells form groups
of bounded size; the points of every cell that a group may need stream past it,
the nearest cells first, in packs of few rows.  A task holds one group and one
chunk of points, compares them by one matrix product and keeps k candidates or one
sum per query, so a dense region or a third of all rows being equal only means
more groups and packs.  The triangle inequality drops cells for a whole group
beforehand, and for single queries while their k-th distance shrinks.

The matrix product rounds, so it only selects: every pair within its proven error of
the k-th distance is computed anew, feature by feature.  Equal queries are asked
once, and of equal points the k with the smallest ids take part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonelens.functions.arrays import matrix
from clonelens.functions.hashing import seeded_hash
from clonelens.functions.skew import salted_join, shuffled_join
from clonelens.session import staged

BLOCK_ROWS = 1024  # points compared with a group at a time
GROUP_ROWS = 4096  # queries a task holds at once
_GROUPS_PER_CORE = 3  # wanted, so that all cores have work
_SLICE = 128  # queries compared in one numpy step, so that it stays in the processor's cache
_PACK = 16  # points that travel as one row
_WAITING = 1 << 16  # rows a task holds while it packs them by cell
_MAX_PIVOTS = 512  # bounds the pivot table and the cell-pair table
_CELL_ROWS = 256  # points a cell holds on average, while there are fewer pivots than that bound
_DISTANCE_PLACES = 9  # distances are rounded before ranking, so engines agree on ties
_ROUNDED = 2e-9  # more than two distances that round to the same number can differ by
_EXP_UNDERFLOW = 745.2  # exp(-v) is exactly 0.0 in double precision beyond this


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, summed feature by feature (no cancellation for equal rows)."""
    total = np.zeros((len(a), len(b)))
    for at in range(a.shape[1]):
        total += (a[:, at, None] - b[None, :, at]) ** 2
    return total


def _near_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all squared distances by one matrix product, per row of ``a`` how much they may be off)."""
    middle = b.mean(axis=0)  # near the middle less cancels out
    a, b = a - middle, b - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    out = a @ b.T
    out *= -2.0
    out += aa[:, None]
    out += bb
    shift = float(middle @ middle)
    return out, (4 * a.shape[1] + 32) * np.finfo(float).eps * (aa + bb.max() + shift)


def _pair_squares(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The squared distances of the pairs (i, j), summed feature by feature."""
    total = np.zeros(len(i))
    for at in range(a.shape[1]):
        total += (a[i, at] - b[j, at]) ** 2
    return total


@dataclass
class _Cells:
    rows: DataFrame  # input columns + cell
    counts: dict[int, int]
    radius: dict[int, float]


def _assign(df: DataFrame, pivots: np.ndarray) -> _Cells:
    """Add the nearest pivot; measure the cells (a row per pivot)."""
    schema = T.StructType(
        [*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]
    )

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            cell = np.concatenate([_near_squares(x[at : at + BLOCK_ROWS], pivots)[0].argmin(axis=1) for at in range(0, len(x), BLOCK_ROWS)])
            gap = np.sqrt(_pair_squares(x, pivots, np.arange(len(x)), cell))  # of two nearly equally near pivots either will do
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(gap, pa.float64())],
                names=[*batch.schema.names, "cell", "gap"],
            )

    placed = staged(df.mapInArrow(nearest, schema), "cells")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r")).collect()  # at most one row per pivot
    return _Cells(placed, {s["cell"]: s["n"] for s in stats}, {s["cell"]: s["r"] for s in stats})


def _needed_cells(
    queries: _Cells, points: _Cells, pivots: np.ndarray, k: int | None, radius: float | None
) -> list[tuple[int, int]]:
    """Cell pairs that may hold a neighbour: within ``radius``, or within the k-th distance's bound."""
    between = np.sqrt(squared_distances(pivots, pivots))
    cells = np.array(sorted(points.radius), dtype=int)
    radii = np.array([points.radius[p] for p in cells])
    counts = np.array([points.counts[p] for p in cells])
    needed = []
    for q, q_radius in queries.radius.items():
        reach = radius
        if reach is None:
            farthest = between[q, cells] + radii
            order = np.argsort(farthest, kind="stable")
            enough = np.flatnonzero(np.cumsum(counts[order]) >= k)
            reach = farthest[order[enough[0]]] + q_radius if len(enough) else math.inf
        near = between[q, cells] - q_radius - radii <= reach * (1 + 1e-9) + 1e-9
        needed += [(q, int(p)) for p in cells[near]]
    return needed


def _pivots(points: DataFrame) -> np.ndarray:
    """Points drawn by hash: about one for ``_CELL_ROWS`` points, a bounded number."""
    count = min(_MAX_PIVOTS, max(1, points.count() // _CELL_ROWS))
    chosen = points.orderBy(seeded_hash("pivot", F.col("row_id"))).limit(count)
    return np.array([r["x"] for r in chosen.select("x").collect()], dtype=float)


def _chain(pivots: np.ndarray, cells: list[int]) -> list[int]:
    """The cells one after the other, each the nearest to the one before that is left."""
    left, out = list(cells), []
    while left:
        at = 0 if not out else int(squared_distances(pivots[[out[-1]]], pivots[left])[0].argmin())
        out.append(left.pop(at))
    return out


def _groups(queries: _Cells, pivots: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """cell -> (first group, groups): small neighbouring cells share one, large cells have several."""
    out, group, held = {}, -1, most
    for cell in _chain(pivots, sorted(queries.counts)):
        n = queries.counts[cell]
        if n > most:
            out[cell], group, held = (group + 1, -(-n // most)), group + -(-n // most), most
            continue
        if held + n > most:
            group, held = group + 1, 0
        out[cell], held = (group, 1), held + n
    return out


_PACKED = "cell int, ids binary, xs binary, vs binary"


def _packed(rows: DataFrame) -> DataFrame:
    """(cell, ids, xs, vs): up to ``_PACK`` rows (row_id, x, v, cell) of one cell as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def out() -> pa.RecordBatch:
            cell, ids, x, v = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(cell, kind="stable")
            cell, ids, x, v = cell[order], ids[order], x[order], v[order]
            begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            inside = np.arange(len(cell)) - np.repeat(begins, np.diff(np.append(begins, len(cell))))
            cuts = np.flatnonzero(inside % _PACK == 0)
            ends = np.append(cuts[1:], len(cell))
            packs = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()) for c in (ids, x, v)]
            return pa.RecordBatch.from_arrays([pa.array(cell[cuts]), *packs], names=["cell", "ids", "xs", "vs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column("cell").to_numpy(), batch.column("row_id").to_numpy(), matrix(batch.column("x")), matrix(batch.column("v"))))
            n += batch.num_rows
            if n >= _WAITING:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return rows.select("cell", "row_id", "x", "v").mapInArrow(run, _PACKED)


def _met(
    queries: _Cells, points: _Cells, valued: DataFrame, pivots: np.ndarray, most: int, k: int | None = None, radius: float | None = None
) -> DataFrame:
    """Packs of each group's queries (asks = 0), then of the points it may need, nearest cells first.

    ``valued`` is the points' rows with an array of doubles ``v``.
    """
    spark = queries.rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = sum(queries.counts.values())
    most = max(1, min(most, -(-n // (cores * _GROUPS_PER_CORE))))
    groups = _groups(queries, pivots, most)
    between = np.sqrt(squared_distances(pivots, pivots))
    wanted: dict[int, dict[int, float]] = {}
    for q, p in _needed_cells(queries, points, pivots, k, radius):
        first, count = groups[q]
        for g in range(first, first + count):
            found = wanted.setdefault(p, {})
            found[g] = min(found.get(g, math.inf), float(between[q, p]))
    # at most _MAX_PIVOTS rows each, so the broadcasts are bounded
    places = F.broadcast(spark.createDataFrame([(c, f, m) for c, (f, m) in groups.items()], "cell int, first int, many int"))
    plan = F.broadcast(
        spark.createDataFrame([(p, [(g, a) for g, a in some.items()]) for p, some in wanted.items()], "cell int, to array<struct<group:int,far:double>>")
    )
    own = F.col("first") + F.pmod(F.hash("ids"), F.col("many"))
    asking = _packed(queries.rows.withColumn("v", F.array(F.lit(0.0))))
    asking = asking.join(places, "cell").select(own.alias("group"), F.lit(0).alias("asks"), F.lit(-1.0).alias("far"), "cell", "ids", "xs", "vs")
    held = _packed(valued).join(plan, "cell").select(F.explode("to").alias("to"), "cell", "ids", "xs", "vs")
    held = held.select(F.col("to.group").alias("group"), F.lit(1).alias("asks"), F.col("to.far").alias("far"), "cell", "ids", "xs", "vs")
    total = max((f + m for f, m in groups.values()), default=1)
    # the number is given, because the work of a group does not show in its bytes
    return asking.unionByName(held).repartition(total, "group").sortWithinPartitions("group", "asks", "far", "cell")


def _streamed(met: DataFrame, size: int, width: int, start: Callable, schema: str, block_rows: int) -> DataFrame:
    """Per group: ``start(ids, x)`` takes its queries; the result's ``add(cell, ids, x, v)`` takes points, ``out()`` ends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, held = None, None, []  # the group, its state, waiting packs of one cell

        def flush() -> None:
            nonlocal step
            if not held:
                return
            ids, xs, vs = (b"".join(c) for c in zip(*held))
            held.clear()
            ids, xs = np.frombuffer(ids, np.int64), np.frombuffer(xs).reshape(-1, size)
            if not at[1]:
                step = start(ids, xs)
            elif step is not None:
                step.add(at[2], ids, xs, np.frombuffer(vs).reshape(-1, width))

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, asks, cells = (batch.column(c).to_numpy() for c in ("group", "asks", "cell"))
            packs = [batch.column(c) for c in ("ids", "xs", "vs")]
            for i in range(batch.num_rows):
                here = (groups[i], asks[i], cells[i] if asks[i] else -1)
                if here != at or (asks[i] and len(held) * _PACK >= block_rows):
                    flush()
                    if at is not None and here[0] != at[0] and step is not None:
                        yield from step.out()
                        step = None
                    at = here
                held.append(tuple(p[i].as_py() for p in packs))
        if at is not None:
            flush()
            if step is not None:
                yield from step.out()

    return met.mapInArrow(run, schema)


class _Nearest:
    """The k nearest points so far of a group's queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, pivots: np.ndarray, radius: dict[int, float]):
        self.ids, self.x, self.k, self.pivots, self.radius = ids, x, k, pivots, radius
        self.gap = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.label = np.zeros((len(ids), k))

    def add(self, cell: int, ids: np.ndarray, x: np.ndarray, v: np.ndarray) -> None:
        limit = self.gap[:, -1] + _ROUNDED
        far = np.sqrt(_pair_squares(self.x, self.pivots, np.arange(len(self.x)), np.full(len(self.x), cell))) - self.radius[cell]
        active = np.flatnonzero(far <= limit * (1 + 1e-9) + 1e-9)
        if not len(active):
            return
        near, off = _near_squares(self.x[active], x)
        bound = limit[active] ** 2
        fresh = np.flatnonzero(np.isinf(bound))
        if len(fresh) and len(ids) > self.k:
            kth = np.sqrt(np.maximum(np.partition(near[fresh], self.k - 1, axis=1)[:, self.k - 1] + off[fresh], 0.0))
            bound[fresh] = (kth + _ROUNDED) ** 2
        i, j = np.nonzero(near <= (bound * (1 + 1e-9) + off)[:, None])
        if not len(i):
            return
        i = active[i]
        gap = np.round(np.sqrt(_pair_squares(self.x, x, i, j)), _DISTANCE_PLACES)
        met = np.unique(i)
        k = self.k
        row = np.concatenate([np.repeat(met, k), i])
        gap = np.concatenate([self.gap[met].ravel(), gap])
        found = np.concatenate([self.found[met].ravel(), ids[j]])
        label = np.concatenate([self.label[met].ravel(), v[j, 0]])
        order = np.lexsort((found, gap, row))
        row = row[order]
        begins = np.searchsorted(row, met)
        best = order[begins[:, None] + np.arange(k)]
        self.gap[met], self.found[met], self.label[met] = gap[best], found[best], label[best]

    def out(self) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(np.isfinite(self.gap))
        columns = [self.ids[i], self.found[i, j], self.label[i, j].astype(np.int64), self.gap[i, j], (j + 1).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "neighbour_id", "label", "distance", "rank"])


def nearest_neighbours(queries: DataFrame, points: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_id, rank, neighbour_id, label, distance): the exact ``k`` nearest points of each query.

    ``queries(row_id, x)``, ``points(row_id, x, label)``.  Equal distances go by id.
    """
    typed = points.select("row_id", "x", F.array(F.col("label").cast("double")).alias("v"))
    same = Window.partitionBy("h1", "h2").orderBy("row_id")  # cut to k rows per task before it is shuffled
    typed = typed.select("*", *_content()).withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k)
    typed = staged(typed.drop("h1", "h2", "n"), "points")
    asked, members = _distinct(queries)
    schema = "at bigint, neighbour_id bigint, label bigint, distance double, rank int"
    pivots = _pivots(typed)
    if not len(pivots):
        none = asked.sparkSession.createDataFrame([], schema).withColumnRenamed("at", "row_id")
        return none.select("row_id", "neighbour_id", "label", "distance", "rank")
    p_cells = _assign(typed, pivots)
    met = _met(_assign(asked, pivots), p_cells, p_cells.rows, pivots, GROUP_ROWS, k=k)
    radius = p_cells.radius

    def start(ids: np.ndarray, x: np.ndarray) -> _Nearest:
        return _Nearest(ids, x, k, pivots, radius)

    found = _streamed(met, pivots.shape[1], 1, start, schema, block_rows)
    lists = found.groupBy("at").agg(F.collect_list(F.struct("neighbour_id", "label", "distance", "rank")).alias("near"))  # k each
    return salted_join(members, lists, "at", "row_id").select("row_id", F.inline("near"))


@dataclass
class _Merged:
    """Rows with equal vectors as one: ``cells`` of the distinct vectors, ``members`` (row_id, at)."""

    cells: _Cells
    members: DataFrame
    n: int


def _content() -> list:
    return [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2")]


def _distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors as (row_id, x), members (row_id, at)); ``at`` is the smallest row_id of equals."""
    hashed = staged(rows.select("row_id", "x", *_content()), "hashed")
    first = hashed.groupBy("h1", "h2").agg(F.min("row_id").alias("at"), F.first("x").alias("x"))
    first = staged(first, "distinct")
    members = salted_join(hashed.drop("x"), first.drop("x"), ["h1", "h2"], "row_id").select("row_id", "at")
    return first.select(F.col("at").alias("row_id"), "x"), staged(members, "members")


class _Sums:
    """The kernel sums so far of a group's queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, gamma: float, width: int, skip_self: bool):
        self.ids, self.x, self.gamma, self.skip_self = ids, x, gamma, skip_self
        self.total = np.zeros((len(ids), width))

    def add(self, cell: int, ids: np.ndarray, x: np.ndarray, v: np.ndarray) -> None:
        middle = x.mean(axis=0)
        a, b = self.x - middle, x - middle
        # one product gives -gamma d^2: (a, 1, |a|^2) times (2 gamma b, -gamma |b|^2, -gamma)
        a = np.column_stack([a, np.ones(len(a)), (a * a).sum(axis=1)])
        b = np.column_stack([2.0 * self.gamma * b, -self.gamma * (b * b).sum(axis=1), np.full(len(b), -self.gamma)]).T
        same = np.intersect1d(self.ids, ids, return_indices=True)[1:] if self.skip_self else None
        for at in range(0, len(a), _SLICE):
            kernel = a[at : at + _SLICE] @ b
            np.minimum(kernel, 0.0, out=kernel)
            np.exp(kernel, out=kernel)
            if same is not None:  # equal vectors are added later, where nothing large has to cancel out
                here = (same[0] >= at) & (same[0] < at + _SLICE)
                kernel[same[0][here] - at, same[1][here]] = 0.0
            self.total[at : at + _SLICE] += kernel @ v

    def out(self) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(self.ids), *[pa.array(self.total[:, i]) for i in range(self.total.shape[1])]]
        yield pa.RecordBatch.from_arrays(columns, names=["at", *[f"s_{i}" for i in range(self.total.shape[1])]])


@dataclass
class KernelIndex:
    """Points placed into cells once, for kernel sums with changing values.

    Equal points are merged and their values added up first, equal queries are
    asked once.  The cell pairs further apart than the radius beyond which the
    kernel is exactly 0.0 are dropped; if the kernel reaches everything, the work
    grows with the square of the distinct vectors.
    """

    gamma: float
    pivots: np.ndarray
    points: _Merged
    block_rows: int

    @classmethod
    def build(cls, points: DataFrame, gamma: float, block_rows: int = BLOCK_ROWS) -> KernelIndex:
        """``points(row_id, x)``."""
        distinct, members = _distinct(points)
        pivots = _pivots(distinct)
        return cls(gamma, pivots, _Merged(_assign(distinct, pivots), members, members.count()), block_rows)

    def place(self, queries: DataFrame) -> _Merged:
        distinct, members = _distinct(queries)
        return _Merged(_assign(distinct, self.pivots), members, members.count())

    def sums(
        self, queries: _Merged, values: DataFrame, width: int, skip_self: bool = False
    ) -> DataFrame:
        """(row_id, s_0, s_1, ...): sum over all points of exp(-gamma d^2) * v.

        ``values(row_id, v array<double>)`` has a row per point and ``width``
        values each.  A query with no point in reach gets no row.  ``skip_self``
        leaves out the point with the query's own id.
        """
        gamma = self.gamma
        names = [f"s_{i}" for i in range(width)]

        def start(ids: np.ndarray, x: np.ndarray) -> _Sums:
            return _Sums(ids, x, gamma, width, skip_self)

        radius = math.sqrt(_EXP_UNDERFLOW / gamma)
        each = [F.sum(F.col("v")[i]) for i in range(width)]
        added = shuffled_join(values, self.points.members, "row_id").groupBy(F.col("at").alias("row_id")).agg(F.array(*each).alias("v"))
        cells = self.points.cells
        valued = shuffled_join(cells.rows, added, "row_id")
        met = _met(queries.cells, cells, valued, self.pivots, GROUP_ROWS, radius=radius)
        schema = "at bigint, " + ", ".join(f"{n} double" for n in names)
        found = _streamed(met, self.pivots.shape[1], width, start, schema, self.block_rows)
        if skip_self:  # rows equal to the query: their kernel value is 1, its own part is taken out
            found = shuffled_join(found, added.select(F.col("row_id").alias("at"), F.col("v").alias("equal")), "at", "left")
        out = salted_join(queries.members, found, "at", "row_id", rows=queries.n).drop("at")
        if skip_self:
            out = shuffled_join(out, values.select("row_id", "v"), "row_id", "left")
            others = [F.coalesce(F.col("equal")[i] - F.col("v")[i], F.lit(0.0)) for i in range(width)]
            out = out.select("row_id", *[(F.col(n) + others[i]).alias(n) for i, n in enumerate(names)])
        return out
