"""Whitening of embeddings by a bidiagonal qd solver.

Entries become integers (``floor(SCALE * c)``).  Each distinct integer vector is
fitted once: Spark adds up exact column sums, tasks reduce their centred rows
block by block to triangular factors R, and a tree of tasks joins the factors
until one is left.  The driver receives that one R (dimension x dimension),
bidiagonalises it by Householder reflections, finds all singular values by dqds
(differential quotient-difference steps with shifts, which keep every value's
leading digits) and recovers the leading directions from twisted factorisations.
The covariance itself is never formed.

Close eigenvalues share one basis: their vectors come from several twist places
by inverse iteration, are made orthogonal and rotated by their small projected
matrix.  Directions whose singular value is below double precision next to the
largest have no scale and are left out.

Defined cases: rows whose vector is missing or holds null or non-finite entries
are dropped; vectors of different lengths are fitted apart, as if each length were
a table of its own (one after the other); empty vectors have no component;
entries beyond the integer range are cut to it; repeated rows count once in
the fit and each give their own output; rows without an id stay; equal rows get
equal results; an empty table gives no rows.  ``deviation`` is null where it is
beyond a long.  ``whiten`` passes all columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonelens.llm.common import packed_row, table
from clonelens.llm.vectors import lists, matrix
from clonelens.session import staged

SCALE = 256
COMPONENTS = 4
BLOCK = 4096  # rows reduced at a time
FAN = 8  # triangular factors joined by one task
CLOSE = 1e-3  # relative distance of eigenvalues that share a basis
_EPS = float(np.finfo(float).eps)
_SAFE = float(1 << 62)


# ---- rows as integers ----------------------------------------------------------------------


def finite(column: str = "embedding") -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    sound = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(sound, F.lit(False))


def integers(column: str = "embedding") -> Column:
    return F.transform(column, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint"))


def _whole(column: pa.Array) -> np.ndarray:
    return matrix(column).astype(np.int64, copy=False)


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(float)).max(initial=0.0))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers if they fit, else as Python's."""
    if n * _largest(x) + max(map(abs, sums), default=0) < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once."""
    return _deviations(x, n, sums).astype(float) / n


def squared_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    d = _deviations(x, n, sums)
    if d.dtype != object and _largest(d) ** 2 * d.shape[1] < _SAFE:
        return (d * d).sum(axis=1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in exact]


# ---- sums and triangular factors, in Spark -------------------------------------------------


def column_sums(fit: DataFrame, length: int) -> list[int]:
    """The exact sum of every dimension over the rows (x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * length
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch.column("x"))
            part = x.sum(axis=0) if _largest(x) * len(x) < _SAFE else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
        at = [i for i, v in enumerate(total) if v]
        values = pa.array([Decimal(total[i]) for i in at], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), values], names=["at", "v"])

    parts = fit.select("x").mapInArrow(run, "at int, v decimal(38,0)")
    found = parts.groupBy("at").agg(F.sum("v").alias("v")).collect()  # one row per dimension
    out = [0] * length
    for row in found:
        out[row["at"]] = int(row["v"])
    return out


def _factor(node: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), lists(r.reshape(1, -1))], names=["node", "r"])


_FACTOR = "node bigint, r array<double>"


def triangular(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: blocks within a task, then ``FAN`` factors per task until one is left."""
    length = len(sums)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, length))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _whole(batch.column("x").slice(at, BLOCK))
                r = np.linalg.qr(np.vstack([r, centred(x, n, sums)]), mode="r")
        if len(r):
            yield _factor(TaskContext.get().partitionId(), r)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, factors in zip(batch.column("node").to_pylist(), batch.column("rs")):
                r = np.zeros((0, length))
                for one in factors.values:
                    r = np.linalg.qr(np.vstack([r, one.values.to_numpy().reshape(-1, length)]), mode="r")
                yield _factor(node, r)

    factors = staged(fit.select("x").mapInArrow(rows, _FACTOR), "whiten-factors")
    left = factors.count()
    while left > 1:
        places = factors.select(F.floor(F.col("node") / F.lit(FAN)).alias("node"), "r")
        groups = places.groupBy("node").agg(F.collect_list("r").alias("rs"))  # at most FAN factors
        factors = staged(groups.mapInArrow(joined, _FACTOR), "whiten-factors")
        left = factors.count()
    found = factors.first()
    return np.array(found["r"]).reshape(-1, length)


# ---- the bidiagonal problem, on the driver -------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta): I - beta v v' maps ``x`` onto the first axis."""
    size = np.linalg.norm(x)
    if size == 0.0 or not np.any(x[1:]):
        return x, 0.0
    v = x.copy()
    v[0] += size if x[0] >= 0 else -size
    return v, 2.0 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, right): R = left B right' with an upper bidiagonal B."""
    k = r.shape[1]
    a = np.zeros((k, k))
    a[: len(r)] = r
    right = np.eye(k)
    for j in range(k):
        v, beta = _reflector(a[j:, j].copy())
        if beta:
            a[j:, j:] -= beta * np.outer(v, v @ a[j:, j:])
        if j < k - 2:
            v, beta = _reflector(a[j, j + 1 :].copy())
            if beta:
                a[j:, j + 1 :] -= beta * np.outer(a[j:, j + 1 :] @ v, v)
                right[:, j + 1 :] -= beta * np.outer(right[:, j + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential quotient-difference step, None if the shift is beyond the smallest value."""
    out_q, out_e = [0.0] * len(q), [0.0] * len(e)
    d = q[0] - shift
    for i, step in enumerate(e):
        if d < 0.0:
            return None
        top = d + step
        out_q[i] = top
        ratio = q[i + 1] / top if top else 0.0
        out_e[i] = step * ratio
        d = d * ratio - shift if top else q[i + 1] - shift
    if d < 0.0 or d != d:
        return None
    out_q[-1] = d
    return out_q, out_e


def _corner(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows, an upper bound that is near at the end."""
    a, b = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1]
    off = q[-2] * e[-1]
    mean, half = 0.5 * (a + b), 0.5 * (a - b)
    root = (half * half + off) ** 0.5
    return max(0.0, (a * b - off) / (mean + root)) if mean + root else 0.0


def _below(q: list[float], e: list[float]) -> float:
    """A lower bound of the smallest eigenvalue: one over the trace of the inverse."""
    if min(q) <= 0.0:
        return 0.0
    inverse, total = 1.0 / q[0], 1.0 / q[0]
    for i, step in enumerate(e):
        inverse = (1.0 + step * inverse) / q[i + 1]
        total += inverse
    return (1.0 - 8 * len(q) * _EPS) / total if total < 1e300 else 0.0


def squared_singular_values(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """All squared singular values of the bidiagonal matrix, largest first."""
    work = [((diagonal**2).tolist(), (superdiagonal**2).tolist(), 0.0)]
    found: list[float] = []
    while work:
        q, e, moved = work.pop()
        if len(q) == 1:
            found.append(q[0] + moved)
            continue
        small = [s <= _EPS * _EPS * (moved + min(q[i], q[i + 1])) or s == 0.0 for i, s in enumerate(e)]
        if any(small):
            at = small.index(True) + 1
            work += [(q[:at], e[: at - 1], moved), (q[at:], e[at:], moved)]
            continue
        if q[0] < q[-1]:  # the small values belong to the end; reversed and transposed, the values stay
            q, e = q[::-1], e[::-1]
        for shift in (_corner(q, e) * (1.0 - 1e-3 * min(1.0, e[-1] / (q[-1] + 1e-300))), _below(q, e), 0.0):
            stepped = _dqds(q, e, shift)
            if stepped is not None:
                break
        work.append((*stepped, moved + shift))
    return np.sort(np.array(found))[::-1]


class _Twisted:
    """Both factorisations of B'B - value I, met at the place with the smallest pivot."""

    def __init__(self, diagonal: np.ndarray, superdiagonal: np.ndarray, value: float):
        q, e, off = diagonal**2, superdiagonal**2, diagonal[:-1] * superdiagonal
        k = len(q)
        tiny = _EPS * _EPS * (abs(value) + float(q.max()) * _EPS) or 1e-300
        guard = lambda x: x if abs(x) > tiny else -tiny
        self.down, self.up = np.zeros(k), np.zeros(k)  # pivots from the top and from the end
        self.low, self.high = np.zeros(k), np.zeros(k)
        s = -value
        stationary = np.zeros(k)
        for i in range(k):
            stationary[i] = s
            self.down[i] = guard(s + q[i])
            if i < k - 1:
                self.low[i] = off[i] / self.down[i]
                s = e[i] / self.down[i] * s - value
        p = q[-1] - value
        progressive = np.zeros(k)
        progressive[-1] = p
        self.up[0] = 1.0
        for i in range(k - 2, -1, -1):
            self.up[i + 1] = guard(e[i] + p)
            self.high[i] = off[i] / self.up[i + 1]
            p = p * (q[i] / self.up[i + 1]) - value
            progressive[i] = p
        self.pivots = stationary + progressive + value
        self.places = np.argsort(np.abs(self.pivots), kind="stable")
        self.guard = guard

    def vector(self, place: int) -> np.ndarray:
        z = np.zeros(len(self.down))
        z[place] = 1.0
        for i in range(place - 1, -1, -1):
            z[i] = -self.low[i] * z[i + 1]
        for i in range(place, len(z) - 1):
            z[i + 1] = -self.high[i] * z[i]
        return z / np.linalg.norm(z)

    def solved(self, b: np.ndarray) -> np.ndarray:
        """A solution of (B'B - value I) y = b, scaled to length 1."""
        r, y = int(self.places[0]), b.copy()
        for i in range(r):
            y[i + 1] -= self.low[i] * y[i]
        for i in range(len(y) - 2, r - 1, -1):
            y[i] -= self.high[i] * y[i + 1]
        y[:r] /= self.down[:r]
        y[r] /= self.guard(self.pivots[r])
        y[r + 1 :] /= self.up[r + 1 :]
        for i in range(r - 1, -1, -1):
            y[i] -= self.low[i] * y[i + 1]
        for i in range(r, len(y) - 1):
            y[i + 1] -= self.high[i] * y[i]
        return y / np.linalg.norm(y)


def _orthogonal(z: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in basis:
            z = z - (other @ z) * other
    return z


def _basis(diagonal: np.ndarray, superdiagonal: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors, as columns, of a group of close eigenvalues."""
    factored = [_Twisted(diagonal, superdiagonal, float(v)) for v in values]
    if len(values) == 1:
        return factored[0].vector(int(factored[0].places[0]))[:, None]
    basis: list[np.ndarray] = []
    for one in factored:
        best, size = None, 0.0
        for place in one.places:
            z = _orthogonal(one.vector(int(place)), basis)
            if np.linalg.norm(z) > size:
                best, size = z, float(np.linalg.norm(z))
            if size > 0.5:
                break
        z = best / size
        for _ in range(3):
            z = _orthogonal(one.solved(z), basis)
            z = z / np.linalg.norm(z)
        basis.append(z)
    z, _ = np.linalg.qr(np.stack(basis, axis=1))
    image = diagonal[:, None] * z
    image[:-1] += superdiagonal[:, None] * z[1:]
    _, turn = np.linalg.eigh(image.T @ image)
    return z @ turn[:, ::-1]


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, directions as columns, trace) of R'R; at most ``count`` pairs that double precision resolves."""
    size = float(np.abs(r).max(initial=0.0))
    k = r.shape[1]
    if not size:
        return np.zeros(0), np.zeros((k, 0)), 0.0
    diagonal, superdiagonal, right = bidiagonal(r / size)
    values = squared_singular_values(diagonal, superdiagonal)
    clear = int((values > values[0] * (k * _EPS * 1e4) ** 2).sum())
    wanted = min(count, clear)
    columns: list[np.ndarray] = []
    at = 0
    while at < wanted:
        to = at + 1
        while to < clear and values[to - 1] - values[to] < CLOSE * values[to - 1]:
            to += 1
        columns.append(_basis(diagonal, superdiagonal, values[at:to]))
        at = to
    found = right @ np.hstack(columns)[:, :wanted]
    return values[:wanted] * size**2, found, float(values.sum()) * size**2


# ---- the operator --------------------------------------------------------------------------


@dataclass
class Whitening:
    """What is fitted for one vector length; the driver and every task hold dimension x components numbers."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float = 0.0

    def transform(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.directions / np.sqrt(self.values)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.transform(_whole(batch.column("x")))
                part = w.mean(axis=0)
                n, mean, spread = _merged((n, mean, spread), (len(w), part, (w - part).T @ (w - part)))
        row = np.concatenate([[n], mean, spread.ravel()])[None, :]
        yield pa.RecordBatch.from_arrays([lists(row)], names=["v"])

    total = (0, np.zeros(k), np.zeros((k, k)))
    for row in fit.select("x").mapInArrow(run, "v array<double>").toLocalIterator():  # one short row per task
        v = np.array(row["v"])
        total = _merged(total, (int(v[0]), v[1 : k + 1], v[k + 1 :].reshape(k, k)))
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two sets of rows together."""
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """A fit per vector length over the distinct integer vectors."""
    x = vectors.filter(finite(column)).select(integers(column).alias("x")).filter(F.size("x") > 0)
    distinct = staged(x.distinct().withColumn("k", F.size("x")), "whiten-fit")
    out = {}
    for row in distinct.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect():
        fit = distinct.filter(F.col("k") == row["k"])
        sums = column_sums(fit, row["k"])
        values, directions, trace = leading(triangular(fit, row["n"], sums), components)
        model = Whitening(row["n"], sums, values / row["n"], directions, trace / row["n"])
        model.identity_error = _identity_error(fit, model)
        out[row["k"]] = model
    return out


def whiten(vectors: DataFrame, models: dict[int, Whitening], column: str = "embedding") -> DataFrame:
    """(__row, length, deviation, whitened): usable rows, as structs, with their whitened vector."""
    rows = vectors.filter(finite(column)).select(packed_row(vectors), integers(column).alias("x"))
    rows = rows.filter(F.size("x") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(batch.column("x").value_lengths())
            for k in np.unique(size):
                some = batch.filter(pa.array(size == k))
                model, x = models[int(k)], _whole(some.column("x"))
                found = model.transform(x)
                white = lists(found) if found.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))
                exact = pa.array(squared_deviation(x, model.n, model.sums), pa.int64())
                columns = [some.column("__row"), pa.array([int(k)] * len(x), pa.int32()), exact, white]
                yield pa.RecordBatch.from_arrays(columns, names=["__row", "length", "deviation", "whitened"])

    kind = rows.schema["__row"].dataType.simpleString()
    return rows.mapInArrow(run, f"__row {kind}, length int, deviation bigint, whitened array<double>")


def summary(spark: SparkSession, models: dict[int, Whitening]) -> DataFrame:
    """(length, component, n, explained, identity_error), one row per length and component."""
    rows = [
        (k, i + 1, m.n, float(v / m.trace), m.identity_error) for k, m in models.items() for i, v in enumerate(m.values)
    ]
    return spark.createDataFrame(rows, "length int, component int, n bigint, explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    models = fit_whitening(vectors)
    rows = whiten(vectors, models).select("__row.vec_id", "length", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    rows = rows.withColumn("component", F.col("at") + 1).join(F.broadcast(summary(spark, models)), ["length", "component"])
    return rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error"
    )
