"""Nearest neighbours by inner product with collision-counting hashing.

Vectors are lifted to unit length by one more component, so that the largest
inner product is the smallest distance.  The index has ``HASHES`` single random
projections; the rows are dealt into blocks of about ``BLOCK`` and each block
keeps one sorted array per projection.  A query opens a window around its own
projection in every array; a row inside a window collides once.

Radii grow by ``GROWTH`` and the windows with them (virtual rehashing: the arrays
stay, and a wider window only counts the rows at its two ends that it adds).  A row
at distance d falls into a window of half width h with probability
erf(h / (d sqrt 2)), so a row within the radius has at least the collisions that the
binomial mean less ``SPREAD`` deviations gives.  Rows that reach this threshold are
verified by their exact inner product, the most collisions first: as soon as the k-th
best verified row is nearer than the radius, its distance sets a higher threshold.
The search ends when the k-th best lies within the radius.  If no radius suffices,
all rows are verified, so a query always gets its k rows if there are that many.

Queries are a stated set that meets all rows, block by block.  A query first searches
the block that holds its own row.  The k-th best inner product found there bounds the
radius in all other blocks: these open their windows once, count ``FIRST`` arrays,
leave out the rows that are ``LOOSE`` deviations short and count only the others to the
end.  They return rows that beat the bound; the blocks' results are merged by one
ranking per query.  Queries times rows stays the order of the work.  Nothing is fitted;
every row is indexed.  Recall against brute force is measured by a test (at least 0.9).

Defined cases: vectors that are missing, empty, zero or hold null or non-finite
components take no part, neither as query nor as candidate; a query's
candidates are the vectors of its length, each length has an index of its own; a row without an id is a candidate that comes last among equals;
repeated rows are separate candidates, and only the query's own row is left
out; equal scores go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonelens.functions.skew import shuffled_join
from clonelens.llm.common import NO_ID, id_order, table
from clonelens.llm.vectors import lengths, matrix, usable
from clonelens.session import staged

NEIGHBOURS = 20
HASHES = 192
SPREAD = 1.4  # deviations below the expected collisions
FIRST, LOOSE = 64, 1.8  # arrays counted before the unlikely rows are left out, and the deviations of that
NARROWEST, WIDEST, GROWTH = 0.7, 2.0, 1.2  # radii; lifted vectors are at most 2 apart
HALF = 1.0  # half width of a window at radius 1
BLOCK = 8192
_TOGETHER = 256  # queries answered together
_STEP = 64  # rows verified between two looks at the threshold
_CACHED = 1 << 16  # about as many collisions are counted together
_CLOSEST = 1e-6  # smallest radius: windows must hold equal vectors whatever the rounding
_SEED = 9


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows divided by the longest row's length, with a last component that makes them unit length."""
    x = x / longest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))
    return np.hstack([x, rest])


def threshold(half: float, distance: float, hashes: int = HASHES, spread: float = SPREAD) -> float:
    """The fewest collisions that a row at ``distance`` has in windows of this half width, but for a small chance."""
    chance = math.erf(half / (max(distance, 1e-12) * math.sqrt(2.0)))
    return hashes * chance - spread * math.sqrt(hashes * chance * (1.0 - chance))


class BlockIndex:
    """Sorted projections of one block's rows."""

    def __init__(self, uid: np.ndarray, order: np.ndarray, rows: np.ndarray, longest: float):
        self.uid, self.order, self.rows, self.longest = uid, order, rows, longest
        self.directions = np.random.default_rng(_SEED).standard_normal((rows.shape[1] + 1, HASHES))
        projected = (lifted(rows, longest) @ self.directions).T
        by_value = np.argsort(projected, axis=1)
        self.sorted = np.take_along_axis(projected, by_value, axis=1)
        self.by_value = by_value.astype(np.uint16 if len(rows) < 1 << 16 else np.uint32)  # what counting moves
        ranks = np.empty_like(self.by_value[FIRST:])
        np.put_along_axis(ranks, by_value[FIRST:], np.arange(len(rows), dtype=ranks.dtype)[None, :], axis=1)
        self.ranks = np.ascontiguousarray(ranks.T)  # a row's places in the last arrays
        self.verified = 0  # rows whose inner product was computed, over all queries

    def nearest(self, uids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, (positions, inner products) of the k best rows found."""
        lengths = np.sqrt((queries * queries).sum(axis=1))
        at = (queries / lengths[:, None]) @ self.directions[:-1]  # a query's lifted component is 0
        steps = math.ceil(math.log(WIDEST / NARROWEST) / math.log(GROWTH)) + 1
        radii = NARROWEST * GROWTH ** np.arange(steps)
        edges = HALF * np.concatenate([-radii[::-1], radii])
        # places[j, q]: where the windows of query q begin (the first half, widest first) and end in array j
        places = np.stack([np.searchsorted(s, a[:, None] + edges) for s, a in zip(self.sorted, at.T)])
        return [self._search(uid, q, length, places[:, i], radii, k) for i, (uid, q, length) in enumerate(zip(uids, queries, lengths))]

    def nearer(self, uids: np.ndarray, queries: np.ndarray, known: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, (positions, inner products) of the rows found that are among its k best, given the best inner products elsewhere.

        The k-th of them bounds the radius, so the windows open once.  A query that
        knows fewer, or none that doubles can hold, is searched as if it knew nothing.
        """
        lengths = np.sqrt((queries * queries).sum(axis=1))
        starts = [(np.full(len(v), -1), np.sort(v)[::-1]) for v in known]
        radii = np.array([self._apart(best, n, k) if np.isfinite(best[1]).all() else math.inf for best, n in zip(starts, lengths)])
        if not (bounded := radii <= WIDEST).all():
            out: list = [None] * len(uids)
            for chosen, found in (
                (~bounded, self.nearest(uids[~bounded], queries[~bounded], k)),
                (bounded, self.nearer(uids[bounded], queries[bounded], [v for v, b in zip(known, bounded) if b], k)),
            ):
                for i, f in zip(np.flatnonzero(chosen), found):
                    out[i] = f
            return out
        if not len(uids):
            return []
        radii = np.maximum(radii, _CLOSEST)
        at = (queries / lengths[:, None]) @ self.directions[:-1]
        edges = np.concatenate([at.T - HALF * radii, at.T + HALF * radii], axis=1)
        places = np.stack([np.searchsorted(s, e) for s, e in zip(self.sorted, edges)]).reshape(HASHES, 2, -1)
        return [
            self._within(uid, q, n, radius, places[:, 0, i], places[:, 1, i], best, k)
            for i, (uid, q, n, radius, best) in enumerate(zip(uids, queries, lengths, radii, starts))
        ]

    def _within(self, uid, query, length, radius, begin, end, best, k) -> tuple[np.ndarray, np.ndarray]:
        half, kind = HALF * radius, self.ranks.dtype
        counts = self._counted([v[b:e] for v, b, e in zip(self.by_value[:FIRST], begin, end)])
        rows = np.flatnonzero((counts >= threshold(half, radius, FIRST, LOOSE)) & (self.uid != uid))
        inside = np.take(self.ranks, rows, axis=0)  # in a window if rank - begin, which wraps below 0, is short of its size
        inside -= begin[FIRST:].astype(kind)
        inside = np.packbits(inside < (end - begin)[FIRST:].astype(kind), axis=1)
        total = counts[rows] + np.bitwise_count(inside).sum(axis=1, dtype=np.int64)
        rows, total = rows[(least := total >= threshold(half, radius))], total[least]
        order = np.argsort(-total, kind="stable")
        rows, total = rows[order], total[order]
        for start in range(0, len(rows), 4 * _STEP):
            if total[start] < threshold(half, min(radius, self._apart(best, length, k))):
                break
            best = self._better(best, rows[start : start + 4 * _STEP], query, k)
        here = best[0] >= 0
        return best[0][here], best[1][here]

    def _counted(self, slices: list[np.ndarray]) -> np.ndarray:
        """How often each row occurs, a few arrays at a time so that they stay in the cache."""
        arrays = max(1, len(slices) * _CACHED // max(1, sum(map(len, slices))))
        parts = [slices[at : at + arrays] for at in range(0, len(slices), arrays)]
        return sum(np.bincount(np.concatenate(p), minlength=len(self.rows)) for p in parts)

    def _search(self, uid, query, length, places, radii, k) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(self.rows), np.int64)
        left = self.uid != uid  # rows not verified yet
        best = np.zeros(0, np.int64), np.zeros(0)
        low = high = None
        for step, radius in enumerate(radii):
            begin, end = places[:, len(radii) - 1 - step], places[:, len(radii) + step]
            if step == 0:
                added = [v[b:e] for v, b, e in zip(self.by_value, begin, end)]
            else:
                added = [v[b:e] for v, b, e in zip(self.by_value, begin, low)]
                added += [v[b:e] for v, b, e in zip(self.by_value, high, end)]
            low, high = begin, end
            counts += self._counted(added)
            apart = self._apart(best, length, k)
            asked = np.flatnonzero(left & (counts >= threshold(HALF * radius, min(radius, apart))))
            asked = asked[np.argsort(-counts[asked], kind="stable")]
            for start in range(0, len(asked), _STEP):
                some = asked[start : start + _STEP]
                if counts[some[0]] < threshold(HALF * radius, min(radius, apart)):
                    break
                left[some] = False
                best = self._better(best, some, query, k)
                apart = self._apart(best, length, k)
            if apart <= radius:
                return best
        return self._better(best, np.flatnonzero(left), query, k)

    def _better(self, best, rows, query, k) -> tuple[np.ndarray, np.ndarray]:
        self.verified += len(rows)
        places = np.concatenate([best[0], rows])
        scores = np.concatenate([best[1], (self.rows[rows] * query).sum(axis=1)])
        first = np.lexsort((self.order[places], places < 0, -scores))[:k]  # a place below 0 is a row elsewhere
        return places[first], scores[first]

    def _apart(self, best, length, k) -> float:
        """Distance of the k-th best row, infinite as long as there are fewer."""
        if len(best[0]) < k:
            return math.inf
        square = 2.0 - 2.0 * best[1][-1] / (self.longest * length)
        return math.sqrt(max(square, 0.0)) if square == square else math.inf


def _batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    names = ["query", "query_id", "found_id", "score"]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found per query."""
    rows = vectors.select(
        id_order("vec_id").alias("__d"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(usable())
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for length in lengths(rows):
        out = out.unionByName(_nearest(rows.filter(F.size("embedding") == length), k))
    return out


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    """``nearest`` among usable vectors (__d, embedding, asks) of one length."""
    rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "ann-vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    summary = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(square)).alias("longest")).first()
    blocks, longest = max(1, -(-summary["n"] // BLOCK)), summary["longest"] or 1.0
    own = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("block", own)
    columns = ["block", "asking", "uid", "__d", "embedding", "known"]
    nothing = F.lit(None).cast("array<double>")  # a query in the block of its own row
    held = rows.select("*", F.lit(0).alias("asking"), nothing.alias("known")).select(columns)
    asking = rows.filter("asks").withColumn("asking", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            blocks_at, asks, uid, order = (batch.column(c).to_numpy() for c in ("block", "asking", "uid", "__d"))
            known = None
            if batch.column("known").null_count < batch.num_rows:
                known = [np.array(v or (), float) for v in batch.column("known").to_pylist()]
            cuts = np.flatnonzero((blocks_at[1:] != blocks_at[:-1]) | (asks[1:] != asks[:-1])) + 1
            for at, to in zip([0, *cuts], [*cuts, len(uid)]):
                if blocks_at[at] != block:
                    block, waiting, index = blocks_at[at], [], None
                if not asks[at]:
                    waiting.append((uid[at:to], order[at:to], x[at:to]))
                    continue
                if index is None and waiting:
                    index = BlockIndex(*[np.concatenate(c) for c in zip(*waiting)], longest)
                    waiting = []
                if index is None:
                    continue
                for start in range(at, to, _TOGETHER):
                    some = slice(start, min(start + _TOGETHER, to))
                    with np.errstate(all="ignore"):  # huge components may overflow; such queries see all rows
                        if known is None:
                            found = index.nearest(uid[some], x[some], k)
                        else:
                            found = index.nearer(uid[some], x[some], known[some], k)
                    out: list[list[np.ndarray]] = [[], [], [], []]
                    for i, (places, scores) in enumerate(found, start):
                        values = (np.full(len(places), uid[i]), np.full(len(places), order[i]), index.order[places], scores)
                        for column, value in zip(out, values):
                            column.append(value)
                    yield _batch(out)

    def searched(queries: DataFrame) -> DataFrame:
        met = held.unionByName(queries.select(columns)).repartition("block").sortWithinPartitions("block", "asking")
        return met.mapInArrow(run, "query bigint, query_id bigint, found_id bigint, score double")

    found = searched(asking.withColumn("known", nothing))
    if blocks > 1:
        found = staged(found, "ann-own-block")
        scores = found.groupBy(F.col("query").alias("uid")).agg(F.collect_list("score").alias("known"))  # at most k
        every = F.sequence(F.lit(0), F.lit(blocks - 1))
        others = shuffled_join(asking, scores, "uid", "left").withColumn("known", F.coalesce("known", F.array().cast("array<double>")))
        found = found.unionByName(searched(others.withColumn("block", F.explode(F.array_except(every, F.array("block"))))))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "found_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    number = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return ranked.select(number("query_id").alias("query_id"), "rank", number("found_id").alias("vec_id"), "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every embedding whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
