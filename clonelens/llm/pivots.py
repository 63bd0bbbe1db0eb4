"""Near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors; each vector is described
by its ``PREFIX`` nearest pivots in order.  An inverted list per pivot holds the
vectors that have it in their prefix.  Vectors that meet in a list are compared
by exact cosine in double precision; every pair at or above the threshold
counts.  The smallest shared pivot's list alone reports a pair, so nothing is counted twice and no pair is shuffled:
a list gives link counts per vector and a spanning forest of its links.

The number of pivots grows with the square root of the number of vectors, so
lists stay short.  Lists longer than ``BLOCK`` are split into blocks that meet
pairwise, each task holding one block while the other streams past.  Equal
vectors are merged into one weighted class first.

The index is approximate: a pair is missed if its prefixes share no pivot.
Longer tables have more pivots and miss more at the threshold (tests measure
recall with 64 to 2048 pivots); nothing below the threshold is ever linked.  Pivots come
from a sample of at most ``SAMPLED`` x ``MAX_PIVOTS`` vectors with the smallest
hashes; all vectors are indexed.

Defined cases: vectors that are missing, empty, zero or hold null or non-finite
components take no part and are their own component; each vector length has an
index of its own, one after the other; rows without an id are linked, but only ids name a component;
repeated rows are separate vectors with equal content; an empty table gives no
rows.  Labels are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonelens.llm.common import NO_ID, id_order, join_hot, table
from clonelens.llm.components import components
from clonelens.llm.simhash import forest
from clonelens.llm.vectors import lengths, matrix, unit, usable
from clonelens.session import staged

THRESHOLD = 0.9
PREFIX = 8
MIN_PIVOTS, MAX_PIVOTS = 64, 2048
SAMPLED = 4  # vectors looked at per pivot
APART = 0.8  # pivots have a smaller cosine than that
BLOCK = 2048
_HITS = 1 << 17


def number_of_pivots(n: int) -> int:
    """About twice the square root of ``n``, a power of two."""
    return min(MAX_PIVOTS, max(MIN_PIVOTS, 1 << round(math.log2(2 * math.sqrt(max(n, 1))))))


def equal_vectors(ids: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): the usable rows of one length with their content hash, and their classes."""
    content = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    sound = ids.filter(usable() & (F.size("embedding") == length))
    rows = staged(sound.select("vec_id", "__d", *content, "embedding"), "pivot-vectors")
    classes = rows.groupBy("h1", "h2").agg(
        F.first("embedding").alias("embedding"), F.min("__d").alias("least"), F.count(F.lit(1)).alias("weight")
    )
    return rows, staged(classes.withColumn("cid", F.monotonically_increasing_id()), "pivot-classes")


def pivots(classes: DataFrame, count: int) -> np.ndarray:
    """At most ``count`` unit vectors, no two of them near each other.

    Taken in turn from the ``SAMPLED`` x ``count`` classes with the smallest
    content hashes.  A dense group gives one pivot, however many rows it holds;
    more of them would be ordered by noise within the group.
    """
    sample = classes.orderBy("h1", "h2").limit(SAMPLED * count).select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = [r["v"] for r in sample.collect()]
    if not rows:
        return np.zeros((0, 1))
    units = unit(np.array(rows))
    free, chosen = np.ones(len(units), bool), []
    while free.any() and len(chosen) < count:
        at = int(np.argmax(free))
        chosen.append(at)
        free &= units @ units[at] < APART
        free[at] = False
    return units[chosen]


def described(classes: DataFrame, points: np.ndarray) -> DataFrame:
    """Classes with ``prefix``: the numbers of their nearest pivots, nearest first."""
    shared = classes.sparkSession.sparkContext.broadcast(points)  # at most MAX_PIVOTS vectors
    size = min(PREFIX, len(points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = unit(matrix(batch.column("embedding").cast(pa.list_(pa.float64())))) @ shared.value.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :size].astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, size, dtype=np.int32)), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, prefix], names=[*batch.schema.names, "prefix"])

    kind = classes.schema["embedding"].dataType.simpleString()
    slim = classes.select("cid", "weight", "embedding")
    return slim.mapInArrow(run, f"cid bigint, weight bigint, embedding {kind}, prefix array<int>")


def list_rows(index: DataFrame) -> DataFrame:
    """Rows of the inverted lists: ``held`` = 1 in the vector's own block, 0 where it streams past."""
    listed = index.withColumn("pivot", F.explode("prefix"))
    sizes = listed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("pivot", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    blocked = listed.join(F.broadcast(sizes), "pivot").withColumn("own", own)  # at most MAX_PIVOTS lists
    return blocked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own")))).select(
        "pivot", "block", (F.col("block") == F.col("own")).cast("int").alias("held"), "cid", "weight", "prefix", "embedding"
    )


class _Part:
    """Vectors of one list or block."""

    def __init__(self, cid: np.ndarray, weight: np.ndarray, prefix: np.ndarray, units: np.ndarray):
        self.cid, self.weight, self.prefix, self.units = cid, weight, prefix, units

    def rows(self, some) -> _Part:
        return _Part(self.cid[some], self.weight[some], self.prefix[some], self.units[some])

    def joined(self, other: _Part | None) -> _Part:
        if other is None:
            return self
        return _Part(*[np.concatenate(p) for p in zip((other.cid, other.weight, other.prefix, other.units), (self.cid, self.weight, self.prefix, self.units))])


def _reported(a: _Part, b: _Part, pivot: int, threshold: float, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) whose cosine reaches the threshold and that this list reports."""
    for at in range(0, len(a.cid), 1024):
        near = a.units[at : at + 1024] @ b.units.T >= threshold
        i, j = np.nonzero(near)
        i = i + at
        if within:
            i, j = i[i < j], j[i < j]
        for h in range(0, len(i), _HITS):
            x, y = i[h : h + _HITS], j[h : h + _HITS]
            shared = (a.prefix[x][:, :, None] == b.prefix[y][:, None, :]).any(axis=2)
            least = np.where(shared, a.prefix[x], MAX_PIVOTS).min(axis=1)
            ours = least == pivot
            yield x[ours], y[ours]


def _found(a: _Part, b: _Part, pivot: int, threshold: float, within: bool) -> Iterator[pa.RecordBatch]:
    counts_a, counts_b = np.zeros(len(a.cid), np.int64), np.zeros(len(b.cid), np.int64)
    tree_a, tree_b = [], []
    for x, y in _reported(a, b, pivot, threshold, within):
        if not len(x):
            continue
        np.add.at(counts_a, x, b.weight[y])
        np.add.at(counts_b, y, a.weight[x])
        u, v = forest(a.cid[x], b.cid[y])
        tree_a.append(u)
        tree_b.append(v)
    if not tree_a:
        return
    u, v = forest(np.concatenate(tree_a), np.concatenate(tree_b))
    p, q = np.flatnonzero(counts_a), np.flatnonzero(counts_b)
    ids = np.concatenate([u, a.cid[p], b.cid[q]])
    to = np.concatenate([v, np.full(len(p) + len(q), -1)])
    links = np.concatenate([np.zeros(len(u), np.int64), counts_a[p], counts_b[q]])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(to), pa.array(links)], names=["a", "b", "n"])


def list_links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n): forest links a-b (n = 0), and links of class a reported by a list (b = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None  # the current block's rows, at most about BLOCK of them
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot, block, holds = (batch.column(c).to_numpy() for c in ("pivot", "block", "held"))
            part = _Part(
                batch.column("cid").to_numpy(), batch.column("weight").to_numpy(),
                matrix(batch.column("prefix")), unit(matrix(batch.column("embedding").cast(pa.list_(pa.float64())))),
            )
            cuts = np.flatnonzero((pivot[1:] != pivot[:-1]) | (block[1:] != block[:-1]) | (holds[1:] != holds[:-1])) + 1
            for at, to in zip([0, *cuts], [*cuts, len(pivot)]):
                some = part.rows(slice(at, to))
                if key != (pivot[at], block[at]):
                    key, held = (pivot[at], block[at]), None
                if holds[at]:
                    yield from _found(some, some, pivot[at], threshold, True)
                    if held is not None:
                        yield from _found(held, some, pivot[at], threshold, False)
                    held = some.joined(held)
                elif held is not None:
                    yield from _found(held, some, pivot[at], threshold, False)

    met = rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block", F.desc("held"))
    return met.mapInArrow(run, "a bigint, b bigint, n bigint")


def linked_vectors(ids: DataFrame, length: int, threshold: float) -> DataFrame:
    """(vec_id, n_links, component_id) of the usable rows of one length."""
    rows, classes = equal_vectors(ids, length)
    n = classes.count()
    index = staged(described(classes, pivots(classes, number_of_pivots(n))), "pivot-index")
    found = staged(list_links(list_rows(index), threshold), "pivot-links")
    links = found.filter("b < 0").groupBy("a").agg(F.sum("n").alias("links"))
    parts = components(found.filter("b >= 0").select("a", "b"))
    rooted = classes.select("cid", "h1", "h2", "least", "weight").join(links.withColumnRenamed("a", "cid"), "cid", "left")
    rooted = rooted.join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    rooted = staged(rooted.withColumn("root", F.coalesce("component", "cid")).drop("component"), "pivot-roots")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n"))
    named = join_hot(rooted, staged(firsts, "pivot-firsts"), ["root"], "n", n)
    named = staged(
        named.select("h1", "h2", "weight", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "pivot-named"
    )
    linked = join_hot(rows.select("vec_id", "h1", "h2"), named, ["h1", "h2"], "weight", rows.count())
    component = F.when(F.col("first") < NO_ID, F.col("first"))
    return linked.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), component.alias("component_id"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    ids = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), id_order("vec_id").alias("__d"), "embedding")
    every = ids.filter(~usable()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    for length in lengths(ids.filter(usable())):
        every = every.unionByName(linked_vectors(ids, length, threshold))
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
