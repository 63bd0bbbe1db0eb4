"""SimHash near-duplicates found by the generalised pigeonhole principle.

A document's fingerprint has a bit set if more than half of its word shingles'
XXH64 values have it.  Equal fingerprints are merged first.  To find all pairs
within ``distance`` bits, the 64 bits are divided into ``m`` parts, correlated
bits together.  Each fingerprint gives every part its own radius r_i >= -1 (-1
skips the part) with sum r_i = distance - m + 1: a fingerprint within
``distance`` must then lie within r_i in at least one part, so no pair is lost.
The radii are chosen by dynamic programming over the rows they would probe and
compare, estimated from a histogram of part values; values shared by many are
skipped where rarer parts can take over.  Probes meet the index by part value
and are verified on all 64 bits.

A bucket is compared in blocks of at most ``BLOCK`` index rows, each with all
probes streaming past it; of the pairs found only a spanning forest is emitted,
so output never grows with the square of a group.  The driver sees the 64 x 64
bit correlations and at most ``m`` x 65,536 histogram counts.

Defined cases: a text without words (missing, empty) has fingerprint zero, which
links like any other; fewer than three words are one shingle; repeated rows
have equal fingerprints; rows without an id sort after all ids, and a group
without any id has no component id; an empty table gives no rows.  Only doc_id
and text are read; ``one_per_group`` passes all columns through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.functions.arrays import ROWS, added_up, row_sums
from clonelens.llm.common import NO_ID, id_order, join_hot, packed_row, small_batches, table, whole_text
from clonelens.llm.components import components
from clonelens.session import staged

BITS = 64
SHINGLE = 3
HASH_SEED = 42
DISTANCE = 3
BLOCK = 8192  # index rows of one bucket that a task holds at once
_PREFIX = 16  # part bits the histogram tells apart
_MAX_RADIUS = 2
_ROW_COST = 100.0  # a shuffled probe row costs as much as so many comparisons
_PAIRS = 1 << 21  # pairs compared in one numpy step
_SLICE = 1 << 16  # shingles hashed in one numpy step


def fingerprint(data: bytes | None) -> int:
    """The 64-bit fingerprint, as a signed number, of a text's UTF-8 bytes."""
    words = (data or b"").lower().split()  # bytes: A-Z only, ASCII blanks only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return int(np.uint64(digest(b" ".join(words), HASH_SEED)).view(np.int64))
    total = len(words) - SHINGLE + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, _SLICE):
        some = words[at : at + _SLICE + SHINGLE - 1]
        shingles = zip(*[some[i:] for i in range(SHINGLE)])
        hashes = np.array([digest(b" ".join(s), HASH_SEED) for s in shingles], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(__d, __t, fp): ordered id, text hash and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            prints = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("__d"), batch.column("__t"), prints], names=["__d", "__t", "fp"])

    small_batches(docs.sparkSession)
    slim = docs.select(id_order("doc_id").alias("__d"), F.xxhash64(whole_text()).alias("__t"), whole_text().alias("text"))
    return slim.mapInArrow(run, "__d bigint, __t bigint, fp bigint")


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(prints: np.ndarray, part: list[int]) -> np.ndarray:
    """The part's bits as one number; the first listed bit is the lowest."""
    out = np.zeros(len(prints), np.int64)
    for place, bit in enumerate(part):
        out |= ((prints >> np.int64(bit)) & np.int64(1)) << np.int64(place)
    return out


def bit_correlations(classes: DataFrame) -> np.ndarray:
    """|correlation| of the bits over all distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS))
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy()).astype(np.float32)
            total[:BITS] += bits.T @ bits
            total[BITS] += len(bits)
        yield row_sums(total)

    sums = added_up(classes.select("fp").mapInArrow(run, ROWS), BITS + 1, BITS)
    n = max(sums[BITS, 0], 1.0)
    share = np.diag(sums[:BITS]) / n
    both = sums[:BITS] / n - np.outer(share, share)
    spread = np.sqrt(np.outer(share * (1 - share), share * (1 - share)))
    out = np.abs(np.divide(both, spread, out=np.zeros_like(both), where=spread > 0))
    np.fill_diagonal(out, 0.0)
    return out


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width, each grown around its most correlated pair."""
    free, out = list(range(BITS)), []
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        inside = correlation[np.ix_(free, free)]
        group = [free[int(np.argmax(inside.max(axis=1)))]]
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(rest[int(np.argmax(correlation[np.ix_(rest, group)].mean(axis=1)))])
        free = [b for b in free if b not in group]
        out.append(sorted(group))
    return out


def number_of_parts(n: int, distance: int) -> int:
    """The part count whose probes and comparisons cost least for ``n`` evenly spread fingerprints."""

    def cost(m: int) -> float:
        width = BITS // m
        radii = [(distance + 1) // m - 1 + (i < (distance + 1) % m) for i in range(m)]
        probes = sum(_ball_size(width, r) for r in radii)
        return probes * (_ROW_COST + n / 2.0**width)

    most = distance + 1
    return min(range(max(2, math.ceil(most / (_MAX_RADIUS + 1))), most + 1), key=cost)


def _ball_size(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def _ball(width: int, radius: int) -> np.ndarray:
    flips = [0]
    for r in range(1, radius + 1):
        flips += [sum(1 << b for b in some) for some in combinations(range(width), r)]
    return np.array(flips, np.int64)


def value_counts(classes: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each (part, value), values cut to ``_PREFIX`` bits."""
    shifts = [max(0, len(p) - _PREFIX) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(parts), 1 << _PREFIX), np.int64)
        for batch in batches:
            prints = batch.column("fp").to_numpy()
            for i, part in enumerate(parts):
                counts[i] += np.bincount(_values(prints, part) >> shifts[i], minlength=1 << _PREFIX)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["at", "n"])

    summed = classes.select("fp").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    found = summed.toArrow()  # at most parts x 65,536 rows
    out = np.zeros(len(parts) << _PREFIX)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(len(parts), -1)


def _ball_counts(counts: np.ndarray, width: int) -> np.ndarray:
    """(radius + 1, value): estimated fingerprints within radius 0, 1, 2 of a value."""
    seen, hidden = min(width, _PREFIX), max(0, width - _PREFIX)
    at = np.arange(len(counts))
    one = sum(counts[at ^ (1 << b)] for b in range(seen))
    two = (sum(one[at ^ (1 << b)] for b in range(seen)) - seen * counts) / 2
    near = [counts, one + hidden * counts, two + hidden * one + math.comb(hidden, 2) * counts]
    return np.cumsum(near, axis=0) / 2.0**hidden


def radii(prints: np.ndarray, parts: list[list[int]], balls: list[np.ndarray], distance: int) -> np.ndarray:
    """(n, parts): each fingerprint's cheapest radii, -1 for a skipped part.

    Dynamic programming over the parts: radius + 1 is spent from a budget of
    ``distance`` + 1.
    """
    budget, n = distance + 1, len(prints)
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0.0
    spent = []
    for part, ball in zip(parts, balls):
        prefix = _values(prints, part) >> max(0, len(part) - _PREFIX)
        step = np.full((n, budget + 1), np.inf)
        choice = np.zeros((n, budget + 1), np.int8)
        for s in range(min(budget, _MAX_RADIUS + 1) + 1):
            cost = 0.0 if s == 0 else _ROW_COST * _ball_size(len(part), s - 1) + ball[s - 1][prefix][:, None]
            reached = best[:, : budget + 1 - s] + cost
            better = reached < step[:, s:]
            step[:, s:] = np.where(better, reached, step[:, s:])
            choice[:, s:] = np.where(better, s, choice[:, s:])
        best = step
        spent.append(choice)
    out = np.empty((n, len(parts)), np.int64)
    left, rows = np.full(n, budget), np.arange(n)
    for i in reversed(range(len(parts))):
        out[:, i] = spent[i][rows, left]
        left = left - out[:, i]
    return out - 1


_PROBE = "bucket bigint, block int, probe int, fp bigint"


def probes(classes: DataFrame, parts: list[list[int]], counts: np.ndarray, distance: int = DISTANCE) -> DataFrame:
    """Index rows (probe = 0) of every fingerprint in every part, and its probes (1).

    A bucket with more than ``BLOCK`` index rows is split into blocks by hash and
    its probes are repeated for each.
    """
    shared = classes.sparkSession.sparkContext.broadcast(counts)  # at most parts x 65,536 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = shared.value
        balls = [_ball_counts(c, len(p)) for c, p in zip(counted, parts)]

        def blocks(i: int, values: np.ndarray) -> np.ndarray:
            prefix = values >> max(0, len(parts[i]) - _PREFIX)
            return np.maximum(1, np.ceil(counted[i][prefix] / BLOCK)).astype(np.int64)

        def rows(i: int, values: np.ndarray, block: np.ndarray, probe: int, prints: np.ndarray) -> pa.RecordBatch:
            bucket = (np.int64(i) << np.int64(40)) | values
            columns = [pa.array(bucket), pa.array(block.astype(np.int32)), pa.array(np.full(len(values), probe, np.int32)), pa.array(prints)]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "probe", "fp"])

        for batch in batches:
            every = batch.column("fp").to_numpy()
            for at in range(0, len(every), 4096):
                prints = every[at : at + 4096]
                chosen = radii(prints, parts, balls, distance)
                for i, part in enumerate(parts):
                    values = _values(prints, part)
                    mixed = (prints.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    yield rows(i, values, mixed.astype(np.int64) % blocks(i, values), 0, prints)
                    for radius in range(_MAX_RADIUS + 1):
                        who = np.flatnonzero(chosen[:, i] == radius)
                        if not len(who):
                            continue
                        ball = _ball(len(part), radius)
                        near = (values[who][:, None] ^ ball[None, :]).ravel()
                        asking = np.repeat(prints[who], len(ball))
                        copies = blocks(i, near)
                        starts = np.repeat(np.cumsum(copies) - copies, copies)
                        block = np.arange(copies.sum()) - starts
                        yield rows(i, np.repeat(near, copies), block, 1, np.repeat(asking, copies))

    return classes.select("fp").mapInArrow(run, _PROBE)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of an edge list, without the smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lower = label.copy()
        np.minimum.at(lower, x, label[y])
        np.minimum.at(lower, y, label[x])
        lower = lower[lower]
        if np.array_equal(lower, label):
            break
        label = lower
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _close(prints: np.ndarray, asking: np.ndarray, first: np.ndarray, length: np.ndarray, distance: int):
    """Forest edges among probes and the index rows ``first`` .. ``first + length`` of each."""
    ends = np.cumsum(length)
    at = 0
    while at < len(asking):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _PAIRS, side="right")))
        some = length[at:to]
        probe = np.repeat(np.arange(at, to), some)
        place = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        x, q = prints[first[probe] + place], prints[asking[probe]]
        apart = np.bitwise_count((x ^ q).view(np.uint64))
        hit = np.flatnonzero((apart <= distance) & (apart > 0))
        if len(hit):
            yield forest(q[hit], x[hit])
        at = to


def verified_links(asked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): a forest of the links that the probes find; rows of a bucket meet sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last bucket's index rows, at most a block
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            bucket, block, probe, prints = columns
            new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(np.concatenate([starts, [len(bucket)]]))
            indexed = np.add.reduceat(1 - probe, starts)
            group = np.repeat(np.arange(len(starts)), sizes)
            asking = np.flatnonzero(probe)
            for a, b in _close(prints, asking, starts[group[asking]], indexed[group[asking]], distance):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            last = slice(starts[-1], starts[-1] + indexed[-1])
            held = [c[last].copy() for c in columns]

    met = asked.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "probe")
    return met.mapInArrow(run, "a bigint, b bigint")


def classes_of(prints: DataFrame) -> DataFrame:
    """(fp, least, n): the smallest (__d, __t) and the number of the rows of each fp."""
    return prints.groupBy("fp").agg(F.min(F.struct("__d", "__t")).alias("least"), F.count(F.lit(1)).alias("n"))


def named_rows(prints: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """``prints`` with ``first``, the smallest (__d, __t) of the component that ``found`` gives its fp."""
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", "n", F.coalesce("component", "fp").alias("root")
    )
    rooted = staged(rooted, "simhash-roots")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = rooted.select("fp", "n", "root").withColumnRenamed("n", "rows")
    named = join_hot(rows, staged(firsts, "simhash-firsts"), ["root"], "n", classes.count())
    named = staged(named.select("fp", "rows", "first"), "simhash-named")
    return join_hot(prints, named, ["fp"], "rows", prints.count())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(__d, __t, fp, first) per row: ``first`` is the (__d, __t) that stands for its component."""
    prints = staged(fingerprints(docs), "simhash")
    classes = staged(classes_of(prints), "simhash-classes")
    parts = grouped_bits(bit_correlations(classes), number_of_parts(classes.count(), distance))
    counts = value_counts(classes, parts)
    return named_rows(prints, classes, components(verified_links(probes(classes, parts, counts, distance), distance)))


def _id(order: Column) -> Column:
    return F.when(order < NO_ID, order)


def one_per_group(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents that stand for their component: the smallest id, one row of it."""
    return first_rows(docs, near_duplicates(docs, distance))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each document that ``found`` names as the first of its component."""
    kept = found.filter((F.col("first.__d") == F.col("__d")) & (F.col("first.__t") == F.col("__t")))
    kept = staged(kept.groupBy("__d", "__t").agg(F.count(F.lit(1)).alias("__n")), "simhash-kept")
    rows = docs.select(packed_row(docs), id_order("doc_id").alias("__d"), F.xxhash64(whole_text()).alias("__t"))
    met = rows.join(kept, ["__d", "__t"])
    repeated = met.filter("__n > 1").dropDuplicates(["__d", "__t"])
    return met.filter("__n = 1").unionByName(repeated).select("__row.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component within three differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        _id(F.col("__d")).alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        _id(F.col("first.__d")).alias("component_id"),
    )
