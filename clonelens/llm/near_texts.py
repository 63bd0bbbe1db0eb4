"""Near copies of texts: every pair whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

First come the pairs that SimHash finds: a set's fingerprint has the bits set that more
than half of its members have, the pigeonhole search of ``simhash`` over the fingerprints of
all classes finds those within three bits, and exact similarity decides which of these pairs
are links.  At similarity 0.8 fingerprints differ in about ten bits, so this search alone
would lose links, as would the forest that it gives of a bucket's pairs.  A second search
completes it:
the shingles stand in one global order, rare ones first.  If two sets reach the
similarity, the first fifth of each (its prefix) shares a shingle, so pairs that
meet in a prefix shingle are all there can be; the best overlap their sizes and
places allow drops most of them, exact similarity decides the rest.  No pair is lost.

Any order gives the same pairs.  It comes from ``SKETCH`` counters of shingle
hashes, so common passages end up outside the prefixes.

Texts with equal sets are one class.  What the fingerprints linked is one component
already; shingles that several classes have in their
prefix are first met by a leader each, for a few rounds, so that a large group of near
copies becomes one component without its pairs; then all pairs that still
lie in different components are compared, in blocks of at most ``BLOCK`` rows.
Rounds end when little is left to compare or when leaders no longer help, as in groups whose
members are near their centre only.  A pair leaves its block if sizes, places and a bitmap allow
the similarity: each set has ``BITS`` parities of its members, two sets differ in at least as many
members as their bitmaps in bits.  So what is sent on is about the pairs that are similar; only
comparisons inside a block grow with the square of a shingle's count.

Defined cases: words are split and lowered as in ``simhash``; fewer than five
words are one shingle; texts without words have the empty set and are one class.
Shingles are told apart by 64-bit hashes, in the last comparison of sets of at most
``SHORT`` members by half of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.llm import simhash
from clonelens.llm.common import id_order, join_hot, small_batches, whole_text
from clonelens.llm.components import components
from clonelens.session import staged, unstaged

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5  # the least similarity
SKETCH = 18  # bits of a shingle's counter
BLOCK = 2048
BITS = 1024  # parities per set
ROUNDS = 5  # rounds of leaders before all open pairs are compared
FEW = 32  # comparisons per row that need no further round
HELPED = 0.8  # a round must leave less than this share of the comparisons, or the rounds end
SHORT = 4096  # members of a set that is compared by 32-bit hashes
SALTS = 256  # tasks that a leader's pairs can be spread over
_SLICE = 1 << 16  # members whose bits are counted in one step
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: bytes | None) -> np.ndarray:
    """The sorted distinct hashes, as signed numbers, of a text's word shingles."""
    words = (data or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    total = len(words) - width + 1
    out = np.full(total, width, np.uint64)
    for i in range(width):
        out = ((out ^ (out >> np.uint64(29))) * _MIX) + hashes[i : i + total]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique((out ^ (out >> np.uint64(29))).view(np.int64))


def class_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def fingerprint(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set, as a signed number: the bits that more than half of its members have."""
    ones = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(found), _SLICE):
        ones += np.unpackbits(found[at : at + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def packed(found: np.ndarray) -> bytes:
    """A set as bytes: 32 bits per member up to ``SHORT`` members, else 64; the last byte tells which."""
    if len(found) > SHORT:
        return found.tobytes() + b"8"
    return _short(found).tobytes() + b"4"


def _short(found: np.ndarray) -> np.ndarray:
    return np.sort((found.view(np.uint64) >> np.uint64(32)).astype(np.uint32))


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64 if data.endswith(b"8") else np.uint32, (len(data) - 1) // int(data[-1:]))


def parities(found: np.ndarray) -> bytes:
    """One bit per value of a member's upper bits: whether an odd number of members has it."""
    at = (found.view(np.uint64) >> np.uint64(65 - BITS.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1).tobytes()


def unlike(bits: np.ndarray, other: np.ndarray, a, b) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` differ in more bits than similar ones differ in members."""
    return np.bitwise_count(bits ^ other).sum(axis=1, dtype=np.int64) * (NUMERATOR + DENOMINATOR) > (a + b) * (DENOMINATOR - NUMERATOR)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two unpacked sets."""
    if not len(a):
        return 0
    if a.dtype != b.dtype:
        a, b = (_short(x) if x.dtype == np.int64 else x for x in (a, b))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def similar(overlap, a, b):
    """Whether sets of sizes ``a`` and ``b`` with so many common members reach the similarity."""
    return overlap * (NUMERATOR + DENOMINATOR) >= (a + b) * NUMERATOR


def prefix_length(size: int) -> int:
    return size - -(-size * NUMERATOR // DENOMINATOR) + 1


def _slim(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(id_order("doc_id").alias("__d"), F.xxhash64(whole_text()).alias("__t"), whole_text().alias("text"))


def set_classes(docs: DataFrame) -> DataFrame:
    """(__d, __t, fp, print): ordered id, text hash, class and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = [shingles(t.as_py()) for t in texts]
            classes, prints = (pa.array([of(s) for s in found], pa.int64()) for of in (class_of, fingerprint))
            columns = [batch.column("__d"), batch.column("__t"), classes, prints]
            yield pa.RecordBatch.from_arrays(columns, names=["__d", "__t", "fp", "print"])

    return _slim(docs).mapInArrow(run, "__d bigint, __t bigint, fp bigint, print bigint")


def _new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Classes and sets of a task's rows, each class once."""
    seen: set[int] = set()
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()):
            found = shingles(text.as_py())
            fp = class_of(found)
            if len(found) and fp not in seen:
                seen.add(fp)
                yield fp, found


def _counter(found: np.ndarray, counters: int) -> np.ndarray:
    return (found.view(np.uint64) >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def sketch(docs: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each counter; copies in one task count once."""
    counters = 1 << SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.int64)
        for _, found in _new_sets(batches):
            np.add.at(counts, _counter(found, counters), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    found = _slim(docs).select("text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(counters, np.int64)  # at most 262,144 rows
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


_MEMBER = "token bigint, part int, cid bigint, size int, place int"


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """The prefix shingles of every class; ``part`` deals a common one's rows out, -1 if it is not common."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 2 MB
    names = [c.split()[0] for c in _MEMBER.split(", ")]
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = shared.value
        usual = counted.mean()

        def rows(some: list[tuple]) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*some)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        held, many = [], 0
        for fp, found in _new_sets(batches):
            often = counted[_counter(found, len(counted))]
            first = np.lexsort((found, often))[: prefix_length(len(found))]
            parts = np.ceil((often[first] - usual) / most).astype(np.int64)
            part = np.where(parts > 1, fp % np.maximum(parts, 1), -1).astype(np.int32)
            n = len(first)
            held.append((found[first], part, np.full(n, fp), np.full(n, len(found), np.int32), np.arange(n, dtype=np.int32)))
            many += n
            if many >= 1 << 16:
                yield rows(held)
                held, many = [], 0
        if held:
            yield rows(held)

    return _slim(docs).select("text").mapInArrow(run, _MEMBER)


def met(listed: DataFrame) -> DataFrame:
    """The rows of shingles that more than one class has in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = None, None  # the last shingle's rows, without repeated classes

        def out(columns: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
            token, part, cid = columns[:3]
            same = (token[1:] == token[:-1]) & (part[1:] == part[:-1])
            new = np.concatenate([[True], ~(same & (cid[1:] == cid[:-1]))])
            columns = [c[new] for c in columns]
            token, part = columns[:2]
            starts = np.concatenate([[0], np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1])
            sizes = np.diff(np.concatenate([starts, [len(token)]]))
            shared = np.repeat(sizes > 1, sizes) | (part >= 0)
            end = len(token) if last else starts[-1]
            return [c[:end][shared[:end]] for c in columns], [c[end:] for c in columns]

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            done, held = out(columns, False)
            if len(done[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in done], names=names)
        if held is not None:
            done, _ = out(held, True)
            if len(done[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in done], names=names)

    dealt = listed.repartition("token", "part").sortWithinPartitions("token", "part", "cid")
    return dealt.mapInArrow(run, _MEMBER).drop("part")


def needed_sets(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(cid, set, bits) of all classes that ``members`` names by ``cid``; the set packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, bits = [], []
            for text in batch.column("text").cast(pa.binary()):
                found = shingles(text.as_py())
                sets.append(packed(found))
                bits.append(parities(found))
            columns = [batch.column("cid"), pa.array(sets, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "set", "bits"])

    wanted = members.select(F.col("cid").alias("fp")).distinct().join(classes, "fp")
    wanted = wanted.select(F.col("fp").alias("cid"), F.col("least.__d").alias("__d"), F.col("least.__t").alias("__t"))
    # repeated rows of an id and text lie together after this join, so that they are dropped without moving sets
    texts = _slim(docs).join(wanted, ["__d", "__t"]).dropDuplicates(["__d", "__t", "cid"]).select("cid", "text")
    return texts.mapInArrow(run, "cid bigint, set binary, bits binary")


def _reachable(size: Column, place: Column, other: Column, at: Column) -> Column:
    """Whether two sets can be similar if this is the first shingle they share."""
    return similar(F.least(size - place, other - at), size, other)


def open_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components that meet in a shingle and can be similar."""

    def pairs(x: list[np.ndarray], y: list[np.ndarray], within: bool) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(x[0]), 128):
            _, size, place, comp = (c[at : at + 128, None] for c in x[:4])
            best = np.minimum(size - place, y[1] - y[2])
            i, j = np.nonzero((comp != y[3]) & similar(best, size, y[1]))
            if within:
                i, j = i[i + at < j], j[i + at < j]
            good = ~unlike(x[4][i + at], y[4][j], x[1][i + at], y[1][j])
            i, j = i[good], j[good]
            if len(i):
                ends = np.stack([x[0][i + at], y[0][j]])
                yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=0)), pa.array(ends.max(axis=0))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None  # the current block's rows, about BLOCK of them
        for batch in batches:
            if not batch.num_rows:
                continue
            token, block, holds = (batch.column(c).to_numpy() for c in ("token", "block", "held"))
            whole = [batch.column(c).to_numpy().astype(np.int64) for c in ("cid", "size", "place", "comp")]
            whole.append(np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(token), -1))
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1]) | (holds[1:] != holds[:-1])) + 1
            for at, to in zip([0, *cuts], [*cuts, len(token)]):
                some = [c[at:to] for c in whole]
                if key != (token[at], block[at]):
                    key, held = (token[at], block[at]), None
                if holds[at]:
                    yield from pairs(some, some, True)
                if held is not None:
                    yield from pairs(held, some, False)
                if holds[at]:
                    held = some if held is None else [np.concatenate(pair) for pair in zip(held, some)]

    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    dealt = rows.join(sets.select("cid", "bits"), "cid").withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own"))))
    dealt = dealt.select("token", "block", (F.col("block") == F.col("own")).cast("int").alias("held"), "cid", "size", "place", "comp", "bits")
    dealt = dealt.repartition("token", "block").sortWithinPartitions("token", "block", F.desc("held"))
    return dealt.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; ``b`` may be in many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, np.zeros(0, np.int64)
        for batch in batches:
            a, b = [], []
            asks, hubs = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for x, hub, found in zip(asks, hubs, batch.column("set")):
                one = unpacked(found.as_py())
                if x is None:
                    key, head = hub, one
                    continue
                assert key == hub
                if similar(overlap(head, one), len(head), len(one)):
                    a.append(x)
                    b.append(hub)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    asked = staged(pairs.distinct().withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")), "near-pairs")
    sets = sets.select("cid", "set")
    asks = asked.join(sets.withColumnRenamed("cid", "a"), "a").select("b", "salt", "a", "set")
    heads = asked.select("b", "salt").distinct().join(sets.withColumnRenamed("cid", "b"), "b")
    heads = heads.select("b", "salt", F.lit(None).cast("bigint").alias("a"), "set")
    both = heads.unionByName(asks).repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    return both.mapInArrow(run, "a bigint, b bigint")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): classes whose fingerprints the search finds close; ``prints`` is (fp, print) of every class."""
    held = staged(prints.select(F.col("fp").alias("cid"), "print"), "near-prints")
    firsts = held.groupBy("print").agg(F.min("cid").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = staged(firsts, "near-print-firsts")
    distinct = firsts.select(F.col("print").alias("fp"))
    parts = simhash.grouped_bits(simhash.bit_correlations(distinct), simhash.number_of_parts(distinct.count(), simhash.DISTANCE))
    asked = simhash.probes(distinct, parts, simhash.value_counts(distinct, parts))
    near = simhash.verified_links(asked).distinct()
    for end in ("a", "b"):
        near = near.join(firsts.select(F.col("print").alias(end), F.col("first").alias(f"{end}_cid")), end)
    near = near.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"))
    equal = join_hot(held, firsts, ["print"], "n", held.count()).filter("cid <> first")
    return staged(near.unionByName(equal.select(F.col("cid").alias("a"), F.col("first").alias("b"))), "near-close")


def fingerprint_links(close: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): those of the ``close`` pairs whose sets are similar; ``sets`` holds both of each."""
    return staged(verified(close, sets), "near-first")


def links(members: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) of all classes that a similar one exists for; ``found`` (a, b) are links known before."""
    still, before = None, math.inf
    parts = components(found)
    for turn in range(ROUNDS + 1):
        state = members.join(parts.withColumnRenamed("node", "cid"), "cid", "left")
        state = staged(state.withColumn("comp", F.coalesce("component", "cid")).drop("component"), "near-state")
        if still is not None:
            unstaged(still)
        leader = F.min(F.struct(F.xxhash64(F.lit(turn), "cid").alias("h"), "cid", "size", "place", "comp"))
        tokens = state.groupBy("token").agg(
            leader.alias("first"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")
        )
        tokens = staged(tokens.filter("low <> high").select("token", "first", "n", F.col("n").alias("m")), "near-tokens")
        work = tokens.agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).first()
        if not work["rows"]:
            break
        still = staged(join_hot(state, tokens, ["token"], "n", state.count()), "near-open")
        unstaged(state, tokens)
        last = turn == ROUNDS or work["pairs"] <= FEW * work["rows"] or work["pairs"] > HELPED * before
        before = work["pairs"]
        if last:
            pairs = open_pairs(still, sets)
        else:
            near = _reachable(F.col("size"), F.col("place"), F.col("first.size"), F.col("first.place"))
            pairs = still.filter((F.col("comp") != F.col("first.comp")) & near).select(F.col("cid").alias("a"), F.col("first.cid").alias("b"))
        found = staged(found.unionByName(verified(pairs, sets)), "near-links")
        parts = components(found)
        if last:
            break
        members = still.select("token", "cid", "size", "place")
    return parts


def near_texts(docs: DataFrame) -> DataFrame:
    """(__d, __t, fp, first) per row: ``first`` is the (__d, __t) that stands for its component."""
    rows = staged(set_classes(docs), "near-rows")
    classes = staged(simhash.classes_of(rows), "near-classes")
    members = staged(met(prefixes(docs, sketch(docs))), "near-members")
    close = fingerprint_pairs(rows.select("fp", "print").distinct())  # a class has one fingerprint
    compared = members.select("cid").unionByName(close.select(F.explode(F.array("a", "b")).alias("cid")))
    sets = staged(needed_sets(docs, classes, compared), "near-sets")
    return simhash.named_rows(rows.drop("print"), classes, links(members, sets, fingerprint_links(close, sets)))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents that stand for their component: the smallest id, one row of it."""
    return simhash.first_rows(docs, near_texts(docs))
