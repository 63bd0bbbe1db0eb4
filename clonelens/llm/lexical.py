"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, no random access.

Documents are counted once for all items of a query block: per document its
length and the query terms it holds.  Spark adds up the corpus statistics over
all documents.  The index is partitioned by document: a task cuts its rows into
blocks of at most ``BLOCK`` documents and sorts, per term, the block's postings by
falling impact.  An item reads the lists of its terms in step.  Every document of
the block has a lower score (what was read of it) and an upper one (plus the next
impact of each list it was not met in).  Documents whose upper score is below
the k-th best lower score leave; reading goes on until every one that is left,
ties with the k-th included, has equal bounds.  A task carries each item's k best
from block to block, so later blocks stop early, and hands on k rows per item;
these are ranked in two steps, by salt first.

Items are worked on in blocks of about ``QUERY_BYTES`` of text, whose terms and
weights are the only data broadcast.  Documents are never collected or moved.

Defined cases: a missing or empty text has no terms and no rank; items without
terms or without a scoring document give no rows; equal (id, text) items are one
item, equal ids with different texts are ranked apart; every document row is a
document of its own, also if ids repeat; equal scores go to the smaller
id, missing ids last; empty tables give no rows; other columns are not read.  Very
long texts are split slice by slice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonelens.llm.common import NO_ID, id_order, small_batches, table
from clonelens.session import staged, spread

TOP = 10
BLOCK, BLOCK_POSTINGS = 8192, 1 << 22
QUERY_BYTES = 1 << 23
FIRST_STEP = 256  # postings of each list in the first read; doubles with every read
SALTS = 64
_SLICE = 1 << 22  # bytes of a text split at a time
_UNIT = 1_000_000_000
# ASCII letters in lower case, digits and all bytes beyond ASCII; everything else separates terms.
_FOLDED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(
    bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
)


def split_terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice; slices end between terms."""
    rest = b""
    for at in range(0, len(data), _SLICE):
        piece = rest + data[at : at + _SLICE].translate(_FOLDED)
        cut = len(piece) if at + _SLICE >= len(data) else piece.rfind(b" ") + 1
        rest = piece[cut:]
        yield piece[:cut].split()


@dataclass
class Queries:
    """A block of items: ids and, per item, (term number, occurrences)."""

    ids: list[int | None]
    terms: dict[bytes, int]
    items: list[list[tuple[int, int]]]


def parsed(rows: list) -> Queries:
    terms: dict[bytes, int] = {}
    items = []
    for row in rows:
        counts = Counter(t for part in split_terms((row["text"] or "").encode()) for t in part)
        items.append([(terms.setdefault(t, len(terms)), n) for t, n in counts.items()])
    return Queries([r["item_id"] for r in rows], terms, items)


_INDEX = "d bigint, n bigint, terms array<int>, tf array<bigint>"


def counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(d, n, terms, tf): ordered id, length and counted query terms of every row of (doc_id, text)."""
    known = docs.sparkSession.sparkContext.broadcast(terms)  # of one query block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            lengths, found, times, ends = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()):
                n, counts = 0, Counter()
                for words in split_terms(text.as_py() or b""):
                    n += len(words)
                    counts.update(filter(numbers.__contains__, words))
                lengths.append(n)
                found.extend(map(numbers.__getitem__, counts))
                times.extend(counts.values())
                ends.append(len(found))
            at = pa.array(ends, pa.int32())
            columns = [
                batch.column("d"), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(found, pa.int32())), pa.ListArray.from_arrays(at, pa.array(times, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "n", "terms", "tf"])

    small_batches(docs.sparkSession)
    return spread(docs).select(id_order("doc_id").alias("d"), "text").mapInArrow(run, _INDEX)


def document_frequencies(index: DataFrame, count: int) -> np.ndarray:
    """In how many documents each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(count, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=count)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(count, np.int64)
    if count:
        found = index.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        for row in found.collect():  # one row per term of the query block
            out[row["term"]] = row["df"]
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000.0 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """Impact-sorted lists of one block of documents."""

    def __init__(self, d: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        order = np.lexsort((-impact, term))
        self.d, self.doc, self.impact = d, doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(terms + 1))

    def best(self, item: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of all documents that may be among the k best; ``floor`` is a score to reach.

        ``item`` holds (term, weight of one impact unit).
        """
        open_lists = [(self.start[t], self.start[t + 1], w) for t, w in item if w and self.start[t] < self.start[t + 1]]
        low = np.zeros(len(self.d), np.int64)
        met = np.zeros((len(open_lists), len(self.d)), bool)
        heads = np.array([w * self.impact[a] for a, _, w in open_lists], np.int64)
        places = [a for a, _, _ in open_lists]
        alive = np.arange(len(self.d))
        floor, step = max(floor, 1), FIRST_STEP
        if not len(open_lists) or heads.sum() < floor:
            return alive[:0], low[:0]
        while True:
            for i, (_, end, w) in enumerate(open_lists):
                if heads[i]:
                    at, to = places[i], min(places[i] + step, end)
                    some = self.doc[at:to]
                    low[some] += w * self.impact[at:to]
                    met[i, some] = True
                    places[i], heads[i] = to, w * self.impact[to] if to < end else 0
            step *= 2
            lows = low[alive]
            if len(alive) >= k:
                floor = max(floor, int(np.partition(lows, -k)[-k]))
            unread = heads > 0
            above = lows + heads[unread] @ ~met[np.ix_(unread, alive)] if unread.any() else lows
            kept = above >= floor
            if not kept.any():
                return alive[:0], low[:0]
            alive, settled = alive[kept], bool((above[kept] == lows[kept]).all())
            if settled:
                return alive, low[alive]


def found(index: DataFrame, queries: Queries, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, d, score, part): the k best documents of every task for each item of the block."""
    df = document_frequencies(index, len(queries.terms))
    weights = [weight(n_docs, int(v)) if v else 0 for v in df]
    items = [[(t, n * weights[t]) for t, n in item] for item in queries.items]
    shared = index.sparkSession.sparkContext.broadcast((items, len(weights)))
    lengths = f"cast(n as decimal(19,0)) * cast({75 * n_docs} as decimal(19,0))"
    sized = index.withColumn("m", F.expr(f"25 + ({lengths}) div cast({max(n_terms, 1)} as decimal(19,0))"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, terms = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in wanted]  # ids and scores

        def searched(parts: list[tuple[np.ndarray, ...]]) -> None:
            d, m, sizes, term, tf = (np.concatenate(c) for c in zip(*parts))
            doc = np.repeat(np.arange(len(d)), sizes)
            lists = Lists(d, doc, term, (_UNIT * tf) // (1000 * tf + 8 * m[doc]), terms)
            for i, item in enumerate(wanted):
                ids, scores = best[i]
                places, new = lists.best(item, k, int(scores[-1]) if len(scores) == k else 0)
                if len(places):
                    ids, scores = np.concatenate([ids, d[places]]), np.concatenate([scores, new])
                    first = np.lexsort((ids, -scores))[:k]
                    best[i] = ids[first], scores[first]

        held, rows, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                sizes = some.column("terms").value_lengths().to_numpy()
                held.append((
                    some.column("d").to_numpy(), some.column("m").to_numpy(), sizes,
                    some.column("terms").flatten().to_numpy(), some.column("tf").flatten().to_numpy(),
                ))
                rows, postings = rows + len(sizes), postings + int(sizes.sum())
                if rows >= BLOCK or postings >= BLOCK_POSTINGS:
                    searched(held)
                    held, rows, postings = [], 0, 0
        if held:
            searched(held)
        sizes = [len(ids) for ids, _ in best]
        if sum(sizes):
            part = pa.array(np.full(sum(sizes), TaskContext.get().partitionId(), np.int64))
            at = pa.array(np.repeat(np.arange(len(best)), sizes).astype(np.int32))
            columns = [at, *[pa.array(np.concatenate(c)) for c in zip(*best)], part]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "d", "score", "part"])

    slim = sized.select("d", F.col("m").cast("bigint").alias("m"), "terms", "tf")
    return slim.mapInArrow(run, "item int, d bigint, score bigint, part bigint")


def _ranked(rows: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "d")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) for the items (item_id, text) over the documents (doc_id, text)."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // QUERY_BYTES)
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        queries = parsed(rows.collect())
        index = staged(counted(docs.select("doc_id", "text"), queries.terms), "lexical-index")
        total = index.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        near = found(index, queries, total["docs"], total["terms"] or 0, k)
        best = _ranked(near, k, "item", F.pmod("part", F.lit(SALTS))).drop("rank")
        names = spark.createDataFrame(list(enumerate(queries.ids)), "item int, item_id bigint")
        ranked = _ranked(best, k, "item").join(F.broadcast(names), "item")  # items of one block
        number = F.when(F.col("d") < NO_ID, F.col("d")).alias("doc_id")
        out = out.unionByName(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), number, "score"))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
OP12_SQL = f"""
WITH items AS (
  SELECT item_id, unnest({_TERMS_SQL.format("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS q FROM items GROUP BY item_id, term
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL.format("coalesce(text, '')")} AS terms FROM documents
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
), words AS (
  SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM docs
), postings AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM words
  WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term
), frequencies AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term, n_docs
), impacts AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) AS f FROM postings, totals
), scored AS (
  SELECT a.item_id, i.doc_id, sum(a.q * r.w * i.f)::BIGINT AS score
  FROM asked a JOIN impacts i ON a.term = i.term JOIN frequencies r ON a.term = r.term GROUP BY a.item_id, i.r, i.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
