"""Packing documents into fixed-length token sequences along a space-filling curve.

Each document becomes token ids plus an end id.  Its hashed vector (token counts
in ``_BUCKETS`` buckets, unit length) is projected to ``DIMS`` dimensions; the
place of that point on a Hilbert curve is the sort key, so that similar documents
are neighbours.  Documents are range partitioned by key, their tokens are summed
up along the curve, and the resulting stream is cut every ``capacity`` tokens:
sequences are full, only the very last one is padded.

Tokens are computed once and staged as packed integers; sorting moves one
narrow row per document, and the ids move once, to meet their place.  The
tokenizer's file is read on the driver and sent to the tasks as text.  Words are
tokenized once per task process and remembered (``_CACHED`` words at most, then
the memory starts anew), which gives the same ids because this kind of tokenizer
never joins characters across white space.

Defined cases: a missing or empty text is the end id alone; rows without an id
sort after all ids; repeated rows are packed as often as they occur; an empty
table gives no rows; long documents span as many sequences as they need.  Only
doc_id and text are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonelens.functions.skew import broadcast_if_small
from clonelens.llm.common import NO_ID, TEXT_BATCH, id_order, small_batches, table, whole_text
from clonelens.session import staged

CAPACITY = 4096
END_ID = 2
DIMS = 3
_BITS = 10  # bits of a curve coordinate
_BUCKETS = 1024
_SEED = 6
_CACHED = 1_000_000
_TOGETHER = 2048  # new words tokenized in one call
_SIGNS = r"([!-&(-/:-@\[-`{-~]*)"  # no apostrophe, which may begin a word of its own
_LETTERS = re.compile(f"([a-z]*){_SIGNS}".encode())
# Latin letters that are composed already and have one lower-case letter (the dotted capital i has two)
_LATIN = re.compile(f"([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*){_SIGNS}")
# the letters that stand for the bytes of UTF-8 beyond ASCII in such vocabularies
_AS_LETTERS = {b: 0x100 + (67 if b == 0xAD else b - 94) for b in (*range(0x80, 0xA1), 0xAD)}


class WordTokenizer:
    """Ids of whole texts from a word-end BPE tokenizer, one library call per batch of new words.

    ``definition`` is the tokenizer's JSON.  Texts are cut at ASCII white space.
    A new word of Latin letters followed by ASCII signs is passed on as its lower-case
    runs, which are what the tokenizer's own splitting yields; runs go through the library
    together, their bytes as letters, without the slow Unicode steps that would not change
    them.  All other words go
    through the whole tokenizer, separated by a digit that they do not hold.  A text
    that holds the name of a special token goes through the library as it is.
    """

    def __init__(self, definition: str, width: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_str(definition)
        self.full.encode_special_tokens = True  # texts with their names do not come here
        self.plain = Tokenizer.from_str(definition)
        self.plain.encode_special_tokens = True
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.exact = WholeTokenizer(definition, width)
        self.special = [t.content.lower() for t in self.full.get_added_tokens_decoder().values()]
        self.width = width
        vocabulary = self.full.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.zero = self.full.encode("0", add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {}

    def _pieces(self, ids: list[int], closes: np.ndarray, words: list[bytes], skip: int = 0) -> dict[bytes, bytes]:
        found = np.array(ids, self.width)
        cuts = np.flatnonzero(closes) + 1
        starts = np.concatenate([[0], cuts[:-1]])
        if len(cuts) != len(words) or cuts[-1] != len(found):
            raise ValueError("the tokenizer does not end words as expected")
        data, size = found.tobytes(), found.itemsize
        return {w: data[a:b] for w, a, b in zip(words, (starts * size).tolist(), ((cuts - skip) * size).tolist())}

    def _runs(self, words: list[bytes]) -> dict[bytes, bytes]:
        text = b" ".join(words).decode("latin-1")
        if not text.isascii():
            text = text.translate(_AS_LETTERS)
        ids = self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self._pieces(ids, self.ends[np.array(ids)], words)

    def _others(self, words: list[bytes]) -> dict[bytes, bytes]:
        ids = self.full.encode_batch_fast([b" 0 ".join(words).decode() + " 0"], add_special_tokens=False)[0].ids
        return self._pieces(ids, np.array(ids) == self.zero[0], words, skip=1)

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        split: dict[bytes, list[bytes]] = {}
        others, singles = [], []
        letters = {w for w in words if w.isalpha()}  # bytes: a-z only, so one run each
        for w in words - letters:
            match = _LETTERS.fullmatch(w)
            if match:
                split[w] = [run for run in match.groups() if run]
            elif match := _LATIN.fullmatch(w.decode()):
                split[w] = [run.lower().encode() for run in match.groups() if run]
            elif len(self.zero) == 1 and not _has_number(w.decode()):
                others.append(w)
            else:
                singles.append(w)
        runs = [r for r in letters.union(*split.values()) if r not in known]
        ascii_runs, latin_runs = [r for r in runs if r.isascii()], [r for r in runs if not r.isascii()]
        for some, encode in ((ascii_runs, self._runs), (latin_runs, self._runs), (others, self._others)):
            for at in range(0, len(some), _TOGETHER):
                known.update(encode(some[at : at + _TOGETHER]))
        for w, e in zip(singles, self.full.encode_batch_fast([w.decode() for w in singles], add_special_tokens=False)):
            known[w] = np.array(e.ids, self.width).tobytes()
        for w, some in split.items():
            known[w] = b"".join([known[r] for r in some])

    def learn(self, texts: list[bytes]) -> None:
        """Tokenize the new words of several texts together."""
        self.every(pa.array(texts, pa.string()))

    def ids(self, data: bytes) -> bytes:
        return self.every(pa.array([data], pa.string()))[0]

    def every(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a word that several texts hold is looked up or tokenized once."""
        low = pc.ascii_lower(texts)  # ASCII only; the tokenizer lower-cases everything anyway
        whole = np.zeros(len(low), bool)
        for name in self.special:
            whole |= pc.match_substring(low, name).to_numpy(zero_copy_only=False)
        if whole.any():
            low = pc.if_else(pa.array(whole), "", low)
        split = pc.ascii_split_whitespace(low)
        words = split.flatten().dictionary_encode()
        known, different = self.known, words.dictionary.cast(pa.binary()).to_pylist()
        if len(known) > _CACHED:
            known.clear()
        new = set(filterfalse(known.__contains__, different)) - {b""}
        if new:
            self._learn(new)
        known[b""] = b""  # what stands before a leading blank
        pieces = pa.array([known[w] for w in different], pa.large_binary()).take(words.indices)
        ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))
        last = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))  # words up to each text's end
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], last])].tolist()
        data = memoryview(pieces.buffers()[2] or b"")
        out = [bytes(data[at:to]) for at, to in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(whole):
            out[i] = self.exact.ids(texts[i].as_py().encode())
        return out


def _has_number(word: str) -> bool:
    """Whether a character counts as a number anywhere in Unicode."""
    if word.isalpha() and max(word) < "\u0250":  # Latin letters
        return False
    return any(c.isnumeric() for c in word)


def suits(definition: str) -> bool:
    """Whether a tokenizer's JSON has the parts that ``WordTokenizer`` relies on."""
    parts = json.loads(definition)
    steps = [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers", [])]
    model = parts["model"]
    cuts = [t["type"] for t in (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    same = steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"]
    return same and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>"


class WholeTokenizer:
    """Ids of whole texts from any tokenizer of the library, without a memory of words."""

    def __init__(self, definition: str, width: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(definition)
        self.width = width

    def every(self, texts: pa.Array) -> list[bytes]:
        return [self.ids(t) for t in texts.cast(pa.binary()).to_pylist()]

    def ids(self, data: bytes) -> bytes:
        return np.array(self.full.encode(data.decode(), add_special_tokens=False).ids, self.width).tobytes()


def _tokenizer(shared: dict) -> WordTokenizer | WholeTokenizer:
    """The tokenizer of a broadcast; kept there, so its memory of words outlives a task."""
    if "tokenizer" not in shared:
        kind = WordTokenizer if suits(shared["definition"]) else WholeTokenizer
        shared["tokenizer"] = kind(shared["definition"], shared["width"])
    return shared["tokenizer"]


def hilbert_keys(points: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates below 2^bits.

    The published transposition: undo the excess work bit by bit, then Gray
    encode, then interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection() -> np.ndarray:
    """The fixed random directions of the hashed token counts."""
    return np.random.default_rng(_SEED).standard_normal((_BUCKETS, DIMS))


def curve_points(vectors: np.ndarray) -> np.ndarray:
    """Projected unit vectors as integer coordinates; the scale is fixed, not fitted."""
    flat = 1.0 / (1.0 + np.exp(-1.7 * vectors))  # nearly the normal distribution function
    return np.minimum((flat * (1 << _BITS)).astype(np.int64), (1 << _BITS) - 1)


def tokenized(docs: DataFrame, definition: str, end_id: int = END_ID) -> DataFrame:
    """(__d, uid, n, key, ids): every row's ids with the end id as little-endian integers."""
    spark = docs.sparkSession
    sizes = len(json.loads(definition)["model"]["vocab"]) + len(json.loads(definition).get("added_tokens") or [])
    width = "<u2" if max(sizes, end_id + 1) <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast({"definition": definition, "width": width})  # one tokenizer's file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, directions = _tokenizer(shared.value), projection()
        end = np.array([end_id], width).tobytes()
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, TEXT_BATCH):
                every, projected = [], []
                for data in tokenizer.every(texts[at : at + TEXT_BATCH]):
                    data += end
                    counts = np.bincount(np.frombuffer(data, width) % _BUCKETS, minlength=_BUCKETS)
                    projected.append(counts @ directions / np.sqrt(counts @ counts))
                    every.append(data)
                keys = hilbert_keys(curve_points(np.array(projected)))
                lengths = np.array([len(e) for e in every]) // np.dtype(width).itemsize
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__d")[at : at + TEXT_BATCH], pa.array(lengths, pa.int64()), pa.array(keys, pa.int64()), pa.array(every, pa.binary())],
                    names=["__d", "n", "key", "ids"],
                )

    small_batches(spark)
    slim = docs.select(id_order("doc_id").alias("__d"), whole_text().alias("text"))
    out = slim.mapInArrow(run, "__d bigint, n bigint, key bigint, ids binary")
    return out.select("*", F.monotonically_increasing_id().alias("uid"), F.lit(width).alias("width"))


def stream_starts(rows: DataFrame) -> DataFrame:
    """(uid, at): the tokens before each document along the curve."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "__d", "uid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), pa.array(ends - n), batch.column("n"), pa.array(np.full(len(n), part, np.int32))],
                names=["uid", "inside", "n", "part"],
            )
            before = int(ends[-1]) if len(ends) else before

    ranged = rows.select("uid", "n", *order[:2]).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = staged(ranged.mapInArrow(run, "uid bigint, inside bigint, n bigint, part int"), "pack-order")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("n").alias("t"))  # one row per range partition
    starts = totals.select("part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("start"))
    return placed.join(broadcast_if_small(starts), "part").select("uid", (F.col("start") + F.col("inside")).alias("at"))


_PIECES = (
    "__d bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, ids binary"
)


def pack(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: where its ids go, and the ids as little-endian uint32."""
    rows = staged(tokenized(docs, definition, end_id), "pack-tokens")
    met = rows.select("uid", "__d", "n", "ids", "width").join(stream_starts(rows), "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__d", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for d, n, data, width, at in zip(*[batch.column(c) for c in ("__d", "n", "ids", "width", "at")]):
                d, n, at = d.as_py(), n.as_py(), at.as_py()
                ids = np.frombuffer(data.as_py(), width.as_py()).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, capacity)
                    length = min(n - start, capacity - offset)
                    piece = ids[start : start + length].tobytes()
                    out.append((d, start, length, zlib.crc32(piece), n, sequence, offset, piece))
                    start, held = start + length, held + len(piece)
                if held > 1 << 22:
                    yield _batch(out, names)
                    out, held = [], 0
            if out:
                yield _batch(out, names)

    return met.mapInArrow(run, _PIECES)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(zip(*rows), names)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, n_pad): the ids of whole sequences; padding is not stored."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` pieces
    together = pieces.groupBy("sequence_id").agg(inside.alias("p"), F.sum("length").alias("n"))
    joined = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return together.select("sequence_id", joined.alias("ids"), (F.lit(capacity) - F.col("n")).alias("n_pad"))


def default_tokenizer() -> str:
    """The JSON of the public 49k word BPE."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        F.when(F.col("__d") < NO_ID, F.col("__d")).alias("doc_id"),
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return digest(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
