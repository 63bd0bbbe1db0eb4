"""Language identification by multilingual mixture inference.

Training counts hashed character n-grams (1 to ``N_MAX`` letters, words padded by
one blank) per language over all labelled rows; the counts are added up in Spark
and smoothed into one likelihood table of languages x ``FEATURES``.  A document
is a mixture of languages: expectation-maximisation estimates the proportions
under which its n-grams are likeliest, first with all languages, then with the
likeliest set of each size, and the set with the best penalised likelihood is
kept.  The prediction is the language with the largest proportion, the score
that proportion.

Whole texts are read; very long ones are counted slice by slice.  The driver and
the broadcast hold the likelihood table, whose size is languages x ``FEATURES``.

Defined cases: a missing text or one without a letter is 'und' with score 0; so
is every text if nothing could be learned; rows without a language are not
learned from; rows without an id count as held out by no rule (CRC of the empty
text); an empty table gives no rows; ties go to the language that sorts first.
``keep_known`` passes all columns through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.llm.common import packed_row, small_batches, table

UNKNOWN = "und"
FEATURES = 1 << 16
N_MAX = 3
SMOOTHING = 0.5
ROUNDS = 12  # of expectation-maximisation
# Log likelihood that one more language has to add: a fixed part and one per log of the n-grams.
PENALTY, PENALTY_LOG = 10.0, 2.0
MIN_SHARE = 0.3  # a document is kept if one language holds at least this share
_SLICE = 1 << 20  # characters counted at a time
_MIX = np.uint32(0x9E3779B1)


def held_out(modulus: int, remainder: int) -> Column:
    """Rows that training leaves out: crc32 of the id as text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngram_counts(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Hashed n-gram counts of the lower-cased letters, None without a letter."""
    total, seen = np.zeros(FEATURES, np.int64), False
    for at in range(0, len(text), _SLICE):
        codes = np.frombuffer(text[at : at + _SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters[codes]
        if not letter.any():
            continue
        seen = True
        codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint32)
        blank = codes == 32
        codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
        code = np.zeros(len(codes), np.uint32)
        for n in range(1, N_MAX + 1):
            code = (code[: len(codes) - n + 1] + codes[n - 1 :]) * _MIX
            if len(code):
                total += np.bincount(code >> np.uint32(16), minlength=FEATURES)
    return total if seen else None


def language_counts(labelled: DataFrame) -> DataFrame:
    """(lang, feature, n) over all rows of (lang, text)."""
    small_batches(labelled.sparkSession)
    letters = labelled.sparkSession.sparkContext.broadcast(letter_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                counts = ngram_counts(text.as_py() or "", letters.value)
                if counts is not None:
                    found[lang] = found[lang] + counts if lang in found else counts
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])],
                names=["lang", "feature", "n"],
            )

    parts = labelled.select("lang", "text").mapInArrow(run, "lang string, feature int, n bigint")
    return parts.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


@dataclass
class Languages:
    """Learned language names and the log likelihood of each n-gram under them."""

    names: list[str]
    log_likelihood: np.ndarray  # (FEATURES, languages)
    letters: np.ndarray

    def mixture(self, text: str | None) -> tuple[list[int], np.ndarray] | None:
        """(language set, proportions) of a text, None without letters or languages."""
        counts = ngram_counts(text, self.letters) if text and self.names else None
        if counts is None:
            return None
        at = np.flatnonzero(counts)
        return chosen_set(self.log_likelihood[at], counts[at].astype(float))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.mixture(text)
        if found is None:
            return UNKNOWN, 0.0
        languages, shares = found
        best = min(range(len(languages)), key=lambda i: (-shares[i], self.names[languages[i]]))
        return self.names[languages[best]], float(min(1.0, max(0.0, shares[best])))


def estimated(log_likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(proportions, log likelihood, bound) after ``ROUNDS`` rounds from equal proportions.

    No proportions of these languages have a log likelihood above ``bound``: the
    log likelihood is concave, so its slope limits what is left to gain.
    """
    top = log_likelihood.max(axis=1, keepdims=True)
    likely = np.exp(log_likelihood - top)
    total = counts.sum()
    shares = np.full(likely.shape[1], 1.0 / likely.shape[1])
    for _ in range(ROUNDS):
        slope = (counts / (likely @ shares)) @ likely / total
        shares = shares * slope
    mixed = np.maximum(likely @ shares, 1e-300)
    fit = float(counts @ (np.log(mixed) + top[:, 0]))
    slope = (counts / mixed) @ likely / total
    return shares, fit, fit + float(total * max(0.0, slope.max() - 1.0))


def chosen_set(log_likelihood: np.ndarray, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The language set with the best penalised likelihood, and its proportions.

    Sets hold the best single language and those that a mixture of all languages
    gives the largest shares.  A set of any size is tried as long as even the best
    mixture of all languages could pay for that many.
    """
    single = counts @ log_likelihood
    best = int(np.argmax(single))
    languages, shares, value = [best], np.ones(1), float(single[best])
    if log_likelihood.shape[1] == 1:
        return languages, shares
    price = PENALTY + PENALTY_LOG * math.log1p(counts.sum())
    shared, _, bound = estimated(log_likelihood, counts)
    order = [best] + [int(i) for i in np.argsort(-shared, kind="stable") if i != best]
    for size in range(2, len(order) + 1):
        if bound - (size - 1) * price <= value:
            break
        some = order[:size]
        found, fit, _ = estimated(log_likelihood[:, some], counts)
        if fit - (size - 1) * price > value:
            languages, shares, value = some, found, fit - (size - 1) * price
    return languages, shares


def learn(labelled: DataFrame) -> Languages:
    """Likelihoods from all rows of (lang, text) that have a language."""
    counts = language_counts(labelled.filter(F.col("lang").isNotNull())).toArrow()  # languages x FEATURES cells at most
    langs = counts.column("lang").to_pylist()
    names = sorted(set(langs))
    place = {n: i for i, n in enumerate(names)}
    seen = np.zeros((FEATURES, len(names)))
    seen[counts.column("feature").to_numpy(), [place[x] for x in langs]] = counts.column("n").to_numpy()
    smooth = seen + SMOOTHING
    return Languages(names, np.log(smooth / smooth.sum(axis=0)) if names else seen, letter_table())


def predictions(docs: DataFrame, model: Languages) -> DataFrame:
    """(__row, lang_pred, score): every row, as a struct, with its prediction."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.log_likelihood, model.letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Languages(*shared.value)
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column("__row").field("text")]
            names = pa.array([f[0] for f in found], pa.string())
            scores = pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("__row"), names, scores], names=["__row", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(packed_row(docs))
    kind = rows.schema["__row"].dataType.simpleString()
    return rows.mapInArrow(run, f"__row {kind}, lang_pred string, score double")


def training_rows(docs: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    return docs.filter(~held_out(modulus, remainder)).select(F.col("lang").cast("string").alias("lang"), "text")


def keep_known(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Documents in which one learned language holds at least ``min_share``; the others go."""
    found = predictions(docs, learn(training_rows(docs)))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_share)).select("__row.*")


def op3_language(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(training_rows(docs))
    out = predictions(docs.select("doc_id", "text"), model)
    rows = out.select(F.col("__row.doc_id").alias("doc_id"), "lang_pred", "score")
    return rows.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
