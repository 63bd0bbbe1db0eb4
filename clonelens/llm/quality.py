"""Quality classification by a sparse ensemble of rules.

Every text becomes a row of simple statistics.  Shallow trees grown on the
labelled rows are cut into their paths; each path is a conjunction of
conditions on statistics, a rule.  A lasso logistic regression over all rules
keeps few of them.  Those are compiled into one Spark column expression, so
scoring is a projection over the statistics without any Python.

All labelled rows take part in fitting, distributed by Spark ML; the driver
holds trees of bounded size and the rule weights.

Defined cases: a missing text counts as empty and is scored like one; rows of
``labels`` without a label or a document teach nothing; if several labels name
one document, each counts; with labels of one class only, or none, every score
is that share (0.5 without labels); rows without an id are scored and never
learned from; an empty table gives no rows.  Labels, language, source and id
are not statistics.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonelens.llm.common import small_batches, table
from clonelens.llm.language import held_out
from clonelens.session import staged

TREES, DEPTH = 24, 3
PENALTY = 1e-3  # of the lasso
LEAST_WEIGHT = 1e-6  # rules below are not compiled
KEEP_FROM = 0.7
_SLICE = 1 << 20  # words looked at together

STATISTICS = (
    "log_words", "log_lines", "mean_word", "words_per_line", "mean_sentence", "upper_share", "digit_share",
    "symbol_share", "stop_share", "bang_share", "pipe_share", "non_ascii_share", "control_share", "space_share",
    "distinct_words", "repeated_lines", "top_word_share", "symbol_words", "upper_words", "short_lines",
    "distinct_pairs", "ended_lines",
)
_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "stop": (46, 44, 59, 58), "bang": (33, 63), "pipe": (124, 60, 62, 123, 125),
    "symbol": (35, 36, 37, 38, 42, 43, 47, 61, 64, 91, 92, 93, 94, 95, 96, 126), "space": (32,),
    "control": [c for c in range(32) if c not in (9, 10, 13)] + [127], "high": range(128, 256),
}


def statistics(data: bytes) -> list[float]:
    """The numbers of ``STATISTICS`` for a text's UTF-8 bytes."""
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    share = {k: float(seen[list(v)].sum()) / n for k, v in _CLASSES.items()}
    words = data.lower().split()
    as_written = data.split()
    n_words = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = set()
    for at in range(0, len(words), _SLICE):
        pairs.update(map(hash, zip(words[at : at + _SLICE], words[at + 1 : at + _SLICE + 1])))
    lines = [line.strip() for line in data.split(b"\n")]
    full = [line for line in lines if line] or [b""]
    sentences = max(1, int(seen[[46, 33, 63]].sum()))
    signed = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:!?")
    return [
        math.log1p(len(words)), math.log1p(len(lines)), len(data) / n_words, len(words) / len(full), len(words) / sentences,
        share["upper"], share["digit"], share["symbol"], share["stop"], share["bang"], share["pipe"], share["high"],
        share["control"], share["space"], len(counts) / n_words, 1.0 - len(set(full)) / len(full),
        max(counts.values(), default=0) / n_words, signed / n_words, sum(map(bytes.isupper, as_written)) / n_words,
        sum(1 for line in full if len(line) < 30) / len(full), len(pairs) / n_words,
        sum(1 for line in full if line[-1:] in (b".", b"!", b"?")) / len(full),
    ]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, one column per statistic) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.binary())
            rows = np.array([statistics(t.as_py() or b"") for t in texts])
            columns = [pa.array(rows[:, i]) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *STATISTICS])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{s} double" for s in STATISTICS))


Condition = tuple[int, bool, float]  # statistic, whether it must be above, threshold


def tree_paths(described_tree: str) -> list[tuple[Condition, ...]]:
    """The path to every node below the root of a tree, from its printed form.

    The form indents children under lines 'If (feature i <= x)' and
    'Else (feature i > x)'.
    """
    out, stack = [], []
    for line in described_tree.splitlines():
        match = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if match:
            depth = len(match[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, (int(match[2]), match[3] == ">", float(match[4]))))
            out.append(tuple(sorted(c for _, c in stack)))
    return out


def rule_column(rule: tuple[Condition, ...]) -> Column:
    """1.0 where all conditions hold, else 0.0."""
    holds = F.lit(True)
    for statistic, above, threshold in rule:
        value = F.col(STATISTICS[statistic])
        holds = holds & ((value > threshold) if above else (value <= threshold))
    return F.when(holds, 1.0).otherwise(0.0)


@dataclass
class RuleEnsemble:
    """Weighted rules and an intercept on the log-odds scale."""

    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self) -> Column:
        """The probability of quality 1 as an expression over the statistics."""
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            odds = odds + F.lit(weight) * rule_column(rule)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Rules and weights from rows of statistics with a ``label`` of 0 or 1."""
    shares = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        share = next(iter(shares), 0.5)
        return RuleEnsemble([], math.log((share + 1e-3) / (1 - share + 1e-3)))
    rows = labelled.select(array_to_vector(F.array(*STATISTICS)).alias("features"), F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", bootstrap=False, seed=4, minInstancesPerNode=5
    ).fit(rows)
    rules = sorted({path for tree in forest.trees for path in tree_paths(tree.toDebugString)})
    marked = labelled.select(
        array_to_vector(F.array(*[rule_column(r) for r in rules])).alias("features"), F.col("label").cast("double").alias("label")
    )
    marked = staged(marked, "quality-rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60, aggregationDepth=2)
    found = lasso.fit(marked)
    weights = found.coefficients.toArray()
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, weights) if abs(w) > LEAST_WEIGHT], float(found.intercept))


def scored(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose id's CRC has the remainder teach nothing."""
    rows = staged(described(docs), "quality-statistics").withColumn("held_out", held_out(modulus, remainder))
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("label"))
    labelled = staged(rows.filter(~F.col("held_out")).join(known, "doc_id").select("label", *STATISTICS), "quality-labelled")
    score = fit(labelled).score()
    out = rows.select("doc_id", "held_out", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
