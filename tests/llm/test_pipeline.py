"""The corpus pipeline against a brute-force version of its stages."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from test_line_dedup import _by_hand
from test_mixing import _targets, _words
from test_simhash import _components

import corpus_pipeline
from clonelens.llm import language, packing, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage but the last, and the packed pieces."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        rows = kept.collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    out.append(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    return out


def _ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "mixing", "packing"]


def test_language_stage(stages):
    letters = language.letter_table()
    counts: dict = {}
    for r in stages[0]:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            found = language.ngram_counts(r["text"] or "", letters)
            if found is not None:
                counts[r["lang"]] = counts.get(r["lang"], 0) + found
    names = sorted(counts)
    smooth = np.array([counts[n] for n in names]).T + language.SMOOTHING
    model = language.Languages(names, np.log(smooth / smooth.sum(axis=0)), letters)
    want = []
    for r in stages[0]:
        name, score = model.predict(r["text"])
        if name != "und" and score >= language.MIN_SHARE:
            want.append(r["doc_id"])
    assert _ids(stages[1]) == sorted(want) and len(want) >= 0.98 * len(stages[0])


def test_line_stage(stages):
    want = _by_hand([(r["doc_id"], r["text"]) for r in stages[1]])
    got = sorted(((r["doc_id"], r["text"]) for r in stages[2]), key=repr)
    assert got == sorted(((d, kept) for d, _, _, kept in want), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_duplicate_stage(stages):
    ids = [r["doc_id"] for r in stages[2]]
    prints = [simhash.fingerprint((r["text"] or "").encode()) % (1 << 64) for r in stages[2]]
    assert _ids(stages[3]) == sorted(set(_components(prints, ids)))


def test_mixing_stage(stages):
    by_source: dict = {}
    for r in stages[3]:
        falls = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:8], 16) % 2
        words = _words(r["text"])
        by_source.setdefault(r["source"], []).append((falls, -words if falls else words, r["doc_id"], words))
    targets = _targets({s: sum(r[3] for r in rows) for s, rows in by_source.items()})
    want = Counter()
    for s, rows in by_source.items():
        size = sum(r[3] for r in rows)
        each = targets[s] / size if size else 0.0
        tries = []
        for j in range(32):
            offset = int(hashlib.md5(f"mix:{s or ''}".encode()).hexdigest()[:8], 16) / 2.0**32 + j / 32
            taken = [math.floor((i + 1) * each + offset) - math.floor(i * each + offset) for i in range(len(rows))]
            tries.append((abs(sum(n * r[3] for n, r in zip(taken, sorted(rows))) - targets[s]), j, taken))
        for n, r in zip(min(tries)[2], sorted(rows)):
            want[r[2]] += n
    assert Counter(r["doc_id"] for r in stages[4]) == +want


def test_packing_stage(stages):
    whole = packing.WholeTokenizer(packing.default_tokenizer(), "<u4")
    tokens = {r["doc_id"]: len(whole.ids((r["text"] or "").encode())) // 4 + 1 for r in stages[4]}
    copies = Counter(r["doc_id"] for r in stages[4])
    packed, filled = Counter(), Counter()
    for r in sorted(stages[5], key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["doc_tokens"] == tokens[r["doc_id"]] and r["offset"] == filled[r["sequence_id"]]
        packed[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]] += r["length"]
    assert packed == Counter({d: n * tokens[d] for d, n in copies.items()})
    assert all(n == packing.CAPACITY for s, n in filled.items() if s != max(filled))


def test_odd_documents_pass_through(documents, odd_documents, spark):
    docs = documents(odd_documents)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_empty_table(documents, spark):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = documents([])
