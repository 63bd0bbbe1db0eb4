import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from clonelens.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, k=10):
    """Every document scored for every item."""
    split = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in set(items):
        scored = []
        for d, words in split:
            tf = Counter(words)
            score = 0
            for t in terms(text):
                if tf[t]:
                    m = 25 + (75 * len(words) * n_docs) // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, math.inf if d is None else d))
        for rank, (score, d) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if d == math.inf else d, -score))
    return sorted(out, key=repr)


def got(spark, documents, docs, items, k=10):
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, d string")
    found = lexical.search(documents(docs), asked, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in found.collect()], key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "x9"]
    chances = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, chances, k=rng.choice([1, 3, 20, 80])))) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(150)]  # copies: ties at every rank
    docs += [(7, docs[8][1]), (7, docs[8][1]), (None, docs[8][1]), (2000, None), (2001, ""), (2002, " .,; ")]
    items = [(i, " ".join(rng.choices(words, chances, k=rng.choice([1, 2, 15])))) for i in range(25)]
    items += [(30, docs[5][1]), (31, None), (32, "..."), (33, "nowhere"), (30, docs[5][1]), (34, "W1 w1-W1"), (35, docs[8][1])]
    return docs, items


@pytest.mark.parametrize("k", [1, 10])
def test_against_all_scores(spark, documents, corpus, k):
    assert got(spark, documents, *corpus, k) == expected(*corpus, k)


def test_small_blocks_and_steps(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 1)  # every 1024 rows are a block
    monkeypatch.setattr(lexical, "FIRST_STEP", 2)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 200)  # several query blocks
    docs, items = corpus
    many = [(10_000 * c + (d or 0), t) for c in range(4) for d, t in docs]
    assert got(spark, documents, many, items) == expected(many, items)


def test_odd_documents(spark, documents, odd_documents):
    items = [(1, odd_documents[0][1]), (2, "words here WORD5"), (None, "short"), (3, odd_documents[10][1][:500])]
    docs = [(d, t) for d, t, *_ in odd_documents]
    assert got(spark, documents, odd_documents, items) == expected(docs, items)


def test_empty_tables(spark, documents):
    assert got(spark, documents, [], [(1, "a")]) == []
    assert got(spark, documents, [(1, "a b")], []) == []


def test_slices_end_between_terms(monkeypatch):
    text = "Some ÄÖÜ words, and a very-long " + "x" * 50 + " tail 12"
    monkeypatch.setattr(lexical, "_SLICE", 7)
    found = [t.decode() for part in lexical.split_terms(text.encode()) for t in part]
    assert found == terms(text)


def test_lists_stop_early():
    """With a floor that nothing reaches, only the first step of each list is read."""
    rng = np.random.default_rng(2)
    postings = defaultdict(list)
    for t in range(3):
        for d in rng.choice(5000, 4000, replace=False):
            postings["doc"].append(d)
            postings["term"].append(t)
            postings["impact"].append(int(rng.integers(1, 1000)))
    arrays = {k: np.array(v) for k, v in postings.items()}
    lists = lexical.Lists(np.arange(5000), arrays["doc"], arrays["term"], arrays["impact"], 3)
    item = [(0, 2), (1, 1), (2, 3)]
    exact = np.zeros(5000, np.int64)
    np.add.at(exact, arrays["doc"], arrays["impact"] * np.array([2, 1, 3])[arrays["term"]])
    assert len(lists.best(item, 10, int(exact.max()) + 1)[0]) == 0
    places, scores = lists.best(item, 10, 0)
    assert (exact[places] == scores).all()
    edge = np.sort(exact)[-10]
    assert set(np.flatnonzero(exact >= edge)) <= set(places)
