import numpy as np
import pytest
from pyspark.sql import functions as F

from clonelens.llm import language as lang


def test_held_out_accuracy(spark):
    found = lang.op3_language(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    right = found.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("a")).first()["a"]
    assert found.count() == 1000 and right > 0.98


def test_counts_equal_a_plain_loop(spark):
    text, table = "Aé b!\n\tbc", lang.letter_table()
    spaced, want = " aé b bc ", np.zeros(lang.FEATURES, int)
    for n in range(1, lang.N_MAX + 1):
        for i in range(len(spaced) - n + 1):
            code = 0
            for c in spaced[i : i + n]:
                code = (code + ord(c)) * 0x9E3779B1 % (1 << 32)
            want[code >> 16] += 1
    assert (lang.ngram_counts(text, table) == want).all()
    assert lang.ngram_counts("1 2 *", table) is None


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return lang.learn(lang.training_rows(docs)), {r["lang"]: r["text"] for r in docs.orderBy("doc_id").limit(60).collect()}


def test_a_mixture_is_found(model):
    learned, texts = model
    half = 2000
    mixed = (texts["en"] * 9)[:half] + " " + (texts["de"] * 9)[:half]
    languages, shares = learned.mixture(mixed)
    found = {learned.names[i]: s for i, s in zip(languages, shares)}
    assert found["en"] > 0.3 and found["de"] > 0.3 and abs(sum(found.values()) - 1) < 1e-6
    languages, _ = learned.mixture(texts["fr"])
    assert [learned.names[i] for i in languages] == ["fr"]


def test_odd_documents(documents, odd_documents, model):
    docs = documents(odd_documents)
    rows = lang.predictions(docs, model[0]).select("__row.text", "lang_pred", "score").collect()
    assert len(rows) == len(odd_documents)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0.0 <= r["score"] <= 1.0
    kept = lang.keep_known(docs)
    assert kept.schema == docs.schema


def test_nothing_to_learn_from(documents):
    docs = documents([(1, "some text", "a", None)])
    assert lang.predictions(docs, lang.learn(lang.training_rows(docs))).first()["lang_pred"] == "und"
    assert lang.keep_known(documents([])).count() == 0


def _all_sets(log_likelihood, counts):
    """(value, set) of every set of languages, with finely estimated proportions."""
    from itertools import combinations

    price = lang.PENALTY + lang.PENALTY_LOG * np.log1p(counts.sum())
    out = []
    for size in range(1, log_likelihood.shape[1] + 1):
        for some in combinations(range(log_likelihood.shape[1]), size):
            likely = np.exp(log_likelihood[:, some])
            shares = np.full(size, 1.0 / size)
            for _ in range(400):
                shares = shares * ((counts / (likely @ shares)) @ likely) / counts.sum()
            out.append((float(counts @ np.log(likely @ shares)) - (size - 1) * price, set(some)))
    return out


def test_chosen_set_against_all_sets():
    """Documents drawn from one to six of six languages get the best of all 63 sets, or one within a hair of it."""
    rng = np.random.default_rng(8)
    table = np.log(rng.dirichlet(np.full(300, 0.15), 6).T + 1e-6)
    sizes = []
    for trial in range(40):
        k = 1 + trial % 6
        truth = rng.choice(6, k, replace=False)
        mixed = np.exp(table[:, truth]) @ rng.dirichlet(np.full(k, 5.0))
        counts = rng.multinomial(rng.integers(300, 3000), mixed / mixed.sum()).astype(float)
        at = np.flatnonzero(counts)
        languages, shares = lang.chosen_set(table[at], counts[at])
        values = _all_sets(table[at], counts[at])
        best = max(values, key=lambda v: v[0])
        mine = next(v for v, s in values if s == set(languages))
        assert mine > best[0] - 0.5, (best, languages)
        assert abs(shares.sum() - 1) < 1e-9
        sizes.append(len(languages))
    assert max(sizes) > 4 and min(sizes) == 1


def test_no_proportions_exceed_the_bound():
    rng = np.random.default_rng(1)
    table = np.log(rng.dirichlet(np.ones(50), 5).T)
    counts = rng.integers(1, 9, 50).astype(float)
    _, fit, bound = lang.estimated(table, counts)
    tried = [float(counts @ np.log(np.exp(table) @ rng.dirichlet(np.ones(5)))) for _ in range(500)]
    assert fit <= bound and max(tried) <= bound
