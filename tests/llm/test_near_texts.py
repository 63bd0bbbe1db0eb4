"""The near-duplicate stage against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from clonelens.llm import near_texts as nt


def _set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(rows):
    """Smallest id of each component of Jaccard links, by comparing all pairs; and the number of links."""
    sets, parent, n = [_set(t) for _, t in rows], list(range(len(rows))), 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) * 5 >= len(a | b) * 4:
                n += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values()), n


def _near(words, share, rng):
    """A copy with single words replaced until about ``share`` of the shingles are common."""
    out = list(words)
    for at in rng.sample(range(len(out)), max(1, round((1 - share) / (1 + share) * len(out) / 5))):
        out[at] = f"new{rng.random()}"
    return out


def _corpus(seed):
    rng = random.Random(seed)
    passage = [f"common{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 500))]
        texts.append(words if rng.random() < 0.5 else words + passage)
        texts += [_near(words, share, rng) for share in (0.72, 0.78, 0.82, 0.85, 0.9, 0.95)]
    centre = [f"c{rng.randrange(3000)}" for _ in range(200)]
    texts += [_near(centre, rng.uniform(0.75, 0.95), rng) for _ in range(120)]
    texts += [centre[:4], centre[:4], centre[:3], [], passage, passage]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("few, block, sketch", [(32, 2048, 18), (0, 16, 6)])
def test_the_stage_keeps_one_of_each_group_of_all_pairs(spark, documents, monkeypatch, few, block, sketch):
    for name, value in (("FEW", few), ("BLOCK", block), ("SKETCH", sketch)):
        monkeypatch.setattr(nt, name, value)
    rows = _corpus(few)
    want, links = _kept(rows)
    out = corpus_pipeline.near_duplicates(spark, documents(rows).repartition(3), "")
    assert sorted(r["doc_id"] for r in out.collect()) == want and links > 300


def test_bitmaps_never_part_similar_sets():
    rng = random.Random(3)
    dropped = 0
    for _ in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 300, 2000, 9000]))]
        a, b = (nt.shingles(" ".join(w).encode()) for w in (words, _near(words, rng.uniform(0.5, 0.99), rng)))
        bits = [np.frombuffer(nt.parities(x), np.uint64)[None, :] for x in (a, b)]
        unlike = bool(nt.unlike(*bits, len(a), len(b))[0])
        assert not (unlike and nt.similar(len(np.intersect1d(a, b)), len(a), len(b)))
        dropped += unlike
    assert dropped >= 100


def test_odd_documents(documents, odd_documents):
    docs = documents([*odd_documents, (None, "alone and without an id", "q")])
    out = nt.one_per_group(docs)
    assert out.schema == docs.schema
    assert sorted(map(repr, (r["doc_id"] for r in out.collect()))) == sorted(map(repr, [1, 2, 4, None, 5, 7, 8, 10, -3, None]))
    assert nt.one_per_group(documents([])).count() == 0


def test_fingerprints_find_links_first(documents, monkeypatch):
    """Similar texts within three bits are linked by the fingerprint search, unlike ones are not, and the stage uses it."""
    rng, rows = random.Random(8), []
    for i in range(12):
        words = [f"w{rng.randrange(10_000)}" for _ in range(400)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:-1], "end"])), (3 * i + 2, " ".join(_near(words, 0.85, rng)))]
    seen = []
    search = nt.fingerprint_links
    monkeypatch.setattr(nt, "fingerprint_links", lambda prints, sets: seen.append(search(prints, sets)) or seen[-1])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(None, documents(rows), "").collect()) == list(range(0, 36, 3))
    found = {frozenset((r["a"], r["b"])) for r in seen[0].collect()}
    sets = [nt.shingles(t.encode()) for _, t in rows]
    classes, prints = [nt.class_of(s) for s in sets], [nt.fingerprint(s) for s in sets]
    apart = lambda i, j: ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count()
    near = {frozenset((classes[i], classes[j])) for i in range(36) for j in range(i) if i // 3 == j // 3 and apart(i, j) <= 3}
    similar = {frozenset((classes[i], classes[j])) for i in range(36) for j in range(i) if i // 3 == j // 3}
    assert len(near) >= 10 and found <= similar and len(found) >= 10
    assert all(any(c in pair for pair in found) for both in near for c in both)


def test_the_fingerprint_search_takes_every_class(documents, monkeypatch):
    """Classes that meet no other in a shingle are searched as well, and pairs that it finds among them are compared."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))) for i in range(20)]
    rows += [(20, "no other text"), (21, None), (22, rows[0][1])]
    sets = [nt.shingles((t or "").encode()) for _, t in rows]
    searched, probes, pairs = [], nt.simhash.probes, nt.fingerprint_pairs

    def probing(classes, *rest):
        searched.extend(r["fp"] for r in classes.collect())
        return probes(classes, *rest)

    def with_unlike_pairs(prints):
        unlike = [tuple(sorted((nt.class_of(sets[i]), nt.class_of(sets[i + 1])))) for i in range(21)]
        return pairs(prints).unionByName(prints.sparkSession.createDataFrame(unlike, "a bigint, b bigint"))

    monkeypatch.setattr(nt.simhash, "probes", probing)
    monkeypatch.setattr(nt, "fingerprint_pairs", with_unlike_pairs)
    kept = corpus_pipeline.near_duplicates(None, documents(rows), "").collect()
    assert sorted(searched) == sorted({nt.fingerprint(s) for s in sets})
    assert sorted(r["doc_id"] for r in kept) == list(range(22))
