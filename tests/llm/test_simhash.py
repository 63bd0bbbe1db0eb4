import random

import numpy as np
import pytest
import xxhash

from clonelens.llm import simhash as s
from clonelens.llm.components import components


def _by_definition(text):
    words = bytes(text or "", "utf8").lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    bits = [sum(h >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b])


def _components(prints, ids):
    """Smallest id reachable over links of at most 3 bits, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(prints))]
    least = {}
    for r, d in zip(roots, ids):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(r) for r in roots]


def test_fingerprints_equal_the_definition(odd_documents, monkeypatch):
    for _, text, *_ in odd_documents:
        if len(text or "") < 1000:
            assert s.fingerprint((text or "").encode()) % (1 << 64) == _by_definition(text)
    long = " ".join(f"w{i * i % 1013}" for i in range(700))
    monkeypatch.setattr(s, "_SLICE", 50)
    assert s.fingerprint(long.encode()) % (1 << 64) == _by_definition(long)


def _planted(n, seed):
    """Distinct fingerprints: random ones, neighbours of them and one dense cluster."""
    rng = random.Random(seed)
    found = {rng.getrandbits(64) for _ in range(n)}
    for x in list(found)[: n // 3]:
        for flips in (1, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), flips):
                y ^= 1 << b
            found.add(y)
    centre = rng.getrandbits(64)
    for _ in range(n // 2):
        y = centre
        for b in rng.sample(range(64), rng.randint(1, 6)):
            y ^= 1 << b
        found.add(y)
    return sorted(found)


@pytest.mark.parametrize("parts, block", [(4, 8192), (3, 8192), (2, 8192), (4, 16)])
def test_no_link_is_lost(spark, monkeypatch, parts, block):
    monkeypatch.setattr(s, "BLOCK", block)
    prints = _planted(120, parts)
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    classes = spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(3)
    groups = s.grouped_bits(s.bit_correlations(classes), parts)
    assert sorted(b for g in groups for b in g) == list(range(64))
    counts = s.value_counts(classes, groups)
    links = s.verified_links(s.probes(classes, groups, counts))
    found = {r["node"]: r["component"] for r in components(links).collect()}
    want = _components(prints, signed)
    assert [found.get(x, x) for x in signed] == want


def test_radii_are_complete_and_skip_common_values():
    parts = [list(range(i * 16, i * 16 + 16)) for i in range(4)]
    counts = np.ones((4, 1 << 16))
    counts[0, 0] = 1e7  # the value 0 is very common in the first part
    balls = [s._ball_counts(c, 16) for c in counts]
    prints = np.array([0, -1], np.int64)
    chosen = s.radii(prints, parts, balls, 3)
    assert (chosen.sum(axis=1) == 3 - 4 + 1).all()
    assert chosen[0, 0] == -1 and (chosen[1] == 0).all()


def test_the_number_of_parts_falls_with_the_input():
    assert s.number_of_parts(10_000, 3) == 4 and s.number_of_parts(10**8, 3) == 3 and s.number_of_parts(10**12, 3) == 2


def test_odd_documents(documents, odd_documents):
    found = s.near_duplicates(documents(odd_documents)).selectExpr("__d", "fp", "first.__d AS c").collect()
    prints = [s.fingerprint((t or "").encode()) % (1 << 64) for _, t, *_ in odd_documents]
    want = _components(prints, [d for d, *_ in odd_documents])
    last = s.NO_ID
    got = sorted((r["__d"], r["fp"] % (1 << 64), r["c"]) for r in found)
    assert got == sorted((last if d is None else d, p, last if c is None else c) for (d, *_), p, c in zip(odd_documents, prints, want))


def test_one_document_of_each_group_stays(documents, odd_documents):
    docs = documents([*odd_documents, (None, "alone and without an id", "q"), (None, "alone and without an id", "q")])
    out = s.one_per_group(docs)
    assert out.schema == docs.schema
    assert sorted(map(repr, (r["doc_id"] for r in out.collect()))) == sorted(map(repr, [1, 2, 4, None, 5, 7, 8, 10, -3, None]))


def test_empty_table(documents):
    assert s.near_duplicates(documents([])).count() == 0 and s.one_per_group(documents([])).count() == 0


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a bigint, b bigint").repartition(4)
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert all(found[i] == 0 for i in range(301)) and found[1001] == 1000 and found[1000] == 1000
