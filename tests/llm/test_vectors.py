import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonelens.llm import collisions as ann
from clonelens.llm import pivots as pv

SCHEMA = "vec_id bigint, embedding array<float>, label int, weight int, root string"
BAD = [None, [], [0.0] * 8, [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")], [1.0] * 7 + [None], [1.0, 2.0]]


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "r") for i, v in rows], SCHEMA)


def _planted(n, dims, cosine, seed):
    """Vectors in loose clusters, each third one with a partner at the given cosine."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((8, dims))[rng.integers(0, 8, n)] * 0.4 + rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.standard_normal((n // 3, dims))
    r -= (r * x[: n // 3]).sum(axis=1, keepdims=True) * x[: n // 3]
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    near = cosine * x[: n // 3] + math.sqrt(1 - cosine**2) * r
    return np.vstack([x, near]).astype(np.float32)


def _links(x):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= pv.THRESHOLD
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("cosine, least", [(0.905, 0.95), (0.97, 0.99)])
def test_recall_of_links(spark, cosine, least):
    x = _planted(1500, 64, cosine, 5)
    want = _links(x)
    rows = pv.near_vectors(_table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    got = np.array([r["n_links"] for r in sorted(rows, key=lambda r: r["vec_id"])])
    assert (got <= want.sum(axis=1)).all() and got.sum() >= least * want.sum() and want.sum() >= 900


@pytest.mark.parametrize("count", [1024, 2048])
def test_recall_of_links_with_many_pivots(count):
    """Partners at the threshold, with the prefixes that a long table gives."""
    rng = np.random.default_rng(count)
    points, x, r = (rng.standard_normal((n, 64)) for n in (count, 3000, 3000))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    y = 0.901 * x + math.sqrt(1 - 0.901**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    prefix = [np.argsort(-(v @ points.T), axis=1, kind="stable")[:, : pv.PREFIX] for v in (x, y)]
    a, b = (pv._Part(np.arange(3000), np.ones(3000, np.int64), p, v) for p, v in zip(prefix, (x, y)))
    found, meet = 0, 0
    for i in range(3000):
        both = np.intersect1d(prefix[0][i], prefix[1][i])
        meet += len(both) > 0
        for pivot in both:
            found += sum(len(p) for p, _ in pv._reported(a.rows([i]), b.rows([i]), pivot, pv.THRESHOLD, False))
    print(f"{count} pivots: {found} of 3000 links found, {meet} meet")
    assert found == meet and found >= 0.99 * 3000


@pytest.mark.parametrize("block", [2048, 32])
def test_a_dense_group_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(pv, "BLOCK", block)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    x = np.vstack([centre + 0.01 * rng.standard_normal((150, 16)), rng.standard_normal((100, 16))]).astype(np.float32)
    x = np.vstack([x, x[:20], x[200:201], 3 * x[201:202]])
    want = _links(x)
    rows = sorted(pv.near_vectors(_table(spark, [(1000 - i, v.tolist()) for i, v in enumerate(x)])).collect(), key=lambda r: -r["vec_id"])
    assert [r["n_links"] for r in rows] == want.sum(axis=1).tolist()
    least = [min([1000 - i, *(1000 - np.flatnonzero(want[i]))]) for i in range(len(x))]
    assert [r["component_id"] for r in rows[:150]] == [min(least[:150])] * 150
    assert sum(r["kept"] for r in rows) == len({r["component_id"] for r in rows})


def test_unusable_vectors_link_with_nothing(spark):
    good = [(10, [1.0] * 8), (None, [1.0] * 8), (11, [1.0] * 8), (11, [1.0] * 8)]
    rows = pv.near_vectors(_table(spark, [*enumerate(BAD), *good])).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows), key=repr)
    want = [(i, 0, i, True) for i in range(len(BAD))] + [(10, 3, 10, True), (None, 3, 10, False), (11, 3, 10, False), (11, 3, 10, False)]
    assert got == sorted(want, key=repr)
    assert pv.near_vectors(_table(spark, [])).count() == 0
    assert pv.near_vectors(_table(spark, list(enumerate(BAD)))).count() == len(BAD)


def _nearest_by_hand(rows, k):
    """Exact neighbours of the rows whose id is divisible by 20."""
    out = {}
    for i, v in rows:
        if i is not None and i % 20 == 0:
            scored = [(-float((np.float64(w) * np.float64(v)).sum()), j) for j, w in rows if j != i]
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_of_neighbours(spark, monkeypatch, scale):
    monkeypatch.setattr(ann, "BLOCK", 700)
    x = _planted(1500, 64, 0.95, 7)
    if scale:
        x = x * np.random.default_rng(2).uniform(0.1, 3.0, (len(x), 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = _nearest_by_hand(rows, ann.NEIGHBOURS)
    got: dict = {}
    for r in ann.nearest(_table(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        ranked = [found[i + 1] for i in range(ann.NEIGHBOURS)]
        assert ranked == sorted(ranked, key=lambda p: (-p[1], p[0]))
        assert all(s == float((x[j].astype(float) * x[q].astype(float)).sum()) for j, s in ranked)
        hits += len({j for j, _ in ranked} & {j for j, _ in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("blocks", [1, 4])
def test_share_of_verified_rows(blocks):
    """Recall over all blocks, and how many rows of a block an inner product is computed for."""
    x = _planted(blocks * 6144, 64, 0.95, 11).astype(float)[: blocks * 8192]
    ids = np.arange(len(x))
    longest, asking = np.sqrt((x * x).sum(axis=1)).max(), ids[:: len(x) // 60]
    found, verified = [[] for _ in asking], 0
    for b in range(blocks):
        own = ids % blocks == b
        index = ann.BlockIndex(ids[own], ids[own], x[own], longest)
        for at, (places, scores) in enumerate(index.nearest(asking, x[asking], 20)):
            found[at] += [(-s, i) for s, i in zip(scores, index.order[places])]
        verified += index.verified
    hits = 0
    for at, q in enumerate(asking):
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len({i for _, i in sorted(found[at])[:20]} & set(np.argsort(-exact)[:20]))
    share, recall = verified / len(asking) / len(x), hits / len(asking) / 20
    print(f"{len(x)} rows: {share:.3f} verified, recall {recall:.3f}")
    assert recall >= 0.9 and share < 0.1


def test_collisions_are_counted_once_while_windows_grow(monkeypatch):
    """With a threshold of nothing but the counts, a search verifies what counting in the final windows would."""
    x = _planted(300, 16, 0.95, 3).astype(float)
    ids = np.arange(len(x))
    index = ann.BlockIndex(ids, ids, x, 1.0)
    seen = []
    monkeypatch.setattr(ann, "threshold", lambda half, distance: (seen.append(half), ann.HASHES + 1)[1])
    monkeypatch.setattr(index, "_better", lambda best, rows, query, k: (rows, rows.astype(float)))
    counted = []
    inside = np.bincount
    monkeypatch.setattr(ann.np, "bincount", lambda v, minlength: counted.append(inside(v, minlength=minlength)) or counted[-1])
    index.nearest(ids[:1], x[:1], 5)
    centre = x[0] / np.sqrt((x[0] * x[0]).sum()) @ index.directions[:-1]
    near = np.abs(ann.lifted(x, 1.0) @ index.directions - centre) < seen[-1]
    assert (sum(counted) == near.sum(axis=1)).all()


def test_other_blocks_search_within_the_bound_of_the_first(monkeypatch):
    """Every block opened its windows as if the query knew nothing; a known bound saves most of the counting."""
    x = _planted(12288, 64, 0.95, 13).astype(float)[:16384]
    ids, longest = np.arange(len(x)), np.sqrt((x * x).sum(axis=1)).max()
    one, two = (ann.BlockIndex(ids[ids % 2 == b], ids[ids % 2 == b], x[ids % 2 == b], longest) for b in (0, 1))
    asking, inside, counted = ids[::328], np.bincount, [0]
    first = one.nearest(asking, x[asking], 20)

    def count(v, minlength):
        counted[0] += len(v)
        return inside(v, minlength=minlength)

    monkeypatch.setattr(ann.np, "bincount", count)
    two.nearest(asking, x[asking], 20)
    whole, counted[0] = counted[0], 0
    second = two.nearer(asking, x[asking], [scores for _, scores in first], 20)
    assert counted[0] < 0.6 * whole
    hits = 0
    for q, (a, s), (b, t) in zip(asking, first, second):
        assert (t == (two.rows[b] * x[q]).sum(axis=1)).all()
        found = sorted([(-v, one.order[i]) for i, v in zip(a, s)] + [(-v, two.order[i]) for i, v in zip(b, t)])[:20]
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len({i for _, i in found} & set(np.argsort(-exact)[:20]))
    assert hits >= 0.9 * 20 * len(asking)


def test_bounds_that_say_nothing(spark, monkeypatch):
    """Copies at distance 0, queries alone in their block, and products beyond doubles, over many blocks."""
    monkeypatch.setattr(ann, "BLOCK", 7)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[10:50] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = sorted(tuple(r) for r in ann.nearest(_table(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect())
    want = _nearest_by_hand(rows, 5)
    assert [g[:3] for g in got if g[0] in (20, 40)] == [(q, i + 1, j) for q in (20, 40) for i, (j, _) in enumerate(want[q])]
    assert len(got) == 15
    wide = spark.createDataFrame([(i, [1e200 * (i % 7 + 1)] * 8) for i in range(30)], "vec_id bigint, embedding array<double>")
    assert ann.nearest(wide, F.col("vec_id") % 20 == 0, k=5).groupBy("query_id").count().collect() != []


def test_few_candidates_ties_and_unusable_vectors(spark):
    rows = [(i + 1, v) for i, v in enumerate(BAD)] + [(20, [1.0] * 8), (40, [2.0] * 8), (41, [2.0] * 8), (None, [2.0] * 8), (60, [0.0] * 8), (42, [-1.0] * 8)]
    got = [tuple(r) for r in ann.nearest(_table(spark, rows), F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [
        (20, 1, 40, 16.0), (20, 2, 41, 16.0), (20, 3, None, 16.0), (20, 4, 42, -8.0),
        (40, 1, 41, 32.0), (40, 2, None, 32.0), (40, 3, 20, 16.0), (40, 4, 42, -16.0),
    ]
    assert ann.nearest(_table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    huge = ann.nearest(_table(spark, [(20, [3e38] * 8), (1, [3e38] * 8)]), F.col("vec_id") % 20 == 0)
    assert huge.count() == 1


def test_every_length_takes_part(spark):
    """Vectors of a rare length are linked and searched among themselves."""
    rng = np.random.default_rng(7)
    usual, rare = rng.standard_normal((60, 8)), rng.standard_normal((20, 4))
    given = [(i, v.tolist()) for i, v in enumerate(usual)]
    given += [(100 + i, v.tolist()) for i, v in enumerate(rare)] + [(200 + i, v.tolist()) for i, v in enumerate(rare)]
    frame = _table(spark, given)
    rows = {r["vec_id"]: r for r in pv.near_vectors(frame).collect()}
    assert len(rows) == len(given)
    near = _links(np.vstack([rare, rare]).astype(np.float32))
    for at in range(40):
        row = rows[(100 if at < 20 else 180) + at]
        assert row["n_links"] == near[at].sum() >= 1 and row["component_id"] <= 100 + at % 20
    found = ann.nearest(frame, F.col("vec_id") % 100 == 0, k=3).collect()
    by_query = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100, 200)}
    assert all(len(v) == 3 for v in by_query.values())
    scores = rare.astype(np.float32).astype(float) @ rare.astype(np.float32)[0].astype(float)
    every = sorted([(-s, 100 + i) for i, s in enumerate(scores) if i] + [(-s, 200 + i) for i, s in enumerate(scores)])
    assert by_query[100] == [i for _, i in every[:3]] and all(i < 100 for i in by_query[0])
