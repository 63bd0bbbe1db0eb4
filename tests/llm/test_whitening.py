import numpy as np
import pytest

from clonelens.llm import whitening as wh

VECTORS = "vec_id bigint, embedding array<float>, label int, n int, `__row` string, length int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "r", 2) for i, v in rows], VECTORS)


def _run(spark, vectors):
    models = wh.fit_whitening(vectors)
    rows = wh.whiten(vectors, models).select("__row.vec_id", "length", "deviation", "whitened").collect()
    return models, rows


def _expected(vectors, k):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def test_against_dense_eigenvectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(700, 12)) * np.linspace(3, 0.1, 12)).astype(np.float32)
    given = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, base[:200], base[:1].repeat(300, axis=0)]))]
    models, rows = _run(spark, _table(spark, given).repartition(9))
    x, n, s, values, vectors, trace = _expected([v for _, v in given], 4)
    model = models[12]
    assert (model.n, model.sums) == (n, s.tolist())
    assert np.allclose(model.values, values, rtol=1e-12)
    assert abs(model.trace / trace - 1) < 1e-12 and model.identity_error < 1e-9
    signs = np.sign((vectors * model.directions).sum(axis=0))
    assert np.abs(model.directions - vectors * signs).max() < 1e-11
    want = (x - s / n) @ vectors * signs / np.sqrt(values)
    assert sorted(r.vec_id for r in rows) == list(range(len(given)))
    for r in rows:
        assert np.abs(np.array(r.whitened) - want[r.vec_id]).max() < 1e-9
        assert r.deviation == int(((n * x[r.vec_id] - s) ** 2).sum())


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    given = [
        (1, [0.5, -0.25, 1.0]), (2, [0.25, 0.0, -1.0]), (2, [0.25, 0.0, -1.0]), (None, [0.1, 0.2, 0.3]), (3, None),
        (4, [None, 1.0, 2.0]), (5, [nan, 1.0, 2.0]), (6, [inf, 1.0, 2.0]), (7, []), (8, [0.0, 0.0, 0.0]),
        (9, [1.0, 2.0]), (10, [2.0, 5.0]), (11, [3.0]),
    ]
    models, rows = _run(spark, _table(spark, given))
    found = sorted((r.vec_id or 0, r.length, len(r.whitened)) for r in rows)
    # three dimensions of four distinct rows, two rows on a line, one row without any spread
    assert found == [(0, 3, 3), (1, 3, 3), (2, 3, 3), (2, 3, 3), (8, 3, 3), (9, 2, 1), (10, 2, 1), (11, 1, 0)]
    assert models[3].n == 4 and models[2].n == 2
    assert all(m.identity_error < 1e-9 for m in models.values())


def test_empty_table(spark, tmp_path):
    vectors = _table(spark, [])
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = wh.op11_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0


def test_query_columns(spark, tmp_path):
    given = [(i, np.random.default_rng(i).normal(size=6).tolist()) for i in range(40)]
    _table(spark, given).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = wh.op11_whitening(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, c) for i in range(40) for c in range(1, 5)]
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    _, _, _, values, _, trace = _expected([v for _, v in given], 4)
    for r in rows:
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9


@pytest.mark.parametrize(
    "spectrum",
    [[5.0] * 6 + [1.0] * 10, [5, 5 * (1 - 1e-9), 5 * (1 - 1e-6), 4.9999] + [1.0] * 12, np.logspace(0, -14, 16), [1.0] * 16],
)
def test_close_and_graded_spectra(spectrum):
    rng = np.random.default_rng(5)
    k = len(spectrum)
    left, right = (np.linalg.qr(rng.normal(size=(k, k)))[0] for _ in range(2))
    r = left @ np.diag(spectrum) @ right.T
    values, vectors, trace = wh.leading(r, 4)
    exact = np.sort(np.array(spectrum, float))[::-1] ** 2
    assert np.allclose(values, exact[:4], rtol=1e-12) and abs(trace / exact.sum() - 1) < 1e-12
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() < 1e-13 * exact[0]
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_singular_values_of_many_small_matrices():
    rng = np.random.default_rng(6)
    for _ in range(300):
        r = rng.integers(-2, 3, size=(rng.integers(1, 14), rng.integers(1, 12))).astype(float)
        diagonal, superdiagonal, right = wh.bidiagonal(np.linalg.qr(r, mode="r"))
        found = np.sqrt(wh.squared_singular_values(diagonal, superdiagonal))
        exact = np.zeros(r.shape[1])
        single = np.linalg.svd(r, compute_uv=False)
        exact[: len(single)] = single
        assert np.abs(found - exact).max() <= 1e-7 * max(1.0, exact[0])
        assert np.abs(right.T @ right - np.eye(r.shape[1])).max() < 1e-13


def test_large_integers_stay_exact():
    x = np.array([[1 << 40, -(1 << 41)], [3, 5]])
    n, sums = 1 << 30, [1 << 50, 7]
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert wh.squared_deviation(x, n, sums) == [w if w < 1 << 63 else None for w in want]
