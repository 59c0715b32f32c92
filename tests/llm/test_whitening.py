"""Whitening against numpy's eigendecomposition."""

import numpy as np
import pytest

from linework.llm import queries, whitening


def plain(vectors):
    """(x of usable vectors, n, S, eigenvalues falling, components, trace)."""
    x = np.floor(np.asarray(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = (n * u - s) / n
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    return x, n, s, values[::-1], axes[:, ::-1], np.trace(v)


def test_query_against_numpy(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    x, n, s, values, axes, trace = plain([r.embedding for r in rows])
    got = queries.op13_whitening(spark, small).toPandas().sort_values(["component", "vec_id"])
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    for k, part in got.groupby("component"):
        want = (n * x - s) / n @ axes[:, k - 1] / np.sqrt(values[k - 1])
        assert min(np.abs(part.whitened - want).max(), np.abs(part.whitened + want).max()) < 1e-8
        assert np.allclose(part.explained, values[k - 1] / trace, rtol=1e-10)
        assert (part.deviation.to_numpy() == ((n * x - s) ** 2).sum(1)).all()


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (5, 3), (12, 12), (40, 7), (64, 64)])
def test_factor_and_rotations(d, rank):
    rng = np.random.default_rng(d)
    b = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank)
    v = b @ b.T
    factor, order = whitening.pivoted_cholesky(v)
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-13)
    assert (np.diff(factor.diagonal()) <= 1e-12).all() and np.allclose(factor, np.tril(factor))
    values, axes = whitening.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9) and np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12)


def test_every_pair_once_a_sweep():
    for n in (2, 3, 8, 11):
        pairs = [(a, b) for p, q in whitening._rounds(n) for a, b in zip(p, q, strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]
        assert all(len(set(p) | set(q)) == 2 * len(p) for p, q in whitening._rounds(n))


NAN, INF = float("nan"), float("inf")


def test_odd_vectors(spark):
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.25, 3.0, 1.0]), (3, [1.0, -1.0, 0.0]), (3, [1.0, -1.0, 0.0]), (4, [1.001, -1.0, 0.001]), (None, [2.0, 2.0, 2.5]), (11, [-0.01, 0.0, 4.0])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [NAN, 1.0, 2.0]), (8, [1.0, INF, 2.0]), (9, []), (10, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in good + bad], "vec_id long, embedding array<double>, id string, x int")
    got = whitening.whiten(df).toPandas()
    x, n, s, values, axes, trace = plain([v for _, v in good])
    assert n == 5 and set(got.n) == {5} and len(got) == 3 * len(good) and sorted(got.component.unique()) == [1, 2, 3]
    assert sorted(got[got.component == 1].deviation) == sorted(((n * x - s) ** 2).sum(1))
    assert np.allclose(got.groupby("component").explained.first(), values / trace)
    whitened = got[(got.vec_id == 3)].groupby("component").whitened.nunique()
    assert (whitened == 1).all() and got.identity_error.max() < 1e-10


def test_no_spread_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []


def test_fewer_components_than_dimensions(spark):
    rows = [(k, [float(k), 2.0 * k, 1.0]) for k in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1.0) and np.isclose(got.whitened.var(ddof=0), 1.0)
    most = whitening.whiten(spark.createDataFrame([(k, [float(k % 3), float(k % 5), float(k % 7)]) for k in range(50)], "vec_id long, embedding array<double>"), most=2)
    assert most.select("component").distinct().count() == 2
