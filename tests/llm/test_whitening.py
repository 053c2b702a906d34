"""Bidiagonal qd whitening: the solver's parts, and rows against exact sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import queries, whitening


def matrices():
    rng = np.random.default_rng(3)
    yield rng.normal(size=(20, 20))
    yield np.diag([5.0, 5.0, 5.0, 1.0, 0.0])
    yield np.zeros((4, 4))
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    yield np.diag([3.0] * 4 + [2.0, 2.0 + 1e-13, 2.0 - 1e-13] + [1e-3, 1e-6, 1e-9, 1e-9, 0]) @ q
    yield rng.normal(size=(6, 1)) @ rng.normal(size=(1, 6))
    yield np.array([[7.0]])


@pytest.mark.parametrize("a", matrices())
def test_solver_gives_orthonormal_vectors_and_all_values(a):
    d = a.shape[1]
    r = np.linalg.qr(a, mode="r")
    diag, off, v = whitening.bidiagonal(r)
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13 and (diag >= 0).all() and (off >= 0).all()
    b = np.diag(diag) + np.diag(off, 1)
    top = max(np.linalg.norm(a, 2), 1e-300)
    assert np.abs(v @ b.T @ b @ v.T - a.T @ a).max() <= 1e-13 * top**2
    values = whitening.singular_values(diag, off)
    assert np.abs(values - np.linalg.svd(a, compute_uv=False)).max() <= 1e-13 * top
    kept = values[values > 1e-8 * top]
    w = v @ whitening.right_vectors(diag, off, kept)
    assert np.abs(w.T @ w - np.eye(len(kept))).max(initial=0) < 1e-10
    assert np.abs(a.T @ (a @ w) - w * kept**2).max(initial=0) <= 1e-11 * top**2


def test_small_values_keep_relative_accuracy():
    """det B = product of its diagonal, whatever the couplings; and both ends
    give the same values to the last digits though they span 10**24."""
    rng = np.random.default_rng(1)
    for n in (2, 5, 30):
        diag = 10.0 ** rng.uniform(-12, 0, n)
        off = 10.0 ** rng.uniform(-12, 0, n - 1)
        values = whitening.singular_values(diag, off)
        assert np.allclose(values, whitening.singular_values(diag[::-1], off[::-1]), rtol=1e-13, atol=0)
        assert math.isclose(np.log(values).sum(), np.log(diag).sum(), rel_tol=1e-13)


def wilkinson(n):
    """Pairs of eigenvalues that agree to working precision, nothing splits."""
    t = np.diag(np.abs(np.arange(n) - (n - 1) / 2) + n) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    return np.linalg.cholesky(t).T


def test_near_pairs_get_orthogonal_vectors():
    a = wilkinson(21)
    diag, off, v = whitening.bidiagonal(a)
    values = whitening.singular_values(diag, off)
    w = v @ whitening.right_vectors(diag, off, values)
    assert np.abs(w.T @ w - np.eye(21)).max() < 1e-9
    assert np.abs(a.T @ a @ w - w * values**2).max() < 1e-9


def exact(vectors):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    return n, [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x], np.array([[(n * c - t) / n for c, t in zip(v, s, strict=True)] for v in x])


def check(got, rows, k):
    n, deviation, y = exact([v for _, v in rows])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(rows) * k and {r["n"] for r in got} == {n}
    at = {i: j for j, (i, _) in enumerate(rows)}
    sign = {}
    for r in got:
        j, c = at[r["vec_id"]], r["component"] - 1
        want = y[j] @ vectors[:, c] / math.sqrt(values[c])
        if abs(want) > 1e-3:
            sign.setdefault(c, np.sign(want * r["whitened"]))
        assert r["deviation"] == deviation[j]
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-7 and (abs(want) < 1e-3 or np.sign(want * r["whitened"]) == sign[c])
        assert math.isclose(r["explained"], values[c] / values.sum(), rel_tol=1e-9)
        assert 0 <= r["identity_error"] < 1e-9


def test_rows_that_do_not_count_are_left_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [3, 2, 1, 0.5, 0.2]]) for i in range(80)]
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [1.0, math.nan, 0.0, 0.0, 0.0]), (903, [math.inf, 0.0, 0.0, 0.0, 0.0]), (904, []), (905, [1.0] * 4), (906, [1e200, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + odd], "vec_id bigint, embedding array<double>, n string, component int").repartition(7)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), rows, 5)
    model = whitening.fit(df.repartition(40))  # more triangles than one task combines
    w = np.array([model.whitened(np.array([[math.floor(64 * c) + 1_000_000 for c in v]], dtype=np.int64))[0] for _, v in rows])
    assert np.abs(w.T @ w / len(rows) - np.eye(5)).max() < 1e-9


def test_empty_constant_and_repeated_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0])], schema)).collect()
    assert len(got) == 3 and {r["component"] for r in got} == {1} and {r["explained"] for r in got} == {1.0}
    assert sorted(r["deviation"] for r in got) == [64**2, 64**2, 128**2]


def test_sums_of_any_size_are_exact():
    n = 10**12 + 7
    model = whitening.Model(n, (3 * 10**20 + 11, -5), np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[300_000_001, 4], [2**45, -(2**45)]], dtype=np.int64)
    assert model.deviations(x) == [sum((n * int(c) - s) ** 2 for c, s in zip(v, model.sums, strict=True)) for v in x]


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.QUERIES["op12_embedding_whitening"](spark, sf).filter(F.col("component") > 0).collect(), rows, 32)
