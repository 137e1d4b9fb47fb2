"""Whitening against a dense eigensolver over the whole covariance."""
import numpy as np
import pytest

from canopyframe.llm import whitening
from canopyframe.llm.queries import QUERIES

SHAPE = "vec_id long, embedding array<float>, x string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "c") for i, v in rows], SHAPE)


def brute(rows, k):
    ids = [i for i, _ in rows]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    fit = sorted({tuple(r) for r in x})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total)) for r in x]
    f = np.array(fit, dtype=float)
    c = f - f.mean(0)
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return ids, n, deviation, (x.astype(float) - f.mean(0)) @ q / np.sqrt(e), e / np.trace(c.T @ c / n)


def agrees(out, rows, k):
    ids, n, deviation, white, explained = brute(rows, k)
    assert len(out) == len(rows) * k and {r.n for r in out} == {n} and all(r.identity_error <= 1e-4 for r in out)
    want = sorted((i is None, i or 0, d) for i, d in zip(ids, deviation))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in out if r.component == 1) == want
    for j in range(k):
        mine = [r for r in out if r.component == j + 1]
        assert np.allclose([r.explained for r in mine], explained[j], rtol=1e-9)
        key = {(r.vec_id, r.deviation): r.whitened for r in mine}
        other = np.array([key[i, d] for i, d in zip(ids, deviation)])
        sign = np.sign(other @ white[:, j])
        assert np.allclose(other * sign, white[:, j], atol=1e-8)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    agrees(QUERIES["op12_embedding_whitening"](spark, folder).collect(), rows, 16)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.standard_normal(5) * [4, 3, 2, 1, 0.5]).tolist()) for i in range(40)]
    good += [(7, good[7][1]), (100, good[3][1]), (None, good[4][1]), (8, good[9][1])]  # repeated rows and vectors, one id on two vectors
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [1.0, 2.0, float("inf"), 0.0, 0.0]), (204, [1.0, 2.0]), (205, []), (206, [1e30] * 5)]
    agrees(whitening.whiten(frame(spark, good + bad)).collect(), good, 5)
    flat = [(i, [1.0, float(i), 2.0]) for i in range(6)]
    assert {r.component for r in whitening.whiten(frame(spark, flat)).collect()} == {1}
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [(1, []), (2, None)])).collect() == []


def test_exact_deviation_beyond_a_long():
    c = whitening.Centre(3, np.array([10, 10]), np.array([1, 2]))
    assert c.deviation(np.array([[12, 9], [4_000_000_010, 10]])) == [(6 - 1) ** 2 + (-3 - 2) ** 2, None]


@pytest.mark.parametrize("d, k, most", [(60, 16, None), (200, 6, 20), (5, 16, None)])
def test_solver_with_restarts(d, k, most):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, 2 * d)) * rng.random(2 * d)
    v = a @ a.T
    values, axes = whitening.jacobi_davidson(lambda y: v @ y, d, k, most=most)
    want = np.linalg.eigvalsh(v)[::-1][: min(k, d)]
    assert np.allclose(values, want, rtol=1e-12) and np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-13
    assert np.linalg.norm(v @ axes - axes * values, axis=0).max() < 1e-12 * want[0]


def test_minres_solves_a_shifted_system():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((12, 12))
    a, b = a + a.T, rng.standard_normal((12, 3))
    assert np.allclose(a @ whitening.minres(lambda y: a @ y, b, 14), b, atol=1e-6)
