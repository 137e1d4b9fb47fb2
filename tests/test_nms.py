"""Suppression in blocks against the sequential rule."""
import numpy as np
import pytest

from canopyframe.operators.nms import nms


def plain(rows, r):
    kept = []
    for k in {p[0] for p in rows}:
        got = []
        for p in sorted((p for p in rows if p[0] == k), key=lambda p: (-p[4], p[1])):
            if all((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 > r * r for q in got):
                got.append(p)
        kept += [(p[0], p[1]) for p in got]
    return sorted(kept)


def run(spark, rows, r, **more):
    df = spark.createDataFrame(rows, "stand int, did long, x double, y double, w double").repartition(3)
    return sorted(map(tuple, nms(df, "did", "w", r, **more).collect()))


@pytest.mark.parametrize("crowd", [64, 2])
def test_equals_the_sequential_rule(spark, crowd):
    rng = np.random.default_rng(6)
    rows = [(int(i % 2), i, float(x), float(y), float(w)) for i, (x, y, w) in enumerate(zip(rng.normal(0, 9, 260), rng.normal(0, 9, 260), rng.integers(1, 40, 260)))]
    assert run(spark, rows, 1.5, crowd=crowd) == plain(rows, 1.5)


def test_a_long_chain_takes_few_rounds(spark):
    """2000 rows of falling weight, each suppressing the next; blocks hold 16 radii, so a round settles 20 links and a chain crosses many blocks."""
    n = 300
    rows = [(0, i, i * 0.8, 0.0, float(n - i)) for i in range(n)]
    assert run(spark, rows, 1.0) == plain(rows, 1.0)
    loop = [(0, i, float(3 * np.cos(i / 9)), float(3 * np.sin(i / 9)), float(2000 - i)) for i in range(2000)]  # inside a block any length is one round
    assert run(spark, loop, 1.0) == plain(loop, 1.0)


def test_copies_on_one_spot(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, 5.0, 5.0, 7.0) for i in range(400)] + [(0, 400 + i, float(4 + 2 * a), float(4 + 2 * b), float(w)) for i, (a, b, w) in enumerate(rng.random((40, 3)) * (1, 1, 14))]
    assert run(spark, rows, 0.8, crowd=5) == plain(rows, 0.8)
    assert run(spark, [], 1.0) == []


@pytest.mark.parametrize("most", [1 << 21, 500, 3])
def test_blocks_settled_together_equal_the_loop(monkeypatch, most):
    """Many blocks are decided by array operations; the loop over rows is left for walls and very crowded blocks."""
    from canopyframe.operators import nms as N
    monkeypatch.setattr(N, "PAIRS", most)
    rng, n, calls, loop = np.random.default_rng(11), 1500, [], N.settle
    r = np.array([1.3, 0.7, 2.0, 1.3])[g := rng.integers(0, 4, n)]
    x, y, w, own, ids = rng.random(n) * 25, rng.random(n) * 20, rng.integers(1, 30, n).astype(float), rng.random(n) < 0.8, rng.permutation(n)
    bx, by, state = np.floor(x / (r * N.BLOCK)).astype(int), np.floor(y / (r * N.BLOCK)).astype(int), np.full(n, N.WAITS)
    block = np.unique(np.stack([g, bx, by]), axis=1, return_inverse=True)[1].ravel()
    each = np.full(n, -1)
    monkeypatch.setattr(N, "settle", lambda *a: calls.append(1) or loop(*a))
    for held in (own, np.ones(n, dtype=bool)):  # a first round; then what is settled is known
        together = N.settle_blocks(block, x, y, w, ids, r, bx, by, state, held, {})
        for b in np.unique(block):
            m = block == b
            each[m] = loop(x[m], y[m], w[m], ids[m], float(r[m][0]), state[m], held[m], [])
        assert (together == each).all() and (together[~held] != N.KEPT).all()
        state = together
    assert (state != N.WAITS).all() and bool(calls) == (most < 1 << 21)


def test_keys_are_matched_without_joined_components(spark, monkeypatch):
    """A stand's components are found in its task; joins of edges are left for keys too large for one."""
    from canopyframe.operators import matching as M
    rng = np.random.default_rng(4)
    ref = spark.createDataFrame([(int(i % 3), i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((120, 2)) * 20)], "stand int, rid long, rx double, ry double")
    det = spark.createDataFrame([(int(i % 3), i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((150, 2)) * 20)], "stand int, did long, x double, y double")
    calls, joined = [], M.components
    monkeypatch.setattr(M, "components", lambda *a: calls.append(1) or joined(*a))
    got = {}
    for most in (M.KEY_EDGES if hasattr(M, "KEY_EDGES") else 0, 0):
        monkeypatch.setattr(M, "KEY_EDGES", most, raising=False)
        got[most] = sorted((r.stand, r.rid, r.did) for r in M.match(ref, det, 2.5).collect())
        assert len(calls) == (most == 0)
    assert len(got) == 2 and len(set(map(str, got.values()))) == 1 and len(got[0]) > 60
