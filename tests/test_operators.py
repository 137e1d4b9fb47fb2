"""Planted answers and brute-force twins of the operators."""
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import crowns, matching, panel, polygons, ranks, raster, spatial, stems
from canopyframe.operators.nms import nms
from canopyframe.sources import readers
from canopyframe.streaming import sessions


def cloud(seed, n, stands=2, size=20.0, copies=0):
    g = np.random.default_rng(seed)
    d = pd.DataFrame({"stand": g.integers(1, stands + 1, n), "x": g.uniform(0, size, n), "y": g.uniform(0, size, n), "w": g.integers(1, 5, n)})
    if copies:
        d = pd.concat([d, pd.DataFrame({"stand": 1, "x": 3.3, "y": 4.4, "w": g.integers(1, 5, copies)})], ignore_index=True)
    d["id"] = np.arange(len(d))
    return d


def test_quantiles_with_a_hot_key(spark):
    g = np.random.default_rng(0)
    d = pd.DataFrame({"k": np.r_[np.zeros(20000, int), np.ones(7, int)], "v": np.r_[g.normal(size=15000), np.full(5000, 0.25), g.normal(size=7)]})
    out = ranks.exact_quantiles(spark.createDataFrame(d), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).toPandas().set_index("k")
    for k, s in d.groupby("k").v:
        assert np.allclose(out.loc[k, ["a", "b", "c"]].to_numpy(float), np.quantile(s, [0.1, 0.5, 0.99]), atol=1e-12)


def test_index_and_ranks(spark):
    d = pd.DataFrame({"k": [1] * 9000 + [2] * 5, "v": np.r_[np.random.default_rng(1).permutation(9000), [3, 3, 1, 2, 3]].astype(float)})
    i = ranks.sorted_index(spark.createDataFrame(d), ["k"], "v", "i").toPandas()
    one = i[i.k == 1]
    assert (one.i == one.v).all()
    r = ranks.average_rank(spark.createDataFrame(d[d.k == 2]), ["k"], "v", "r").toPandas()
    assert sorted(r.r) == [1, 2, 4, 4, 4]


def test_nearest_neighbours_match_brute_force(spark):
    d = cloud(2, 150, copies=30)
    nn = spatial.nn_distance(spark.createDataFrame(d), "id", 1.0).toPandas().set_index("id").nn
    kn = spatial.self_neighbours(spark.createDataFrame(d), "id", 3, 1.0).toPandas()
    for s, g in d.groupby("stand"):
        m = np.hypot(g.x.to_numpy()[:, None] - g.x.to_numpy(), g.y.to_numpy()[:, None] - g.y.to_numpy())
        np.fill_diagonal(m, np.inf)
        assert np.allclose(nn.loc[g.id].to_numpy(), m.min(1))
        got = kn[kn.id.isin(g.id)].sort_values(["id", "rank"]).d2.to_numpy().reshape(-1, 3)
        assert np.allclose(np.sqrt(got), np.sort(m, 1)[:, :3])


@pytest.mark.parametrize("radius", [0.7, 2.0])
def test_merge_equals_the_sequential_rule(spark, radius):
    d = cloud(3, 400, copies=200)
    got = set(nms(spark.createDataFrame(d), "id", "w", radius).toPandas().id)
    want = set()
    for _, g in d.groupby("stand"):
        kept = []
        for r in g.sort_values(["w", "id"], ascending=[False, True]).itertuples():
            if all((r.x - a) ** 2 + (r.y - b) ** 2 > radius ** 2 for a, b in kept):
                kept.append((r.x, r.y))
                want.add(r.id)
    assert got == want


def test_matching_is_optimal(spark):
    g = np.random.default_rng(4)
    for n, m in ((4, 5), (6, 4), (6, 6)):
        d = g.uniform(0, 2, (n, m))
        left, right = np.nonzero(d < 1.2)
        e = matching.solve_component(left, right, d[left, right])
        best = (0, 0.0)
        small, large = (d, m) if n <= m else (d.T, n)
        for p in permutations(range(large), small.shape[0]):
            c = [small[i, j] for i, j in enumerate(p) if small[i, j] < 1.2]
            best = max(best, (len(c), -sum(c)))
        assert len(e) == best[0] and np.isclose(d[left, right][e].sum(), -best[1])


def test_matching_over_components(spark):
    d = cloud(5, 120, size=15.0)
    ref = spark.createDataFrame(d).select("stand", F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pred = spark.createDataFrame(d.assign(x=d.x + 0.05)).select("stand", F.col("id").alias("did"), "x", "y")
    got = matching.match(ref, pred, 1.0).toPandas()
    assert len(got) == 120 and got.rid.is_unique and got.did.is_unique and (got.d <= 1.0).all()
    assert got.d.sum() <= 120 * 0.05 + 1e-9


def test_greedy_order_rule(spark):
    c = pd.DataFrame({"o": [1, 1, 2, 2, 3], "t": [10, 11, 10, 11, 11], "d": [0.2, 0.5, 0.1, 0.9, 0.1]})
    got = matching.greedy_in_order(spark.createDataFrame(c), "o", "t", "d").toPandas()
    assert set(zip(got.o, got.t)) == {(1, 10), (2, 11)}


def test_hulls_and_circle(spark):
    g = np.random.default_rng(6)
    cube = np.array([[a, b, c] for a in (0, 2) for b in (0, 3) for c in (0, 4)], float)
    assert np.isclose(crowns.hull3(np.vstack([cube, g.uniform(0.1, 1.9, (50, 3))]))[1], 24)
    assert np.isnan(crowns.hull3(np.c_[g.uniform(size=(9, 2)), np.zeros(9)])[1])
    pts = g.normal(size=(300, 2))
    x, y, r = crowns.enclosing_circle(pts)
    d = np.hypot(pts[:, 0] - x, pts[:, 1] - y)
    assert d.max() <= r + 1e-9 and (d > r - 1e-6).sum() >= 2
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": np.r_[0.0, 4, 4, 0, g.uniform(0.1, 3.9, 500)], "y": np.r_[0.0, 0, 5, 5, g.uniform(0.1, 4.9, 500)]}))
    assert np.isclose(crowns.hull_area(df, ["k"]).first().area, 20)


def circle(n, r, a0=0.0, a1=2 * np.pi, noise=0.0, seed=7):
    t = np.linspace(a0, a1, n, endpoint=False)
    e = np.random.default_rng(seed).normal(0, noise, n)
    return pd.DataFrame({"k": 1, "pid": np.arange(n), "x": 50 + (r + e) * np.cos(t), "y": 70 + (r + e) * np.sin(t)})


def test_circle_fits_recover_the_circle(spark):
    d = spark.createDataFrame(circle(60, 0.12, 0, 4.0))
    for f in (stems.circle_kasa(d, ["k"]), stems.circle_taubin(d, ["k"]), stems.refine_circle(d, stems.circle_kasa(d, ["k"]), ["k"])):
        f = f.first()
        assert np.allclose([f.cx, f.cy, f.r], [50, 70, 0.12], atol=1e-7)
    noisy = pd.concat([circle(60, 0.12, noise=0.002), pd.DataFrame({"k": 1, "pid": range(60, 75), "x": np.linspace(50.2, 50.5, 15), "y": 70.3})])
    f = stems.circle_ransac(spark.createDataFrame(noisy), ["k"], "pid", 60).first()
    assert abs(f.r - 0.12) < 0.004


def test_coverage_and_ellipse(spark):
    full, half = circle(72, 0.2), circle(72, 0.2, 0, np.pi)
    assert abs(stems.angular_coverage(spark.createDataFrame(full), ["k"]).first().coverage - 355) < 1e-6
    assert stems.angular_coverage(spark.createDataFrame(half), ["k"]).first().coverage < 300
    t = np.linspace(0, 2 * np.pi, 80, endpoint=False)
    e = pd.DataFrame({"k": 1, "x": 9 + 0.3 * np.cos(t), "y": 4 + 0.1 * np.sin(t)})
    f = stems.ellipse(spark.createDataFrame(e), ["k"]).first()
    assert np.allclose([f.cx, f.cy, f.a, f.b], [9, 4, 0.3, 0.1], atol=1e-6)


def test_polygon_and_setback(spark):
    e = pd.DataFrame({"stand": 1, "ring": 0, "seq": range(4), "x1": [0.0, 10, 10, 0], "y1": [0.0, 0, 10, 10], "x2": [10.0, 10, 0, 0], "y2": [0.0, 10, 10, 0]})
    p = pd.DataFrame({"stand": 1, "id": range(3), "x": [5.0, 11, 1], "y": [5.0, 5, 9]})
    e, p = spark.createDataFrame(e), spark.createDataFrame(p)
    assert [r.inside for r in polygons.inside(p, e).orderBy("id").collect()] == [True, False, True]
    assert [r.edge_m for r in polygons.boundary_distance(p, e).orderBy("id").collect()] == [5, 1, 1]
    assert [r.id for r in polygons.within_setback(p, e, 2.0).collect()] == [0]


def test_linear_folds_match_refits(spark):
    g = np.random.default_rng(8)
    d = pd.DataFrame({"row": range(40), "g": np.arange(40) % 5, "a": g.normal(5, 1, 40), "b": g.normal(1, 2, 40)})
    d["y"] = 2 + d.a - 0.5 * d.b + g.normal(0, 0.3, 40)
    got = panel.linear_oof(spark.createDataFrame(d), "row", ["a", "b"], "y", "g").toPandas().set_index("row").pred
    for v in range(5):
        tr, te = d[d.g != v], d[d.g == v]
        c = np.linalg.lstsq(np.c_[np.ones(len(tr)), tr.a, tr.b], tr.y, rcond=None)[0]
        assert np.allclose(got.loc[te.row], np.c_[np.ones(len(te)), te.a, te.b] @ c)


def test_permutation_keeps_values_and_groups(spark):
    d = pd.DataFrame({"row": range(30), "g": np.arange(30) % 3, "y": np.arange(30.0)})
    p = panel.permuted(spark.createDataFrame(d), "row", "y", 4, 1, ["g"]).toPandas()
    for (_, g), s in p.groupby(["rep", "g"]).y:
        assert sorted(s) == sorted(d[d.g == g].y)


def sequential(d, fraction=0.3, lo=1.0, hi=2.0):
    kept = []
    for _, s in d.groupby("stand"):
        pool, have = [], []
        for _, t in s.groupby("tile_seq"):
            m = np.hypot(t.x.to_numpy()[:, None] - t.x.to_numpy(), t.y.to_numpy()[:, None] - t.y.to_numpy())
            np.fill_diagonal(m, np.inf)
            pool += list(m.min(1)) if len(t) > 1 else []
            r = np.clip(fraction * np.median(pool), lo, hi) if pool else 1.5
            for q in t.sort_values(["size", "det_id"], ascending=[False, True]).itertuples():
                if all(np.hypot(q.x - a, q.y - b) > r for a, b in have):
                    have.append((q.x, q.y))
                    kept.append(q.det_id)
    return set(kept)


def test_streaming_merge_is_causal(spark, tmp_path):
    d = cloud(9, 240, size=25.0).rename(columns={"id": "det_id", "w": "size"})
    d["tile_seq"] = (d.det_id // 60).astype("int32")
    d["stand"] = d.stand.astype("int32")
    schema = "det_id long, stand int, tile_seq int, x double, y double, size long"
    for t in range(4):  # one file per tile number, in arrival order
        spark.createDataFrame(d[d.tile_seq == t][["det_id", "stand", "tile_seq", "x", "y", "size"]], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"t={t}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {r.det_id for r in sessions.run_available(sessions.merge_stream(s, fraction=0.3), "t").collect()}
    assert got == sequential(d)


def test_watershed_merging_depth(spark):
    # two peaks of heights 10 and 9 with a saddle at 8.5
    z = [6, 10, 8.5, 9, 6]
    p = spark.createDataFrame(pd.DataFrame({"stand": 1, "x": np.arange(5.0), "y": 0.0, "z": np.array(z, float)}))
    c = raster.basins(raster.rasterise(p, 1.0), sigma=None)
    d = raster.merge_depths(c)
    assert sorted(r.h for r in raster.crowns(c, d, None, 1.0).collect()) == [9, 10]
    assert [r.h for r in raster.crowns(c, d, 0.6, 1.0).collect()] == [10]
    assert len(raster.crowns(c, d, 0.4, 1.0).collect()) == 2


def test_guards_fail_loudly(spark):
    d = spark.createDataFrame(pd.DataFrame({"k": [1, 2], "v": [1.0, float("nan")]}))
    with pytest.raises(ValueError):
        readers.assert_finite(d, ["v"])
    with pytest.raises(ValueError):
        readers.require_columns(d, ["nope"])
    a = spark.createDataFrame(pd.DataFrame({"k": [1, 2], "t": [1.0, 2.0]}))
    with pytest.raises(ValueError):
        readers.reconcile(a, a.where("k = 1"), ["k"], "t")
    with pytest.raises(ValueError):
        readers.reconcile(a, a.withColumn("t", F.col("t") + 1), ["k"], "t")
