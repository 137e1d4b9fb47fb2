"""Replicates and sampled circles of small tables against those of large ones and against plain draws."""
import numpy as np
from pyspark.sql import functions as F

from canopyframe.functions.hashing import mix
from canopyframe.operators import panel as P, resampling, stems


def mixed(*parts):
    return int(resampling.mix(*[np.array([p]) for p in parts])[0])


def frame(spark, n=23):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i * 7, i % 4, float(v), float(w)) for i, (v, w) in enumerate(rng.random((n, 2)))], "plot long, stand int, y double, pred double")


def rows(df, *c):
    return sorted(map(tuple, df.select(*c).collect()))


def test_mix_equals_the_column(spark):
    df = spark.createDataFrame([(3, 11, 5, 42), (2147483650, 7, 0, 1), (9, 123456789012, 2, 3)], "a long, b long, c long, d long")
    for r in df.select("*", mix("a", "b", "c", "d").alias("m")).collect():
        assert r.m == mixed(r.a, r.b, r.c, r.d)


def test_small_and_large_tables_draw_alike(spark, monkeypatch):
    df = frame(spark)
    calls = {
        "boot": lambda: rows(P.bootstrap(df, "plot", 40, 7, ["y", "pred"]), "rep", "w", "y", "pred"),
        "by": lambda: rows(P.bootstrap(df, "plot", 20, 7, ["y"], ["stand"]), "stand", "rep", "w", "y"),
        "perm": lambda: rows(P.permuted(df, "plot", "y", 30, 5), "rep", "plot", "stand", "y", "pred"),
        "within": lambda: rows(P.permuted(df, "plot", "y", 30, 5, ["stand"]), "rep", "plot", "stand", "y", "pred"),
    }
    small = {k: f() for k, f in calls.items()}
    monkeypatch.setattr(resampling, "LOCAL_BYTES", -1)
    assert small == {k: f() for k, f in calls.items()}
    n = df.count()
    assert all(sum(w for r, w, *_ in small["boot"] if r == rep) == n for rep in range(40))
    by_plot = {r.plot: r for r in df.collect()}
    for rep in range(3):
        drawn = [sorted(by_plot)[mixed(rep, s, 7) % n] for s in range(n)]
        assert sorted((drawn.count(k), by_plot[k].y, by_plot[k].pred) for k in set(drawn)) == sorted(r[1:] for r in small["boot"] if r[0] == rep)
        for stand in range(4):
            mine = {p: y for r, p, s, y, _ in small["within"] if r == rep and s == stand}
            assert sorted(mine.values()) == sorted(by_plot[p].y for p in mine)


def test_circles_of_small_and_large_slices(spark):
    rng = np.random.default_rng(9)
    pts = []
    for k, (n, noise) in enumerate(((40, 0.3), (7, 0.0), (2, 0.0), (300, 0.5))):
        for i in range(n):
            a, far = rng.random() * 6.3, rng.random() < noise
            r = 0.2 + (rng.random() * 0.5 if far else 0.003 * rng.standard_normal())
            pts.append((k, i, float(5 + r * np.cos(a)), float(3 + r * np.sin(a))))
    df = spark.createDataFrame(pts, "k int, pid long, x double, y double")
    a, b = (sorted(tuple(r) for r in stems.circle_ransac(df, ["k"], "pid", 300, slice_points=s).select("k", "inliers", F.round("cx", 9), F.round("cy", 9), F.round("r", 9)).collect()) for s in (4096, 0))
    assert a == b and {r[0] for r in a} >= {0, 1, 3}
    assert all(abs(r[4] - 0.2) < 0.01 for r in a if r[0] in (0, 1, 3))
    line = spark.createDataFrame([(0, i, float(i), 0.0) for i in range(6)], "k int, pid long, x double, y double")
    assert stems.best_circles(line.withColumns({"i": F.col("pid"), "i_n": F.lit(6).cast("long")}), ["k"], 50, 0.02, 1.0, 42).collect() == []
