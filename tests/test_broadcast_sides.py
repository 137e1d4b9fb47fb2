"""Rows must never be the side of a join that is broadcast, however small their files look."""
from pyspark.sql import functions as F


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def exploded(spark, path, times=50):
    """A small file whose rows are multiplied after they are read."""
    spark.range(0, 2000, 1, 2).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v")).write.parquet(path)
    return spark.read.parquet(path).withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(times))))


def test_ranked_rows_stay_in_place(spark, tmp_path):
    from canopyframe.operators.ranks import sorted_index
    df = exploded(spark, f"{tmp_path}/rows")
    got = sorted_index(df, ["k", "c"], "v", "i")
    assert "BuildLeft" not in physical(got)
    top = {(r.k, r.c): (r.n, r.hi) for r in got.groupBy("k", "c").agg(F.count_distinct("i").alias("n"), F.max("i").alias("hi")).collect()}
    assert len(top) == 350 and all(n == hi + 1 for n, hi in top.values()) and sum(n for n, _ in top.values()) == 100_000


def test_rows_without_a_key_have_no_rank(spark):
    from canopyframe.operators.ranks import sorted_index
    nan = float("nan")
    df = spark.createDataFrame([(None, 1.0), (2.0, 5.0), (2.0, 3.0), (nan, 4.0), (nan, 2.0)], "k double, v double")
    got = sorted(str((r.k, r.v, r.i, r.i_n)) for r in sorted_index(df, ["k"], "v", "i").collect())
    assert got == sorted(map(str, [(2.0, 3.0, 0, 2), (2.0, 5.0, 1, 2), (nan, 2.0, 0, 2), (nan, 4.0, 1, 2)])), got


def test_copies_of_a_self_join_are_not_broadcast(spark, tmp_path, monkeypatch):
    from canopyframe.operators import subsets
    plans, join = [], subsets.grid_join

    def seen(*args, **more):
        plans.append(physical(out := join(*args, **more)))
        return out

    monkeypatch.setattr(subsets, "grid_join", seen)
    rows = spark.range(600).selectExpr("id % 3 as stand", "id as det_id", "id % 2 as view_id", "cast(id % 20 as double) as x", "cast(id % 29 as double) as y", "id % 11 as n_pts")
    kept, views = subsets.suppress_subsets(rows, "det_id", "n_pts", "view_id", 1.5)
    refs = rows.where("view_id = 0").selectExpr("stand", "det_id as rid", "x as rx", "y as ry")
    assert subsets.matched_by_subset(refs, kept.withColumnRenamed("det_id", "did"), views, 1.5).count() > 0
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p for p in plans)


def test_zones_of_a_grid_join_are_not_broadcast(spark, tmp_path):
    from canopyframe.operators.spatial import grid_join
    zones = exploded(spark, f"{tmp_path}/zones").selectExpr("k", "c as zid", "v % 40 as cx", "v % 31 as cy")
    points = spark.range(40).selectExpr("id % 7 as k", "id as pid", "cast(id as double) as x", "cast(id % 31 as double) as y")
    got = grid_join(points, zones, 1.0, ["k"])
    assert "Broadcast" not in physical(got)
    plain = points.join(zones, "k").where("(x - cx) * (x - cx) + (y - cy) * (y - cy) <= 1")
    assert got.count() == plain.count() > 0


def test_rows_of_replicates_are_not_broadcast(spark, monkeypatch):
    from canopyframe.operators import panel as P, resampling
    plots = spark.createDataFrame([(i, i % 4, float(i % 13), float(i * i % 17)) for i in range(60)], "plot long, stand int, x double, y double")
    for most in (resampling.LOCAL_BYTES, -1):  # drawn in tasks, and by joins
        monkeypatch.setattr(resampling, "LOCAL_BYTES", most)
        perm = P.permuted(plots, "plot", "y", 30, 6, ["stand"])
        for df in (P.linear_oof(perm, "plot", ["x"], "y", "stand", by=["rep"]), P.centred(perm, "stand", ["y"], ["rep"])):
            joins = [line for line in physical(df).splitlines() if "BroadcastHashJoin" in line]
            assert not any("BuildLeft" in j and "rep" in j for j in joins), joins
            assert "SortMergeJoin [rep" in physical(df) and df.count() == 1800


def test_rows_of_a_fit_are_not_broadcast(spark, tmp_path):
    from canopyframe.operators.panel import linear_fit
    df = exploded(spark, f"{tmp_path}/fit").withColumn("y", 2 * F.col("v") + F.col("c"))
    got = linear_fit(df, ["v"], "y", ["k", "c"])
    assert "BuildLeft" not in physical(got)
    assert all(abs(r.b_1 - 2) < 1e-9 and abs(r.b_0 - r.c) < 1e-6 for r in got.collect())


def test_nearest_distances_are_joined_in_place(spark, tmp_path):
    from canopyframe.operators.spatial import nn_distance
    spark.range(3000).selectExpr("id % 3 as stand", "id", "cast(id % 61 as double) as x", "cast(id % 53 as double) as y").write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    got = nn_distance(points, "id", 4.0)
    assert not any("BroadcastHashJoin" in line for line in physical(got).splitlines()), physical(got)
    assert got.count() == 3000


def test_cache_has_no_file_per_key(spark, tmp_path, monkeypatch):
    from canopyframe.sources import sinks
    monkeypatch.setattr(sinks, "shared_folder", lambda spark: str(tmp_path))
    df = spark.range(0, 5000, 1, 2).selectExpr("id % 500 as plot", "id")
    back = sinks.write_and_read(df, "cache", by=["plot"])
    assert len(back.inputFiles()) == 2
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    for f in back.inputFiles():
        plots = [r.plot for r in spark.read.parquet(f).collect()]
        assert plots == sorted(plots)


def test_positions_of_disc_sums_are_not_broadcast(spark, tmp_path, monkeypatch):
    from canopyframe.operators import assign as A
    plans, join = [], A.grid_join

    def seen(*args, **more):
        plans.append(physical(out := join(*args, **more)))
        return out

    monkeypatch.setattr(A, "grid_join", seen)
    spots = exploded(spark, f"{tmp_path}/spots", 5).selectExpr("k as stand", "cast(v * 5 + c as long) as pid", "v % 40 + c / 7 as x", "v % 31 as y")
    cells = spark.range(4000).selectExpr("id % 7 as stand", "id % 160 as ix", "id % 124 as iy", "id % 5 + 1 as v").distinct()
    got = A.disc_sums(spots, cells, 1.0, 0.25)
    assert len(plans) == 1 and "Broadcast" not in plans[0]
    near = cells.selectExpr("stand", "(ix + 0.5) * 0.25 as cx", "(iy + 0.5) * 0.25 as cy", "v").join(spots, "stand").where("(cx - x) * (cx - x) + (cy - y) * (cy - y) <= 1")
    want = {r.pid: r.s for r in near.groupBy("pid").agg(F.sum("v").alias("s")).collect()}
    assert want and {r.pid: r.total for r in got.collect()} == {p.pid: want.get(p.pid, 0) for p in spots.collect()}
