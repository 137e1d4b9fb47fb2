"""Cases that once lost rows or ended a job."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyframe.functions.hashing import mix, normal
from canopyframe.operators import crowns, panel
from canopyframe.plans import QUERIES
from canopyframe.sources import readers
from canopyframe.streaming import sessions


def test_distillation_of_split_tiles(spark, tmp_path):
    g = pd.DataFrame({"tile": ["a"] * 6 + ["b"] * 3, "inst": [1, 1, 1, 2, 2, -1, 1, 1, 1], "x": [float(i) for i in range(9)], "y": [2.0 * i for i in range(9)], "z": [1.0, 5, 2, 3, 4, 9, 7, 8, 6]})
    whole = spark.createDataFrame(g)
    for i in range(3):  # each file holds a part of every tile
        whole.where(F.pmod(F.col("x").cast("int"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/points.parquet")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/points.parquet")
    got = sessions.distil_stream(stream, "mend").toPandas().sort_values(["tile", "inst"])
    want = readers.distil(whole).toPandas().sort_values(["tile", "inst"])
    pd.testing.assert_frame_equal(got[want.columns].reset_index(drop=True), want.reset_index(drop=True), check_dtype=False)


def test_streams_read_folder_tables(spark, tmp_path):
    for name in ("lineitem", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("k04_incremental_distillation", "k02_streaming_merge"):
        assert QUERIES[name](spark, str(tmp_path)).count() == QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_thin_groups_give_nulls(spark):
    d = spark.createDataFrame([("one", 1, 1.0, 2.0, 5.0), ("flat", 2, 3.0, 1.0, 4.0), ("flat", 3, 3.0, 2.0, 5.0), ("flat", 4, 3.0, 4.0, 9.0)]
                              + [("good", 5 + i, float(i), float(i * i % 7), 2.0 * i + 1) for i in range(8)], "g string, row long, x double, w double, y double")
    fit = {r.g: r for r in panel.linear_fit(d, ["x"], "y", ["g"]).collect()}
    assert fit["one"].b_1 is None and fit["flat"].b_1 is None
    assert fit["good"].b_1 == pytest.approx(2) and fit["good"].b_0 == pytest.approx(1)
    oof = panel.linear_oof(d, "row", ["x"], "y", by=["g"]).collect()
    assert len(oof) == 12 and all(r.pred == pytest.approx(r.y) for r in oof if r.g == "good")
    twin = d.withColumn("x2", F.col("x") * 2)
    assert all(r.b_2 is None for r in panel.linear_fit(twin, ["x", "x2"], "y", ["g"]).collect() if r.g != "good")
    eff = panel.efficiency(d.withColumn("pred", F.col("y")), ["g"]).collect()
    assert all(r.re is None for r in eff)


def test_hash_uses_every_part(spark):
    d = spark.range(3).select(F.lit(1).alias("a"), F.col("id").alias("e"))
    assert d.select(mix("a", "a", "a", "a", "e").alias("h")).distinct().count() == 3
    assert d.select(normal("a", "a", "a", "e").alias("h")).distinct().count() == 3


def test_charset_of_the_whole_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name;v\nplain;1\nJoão;2\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("name;v\nplain;1\nJoão;2\n".encode())
    for f in "ab":
        assert readers.read_delimited(spark, f"{tmp_path}/{f}.csv").where("v = 2").first()["name"] == "João"


def test_enclosing_circle_of_many_points():
    import numpy as np
    t = np.linspace(0, 2 * np.pi, 400)
    x, y, r = crowns.enclosing_circle(np.c_[3 + 2 * np.cos(t), 1 + 2 * np.sin(t)])
    assert (x, y, r) == pytest.approx((3, 1, 2), abs=1e-6)


def test_rings_with_equal_shares_keep_the_smaller(spark):
    """15 points of ring 7 and 17 of ring 8 are one a unit of width each; the tie goes to the smaller ring."""
    from canopyframe.operators.stems import radial_mode
    rows = [(1, (k + 0.5) * 0.005, 0.0) for k, c in ((7, 15), (8, 17), (10, 21)) for _ in range(c)]
    got = radial_mode(spark.createDataFrame(rows, "inst int, u double, v double"), ["inst"]).first()
    assert got.r == pytest.approx(0.0375) and got.density == pytest.approx(1 / (3.141592653589793 * 0.005 ** 2))


def test_distances_and_their_limit_come_from_one_pass(spark):
    from canopyframe.operators.transforms import radial_filter
    rows = [(i % 2, i, float(i * 37 % 101) / 7, float(i * 53 % 97) / 3) for i in range(202)]  # 101 a key: the limit is a row's own distance
    got = radial_filter(spark.createDataFrame(rows, "inst int, pid int, x double, y double"), ["inst"])
    assert "avg(x" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["inst"]: r["count"] for r in got.groupBy("inst").count().collect()} == {0: 81, 1: 81}


def test_stem_points_are_computed_once(spark):
    """Filters on distances of stem points read them from a table, not from the views' hashes again for every mention."""
    plan = QUERIES["d34_radial_mode"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "2147483647" not in plan


def test_axis_distances_come_from_one_pass(spark):
    from canopyframe.operators.stems import envelope_radius
    points = spark.createDataFrame([(1, float(i % 20 + 1) / 10, 0.0, i % 2 + 0.25) for i in range(80)], "stem int, u double, v double, h double")
    axes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0)], "stem int, a0x double, a1x double, a0y double, a1y double")
    got = envelope_radius(points, axes)
    assert "a0x" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.band, r.n) for r in got.collect()) == [(0, 40), (1, 40)]
