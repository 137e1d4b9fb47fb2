"""Steps whose cost once grew faster than their rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyframe.streaming import sessions


class Counted:
    """A state that counts its calls."""

    def __init__(self):
        self.value, self.calls = {}, 0

    def exists(self):
        self.calls += 1
        return bool(self.value)

    def get(self):
        self.calls += 1
        return self.value["v"]

    def update(self, v):
        self.calls += 1
        self.value["v"] = v

    def containsKey(self, k):
        self.calls += 1
        return k in self.value

    def getValue(self, k):
        self.calls += 1
        return self.value[k]

    def updateValue(self, k, v):
        self.calls += 1
        self.value[k] = v

    def iterator(self):
        self.calls += 1
        return iter(list(self.value.items()))


class Handle:
    def __init__(self):
        self.made = []

    def getValueState(self, *_):
        self.made.append(Counted())
        return self.made[-1]

    getMapState = getValueState


def test_state_is_read_and_written_once_a_batch():
    rng = np.random.default_rng(1)
    t = pd.DataFrame({"det_id": np.arange(400), "tile_seq": np.arange(400) // 40, "x": rng.uniform(0, 30, 400).round(2), "y": rng.uniform(0, 30, 400).round(2), "size": rng.integers(1, 50, 400).astype(float)})

    def kept(batches):
        m, h, out = sessions.TileMerger(fraction=0.3), Handle(), []
        m.init(h)
        for b in batches:
            out += list(m.handleInputRows((1,), iter([b]), None))
        return pd.concat(out, ignore_index=True), sum(s.calls for s in h.made)
    one, calls = kept([t])
    two, _ = kept([t[t.tile_seq < 4], t[t.tile_seq >= 4]])
    pd.testing.assert_frame_equal(one, two)
    assert 0 < len(one) < 400 and calls <= 8


def test_hulls_of_ordinary_keys_are_built_once(spark, monkeypatch):
    from canopyframe.operators import crowns, polygons
    rng = np.random.default_rng(2)
    p = np.vstack([np.column_stack([np.full(50, k), rng.normal(size=(50, 3)).round(3)]) for k in range(3)])
    d = spark.createDataFrame(pd.DataFrame(p, columns=["inst", "x", "y", "z"]).astype({"inst": "int64"})).repartition(4)
    whole = {r.inst: r.volume for r in crowns.hull_volumes(d, ["inst"]).collect()}
    assert all(whole[k] == pytest.approx(crowns.hull3(p[p[:, 0] == k][:, 1:])[1]) for k in range(3))
    plan = crowns.hull_volumes(d, ["inst"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("FlatMapGroupsInPandas") == 1
    area = {r.inst: r.area for r in crowns.hull_area(d, ["inst"]).collect()}
    monkeypatch.setattr(polygons, "SHARE_ROWS", 16)  # now every key goes by shares
    assert {r.inst: r.volume for r in crowns.hull_volumes(d, ["inst"]).collect()} == pytest.approx(whole)
    assert {r.inst: r.area for r in crowns.hull_area(d, ["inst"]).collect()} == pytest.approx(area)


def test_stem_forms_stay_where_the_stem_is(spark):
    from canopyframe.operators import inventory
    s = spark.createDataFrame([(k, 0.3 + 2.0 * i, 30.0 - 3 * i - k) for k in range(4) for i in range(3 + k)], "tree_id long, h_m double, d_cm double")
    heights = s.select("tree_id").distinct().withColumn("total_h", 14.0 + F.col("tree_id"))
    fit = inventory.taper_fit(s, heights, ["tree_id"])
    got = {r.tree_id: r for r in fit.collect()}

    def sse(k, a, b):
        z = np.array([0.3 + 2.0 * i for i in range(3 + k)]) / (14 + k)
        d = np.array([30.0 - 3 * i - k for i in range(3 + k)]) / 100
        return float(((d[1] * ((1 - z ** a) / (1 - (1.3 / (14 + k)) ** a)) ** b - d) ** 2).sum())
    grid = [(sse(0, a, b), a, b) for a in inventory.TAPER_A for b in inventory.TAPER_B]
    _, a0, b0 = min(grid)
    best = min((sse(0, a0 * f, b0 * g), a0 * f, b0 * g) for f in inventory.TAPER_FACTORS for g in inventory.TAPER_FACTORS)
    assert (got[0].sse, got[0].a, got[0].b) == pytest.approx(best)
    above = inventory.stem_volume(s, heights, inventory.taper_curve(inventory.relative_taper(s, heights, ["tree_id"])), ["tree_id"])
    assert {r.tree_id for r in above.collect() if r.above_m3 > 0} == {0, 1, 2, 3}
    for out in (fit, above):  # no copies of stems for pairs of parameters or steps of height
        assert "Generate explode" not in out._jdf.queryExecution().executedPlan().toString()


def test_resamples_are_added_up_where_they_are_drawn(spark, monkeypatch):
    from canopyframe.operators import panel, resampling
    d = spark.range(1, 41).select("id", (F.col("id") % 3).alias("a"), (F.col("id") / 7).alias("v"))
    rows = panel.bootstrap(d, "id", 25, 4, ["a", "v"]).groupBy("rep").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("a")).alias("a"), F.sum(F.col("w") * F.col("v")).alias("v"))
    want = {r.rep: (r.w, r.a, pytest.approx(r.v)) for r in rows.collect()}
    sums = panel.bootstrap_sums(d, "id", 25, 4, ["a", "v"])
    assert {r.rep: (r.w, r.a, r.v) for r in sums.collect()} == want
    assert "Aggregate" not in sums._jdf.queryExecution().executedPlan().toString()  # a task sends one row a replicate
    monkeypatch.setattr(resampling, "LOCAL_BYTES", 0)
    assert {r.rep: (r.w, r.a, r.v) for r in panel.bootstrap_sums(d, "id", 25, 4, ["a", "v"]).collect()} == want


def test_filters_deal_rows_of_cells_by_their_number(spark, monkeypatch):
    from canopyframe.operators import raster
    rng = np.random.default_rng(3)
    p = spark.createDataFrame(pd.DataFrame({"stand": rng.integers(1, 4, 600), "x": rng.uniform(0, 20, 600), "y": rng.uniform(0, 20, 600), "z": rng.uniform(1, 30, 600)}))
    cells = raster.rasterise(p, 1.0)
    few = {(r.stand, r.ix, r.iy): r.v for r in raster.smooth(cells, 0.6).collect()}
    monkeypatch.setattr(raster, "CELLS_PER_TASK", 50)
    many = raster.smooth(cells, 0.6)
    assert many.rdd.getNumPartitions() == cells.count() // 50 + 1
    assert {(r.stand, r.ix, r.iy): r.v for r in many.collect()} == pytest.approx(few)


def test_stems_of_a_spot_share_their_votes(spark, monkeypatch):
    from canopyframe.operators import assign as A
    zones, join = [], A.grid_join

    def seen(points, z, *args, **more):
        zones.append(z.count())
        return join(points, z, *args, **more)

    monkeypatch.setattr(A, "grid_join", seen)
    stems = spark.range(60).selectExpr("id as stem", "cast(id % 3 * 10 as double) as cx", "0D as cy")
    twice = stems.unionByName(spark.sql("select 7L as stem, 20D as cx, 0D as cy"))  # stem 7 stands on two spots
    points = spark.range(90).selectExpr("cast(id % 3 * 10 as double) + id % 5 / 10 as x", "id % 4 / 10 as y", "id % 14 as z", "id % 7 - 1 as inst")
    near = twice.join(points, F.expr("(x - cx) * (x - cx) + (y - cy) * (y - cy) <= 1.44"))
    votes = {}
    for r in near.collect():
        votes.setdefault(r.stem, []).append(r)
    want = {}
    for s, rows in votes.items():
        band = [r for r in rows if 2 <= r.z <= 12]
        use = [r.inst for r in (band if len(band) >= 5 else rows) if r.inst >= 0]
        want[s] = min(set(use), key=lambda i: (-use.count(i), i))
    assert {r.stem: r.inst for r in A.instance_vote(points, twice).collect()} == want and len(want) == 60
    assert max(zones) <= 5
    zones.clear()
    listed = A.shortlist(points.withColumn("k", F.lit(0)), twice.withColumn("k", F.lit(0)), 1.2, ["k"])
    assert {(r.stem, r.inst): r.votes for r in listed.where("stem <> 7").collect()} == {(s, i): sum(r.inst == i for r in rows) for s, rows in votes.items() if s != 7 for i in {r.inst for r in rows}}
    assert zones == [3]
