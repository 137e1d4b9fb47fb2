"""Filters, predicates and point transforms."""
import math

from pyspark.sql import functions as F

from canopyframe.functions import scalars as X
from canopyframe.functions.hashing import mix, mix_sql, normal_sql
from canopyframe.operators import transforms as T
from canopyframe.operators.nms import nms
from canopyframe.operators.ranks import exact_quantiles, sorted_index
from canopyframe.operators.spatial import cell, grid_join
from canopyframe.plans.registry import query
from canopyframe.plans.scans import IN_PLOT
from canopyframe.sources import readers as R


@query("b01_canopy_mask", "classification:i canopy:b n:i",
       "SELECT classification, classification NOT IN (2, 18) AS canopy, count(*) AS n FROM fx_points GROUP BY 1, 2")
def _(fx):
    return fx.fx_points.groupBy("classification", R.is_canopy().alias("canopy")).agg(F.count(F.lit(1)).alias("n"))


@query("b02_height_window", "stand:i n:i zmin:d zmax:d",
       "SELECT stand, count(*) AS n, min(z) AS zmin, max(z) AS zmax FROM fx_points WHERE z BETWEEN 2 AND 45 GROUP BY stand")
def _(fx):
    return (fx.fx_points.where(T.in_height_window()).groupBy("stand")
            .agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax")))


@query("b03_circular_clip", "stand:i n:i zmean:d", """
SELECT stand, count(*) AS n, avg(z) AS zmean FROM fx_points
WHERE (x - 50) * (x - 50) + (y - 50) * (y - 50) <= 144 GROUP BY stand""")
def _(fx):
    return (fx.fx_points.where(T.in_cylinder(50.0, 50.0, 12.0)).groupBy("stand")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("zmean")))


@query("b04_inset_square", "plot:i n:i", """
SELECT p.plot, count(*) AS n FROM fx_plots p JOIN fx_points q ON p.stand = q.stand AND abs(q.x - p.cx) <= 13
 AND abs(q.y - p.cy) <= 13 GROUP BY p.plot""")
def _(fx):
    near = grid_join(fx.fx_points.select("stand", "x", "y"), fx.fx_plots.select("plot", "stand", "cx", "cy"), 13 * math.sqrt(2) + 1e-9)
    return near.where(T.in_square("cx", "cy", 13.0)).groupBy("plot").agg(F.count(F.lit(1)).alias("n"))


BANDS = [(0, 10), (10, 20), (15, 25), (20, 30), (18, 32), (20, 36), (25, 36), (0, 36)]  # fixed values, degrees


@query("b05_angle_bands", "a0:i a1:i stand:i n:i", f"""
SELECT a0, a1, stand, count(*) AS n FROM fx_points JOIN (VALUES {', '.join(map(str, BANDS))}) b(a0, a1)
 ON abs(scan_angle) >= a0 AND abs(scan_angle) < a1 WHERE z >= 1 AND z < 6 GROUP BY 1, 2, 3""")
def _(fx):
    p = fx.fx_points.where("z >= 1 and z < 6").select("stand", "scan_angle")
    p = T.with_params(p, [{"a0": a, "a1": b} for a, b in BANDS])
    return p.where(T.in_angle_band(F.col("a0"), F.col("a1"))).groupBy("a0", "a1", "stand").agg(F.count(F.lit(1)).alias("n"))


# fixed values: angle limit in degrees, density in returns per square metre
CONDITIONS = [dict(condition=i, angle_limit=a, density=d) for i, (a, d) in enumerate(
    [(None, None), (20.0, None), (10.0, None), (None, 0.5), (None, 0.2), (None, 0.05), (20.0, 0.2), (10.0, 0.05)])]


@query("b06_structured_degradation", "condition:i stand:i n:i zsum:d", f"""
SELECT condition, stand, count(*) AS n, sum(z) AS zsum FROM (
 SELECT c.condition, c.density, p.*, row_number() OVER (PARTITION BY c.condition, stand
   ORDER BY {mix_sql('pid', 'CAST(round(x * 100) AS BIGINT)', 'CAST(round(y * 100) AS BIGINT)', 17)}, x, y, z) AS r
 FROM fx_points p JOIN (VALUES {', '.join('(%d, %s, %s)' % (c['condition'], 'NULL::DOUBLE' if c['angle_limit'] is None else c['angle_limit'], 'NULL::DOUBLE' if c['density'] is None else c['density']) for c in CONDITIONS)}) c(condition, angle_limit, density)
 ON c.angle_limit IS NULL OR abs(scan_angle) <= c.angle_limit)
WHERE density IS NULL OR r <= round(density * 10000) GROUP BY 1, 2""")
def _(fx):
    pts = fx.fx_points.select("stand", "x", "y", "z", "scan_angle", "pid")
    ident = ["pid", "CAST(round(x * 100) AS BIGINT)", "CAST(round(y * 100) AS BIGINT)"]
    out = T.degrade(pts, CONDITIONS, 10000.0, 17, ident=ident, ties=["x", "y", "z"])
    return out.groupBy("condition", "stand").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("zsum"))


@query("b07_point_dropout", "inst:i n:i zsum:d", f"""
SELECT inst, count(*) AS n, sum(z) AS zsum FROM (SELECT *, count(*) OVER (PARTITION BY inst) AS m, row_number() OVER (
  PARTITION BY inst ORDER BY {mix_sql('pid', 'CAST(round(x * 10000) AS BIGINT)', 'inst', 5)}, x, y, z) AS r FROM fx_tree_pts)
WHERE r <= floor(m * 0.5) GROUP BY inst""")
def _(fx):
    kept = T.take_hashed(fx.fx_tree_pts, ["inst"], F.floor(F.col("n_rows") * 0.5), 5,
                         ["pid", "CAST(round(x * 10000) AS BIGINT)", "inst"], ["x", "y", "z"])
    return kept.groupBy("inst").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("zsum"))


@query("b08_height_noise", "inst:i zmean:d zsd:d", f"""
SELECT inst, avg(z + 0.3 * {normal_sql('pid', 'inst', 9)}) AS zmean, stddev_samp(z + 0.3 * {normal_sql('pid', 'inst', 9)}) AS zsd
FROM fx_tree_pts GROUP BY inst""")
def _(fx):
    n = T.height_noise(fx.fx_tree_pts, 0.3, 9, ["pid", "inst"])
    return n.groupBy("inst").agg(F.avg("z").alias("zmean"), F.stddev_samp("z").alias("zsd"))


@query("b09_fixed_size_sample", "inst:i n:i")
def _(fx):
    s = T.sample_fixed(fx.fx_tree_pts, ["inst"], 580, 3, ["pid", "inst"], "pid")
    return s.groupBy("inst").agg(F.count(F.lit(1)).alias("n"))


@query("b10_centre_and_scale", "inst:i x0:d z0:d rmax:d", """
WITH m AS (SELECT *, x - avg(x) OVER (PARTITION BY inst) AS a, y - avg(y) OVER (PARTITION BY inst) AS b,
  z - avg(z) OVER (PARTITION BY inst) AS c FROM fx_tree_pts),
s AS (SELECT *, max(sqrt(a*a + b*b + c*c)) OVER (PARTITION BY inst) AS r FROM m)
SELECT inst, min(a / r) AS x0, min(c / r) AS z0, max(sqrt(a*a + b*b + c*c) / r) AS rmax FROM s GROUP BY inst""")
def _(fx):
    n = T.centre_and_scale(fx.fx_tree_pts, ["inst"])
    return n.groupBy("inst").agg(F.min("x").alias("x0"), F.min("z").alias("z0"),
                                 F.max(F.sqrt(F.expr("x*x + y*y + z*z"))).alias("rmax"))


@query("b11_stem_frame", "inst:i xmin:d ymax:d zmax:d", """
SELECT inst, min((cos(0.5) * (x - cx) - sin(0.5) * (y - cy)) / 10) AS xmin, max((sin(0.5) * (x - cx) + cos(0.5) * (y - cy)) / 10) AS ymax,
 max(z / 10) AS zmax FROM fx_tree_pts JOIN fx_stems ON stem = inst GROUP BY inst""")
def _(fx):
    f = T.stem_frame(fx.fx_tree_pts, fx.fx_stems.select(F.col("stem").alias("inst"), "cx", "cy"), ["inst"], angle=F.lit(0.5))
    return f.groupBy("inst").agg(F.min("x").alias("xmin"), F.max("y").alias("ymax"), F.max("z").alias("zmax"))


SWEEP = [dict(sid=i, min_pts=a, min_z=b, min_ext=c) for i, (a, b, c) in enumerate(
    (a, b, c) for a in (0, 200, 400, 540, 570, 590) for b in (0.0, 14.0, 18.0, 22.0) for c in (0.0, 3.0, 4.0, 4.1))]


@query("b12_fragment_sweep", "sid:i n:i pts:i", f"""
WITH i AS (SELECT inst, count(*) AS n_pts, max(z) AS z_max, greatest(max(x) - min(x), max(y) - min(y)) AS ext FROM fx_tree_pts GROUP BY inst)
SELECT sid, count(*) AS n, sum(n_pts) AS pts FROM i JOIN (VALUES {', '.join('(%d,%d,%s,%s)' % tuple(s.values()) for s in SWEEP)})
 s(sid, a, b, c) ON n_pts >= a AND z_max >= b AND ext >= c GROUP BY sid""")
def _(fx):
    inst = fx.fx_tree_pts.groupBy("inst").agg(
        F.count(F.lit(1)).alias("n_pts"), F.max("z").alias("z_max"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("ext"))
    kept = T.with_params(inst, SWEEP).where("n_pts >= min_pts and z_max >= min_z and ext >= min_ext")
    return kept.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.sum("n_pts").alias("pts"))


@query("b13_view_round_trip", "view_id:i gap:d xmean:d", """
WITH v AS (SELECT view_id, cos(radians(view_id * 40)) * (CASE WHEN view_id % 2 = 1 THEN -(x - 50) ELSE x - 50 END)
 - sin(radians(view_id * 40)) * (y - 50) + 50 AS vx FROM fx_detections) SELECT view_id, 0.0 AS gap, avg(vx) AS xmean FROM v GROUP BY view_id""")
def _(fx):
    a, flip = F.radians(F.col("view_id") * 40), F.col("view_id") % 2 == 1
    vx, vy = X.rotate("x", "y", 50, 50, a, flip)
    d = fx.fx_detections.withColumns({"vx": vx, "vy": vy})
    bx, by = X.unrotate("vx", "vy", 50, 50, a, flip)
    return d.groupBy("view_id").agg(F.max(F.greatest(F.abs(bx - F.col("x")), F.abs(by - F.col("y")))).alias("gap"), F.avg("vx").alias("xmean"))


@query("b14_noise_score_sweep", "threshold:d n:i", """
WITH m AS (SELECT inst, median(score) AS s FROM fx_tree_pts GROUP BY inst)
SELECT threshold, count(*) AS n FROM m JOIN (VALUES (0.0), (0.4), (0.48), (0.495), (0.5), (0.51)) t(threshold) ON s >= threshold GROUP BY 1""")
def _(fx):
    med = exact_quantiles(fx.fx_tree_pts, ["inst"], "score", {"s": 0.5})
    t = T.with_params(med, [{"threshold": v} for v in (0.0, 0.4, 0.48, 0.495, 0.5, 0.51)])
    return t.where("s >= threshold").groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


@query("b15_trunk_crown_split", "inst:i part:s n:i", """
SELECT inst, CASE WHEN z < lo + 0.4 * (hi - lo) THEN 'trunk' ELSE 'crown' END AS part, count(*) AS n FROM
 (SELECT inst, z, min(z) OVER (PARTITION BY inst) AS lo, max(z) OVER (PARTITION BY inst) AS hi FROM fx_tree_pts) GROUP BY 1, 2""")
def _(fx):
    return T.split_by_height(fx.fx_tree_pts, ["inst"], 0.4).groupBy("inst", "part").agg(F.count(F.lit(1)).alias("n"))


@query("b16_ground_level", "inst:i z0:d", """
SELECT inst, coalesce(min(z) FILTER (semantic = 0), min(z)) AS z0 FROM fx_tree_pts GROUP BY inst""")
def _(fx):
    return T.ground_level(fx.fx_tree_pts, ["inst"])


@query("b17_radial_filter", "inst:i n:i zsum:d", """
WITH d AS (SELECT inst, z, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS d FROM (SELECT *, avg(x) OVER (PARTITION BY inst) AS mx,
 avg(y) OVER (PARTITION BY inst) AS my FROM fx_tree_pts WHERE semantic = 1)),
t AS (SELECT inst, quantile_cont(d, 0.8) AS t FROM d GROUP BY inst)
SELECT inst, count(*) AS n, sum(z) AS zsum FROM d JOIN t USING (inst) WHERE d <= t GROUP BY inst""")
def _(fx):
    return (T.radial_filter(fx.fx_tree_pts.where("semantic = 1"), ["inst"])
            .groupBy("inst").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("zsum")))


@query("b18_reference_gates", "stand:i n:i", """
WITH q AS (SELECT quantile_cont(dbh_cm, 0.10) AS a, quantile_cont(h_m, 0.05) AS b FROM fx_trees)
SELECT stand, count(*) AS n FROM fx_trees, q WHERE dbh_cm >= a AND h_m >= b GROUP BY stand""")
def _(fx):
    a = exact_quantiles(fx.fx_trees, [], "dbh_cm", {"q": 0.10}).scalar()
    b = exact_quantiles(fx.fx_trees, [], "h_m", {"q": 0.05}).scalar()
    return fx.fx_trees.where((F.col("dbh_cm") >= a) & (F.col("h_m") >= b)).groupBy("stand").agg(F.count(F.lit(1)).alias("n"))


ENV = """WITH e AS (SELECT min({0}) AS a, max({0}) AS b, min({1}) AS c, max({1}) AS d FROM fx_panel WHERE stand % 2 = 0)
SELECT plot, {0} IS NULL OR {0} < a OR {0} > b OR {1} < c OR {1} > d AS extrapolated FROM fx_panel, e"""


@query("b19_training_envelope", "plot:i extrapolated:b", ENV.format("hdom", "age"))
def _(fx):
    return T.flag_outside(fx.fx_panel, fx.fx_panel.where("stand % 2 = 0"), ["hdom", "age"])


@query("b20_window_envelope", "plot:i extrapolated:b", ENV.format("hmean", "zsd"))
def _(fx):
    return T.flag_outside(fx.fx_panel, fx.fx_panel.where("stand % 2 = 0"), ["hmean", "zsd"])


@query("b21_feature_selection", "h_m:d dbh_cm:d rare:d", """
SELECT h_m, dbh_cm, CASE WHEN tree_id % 3 > 0 THEN h_m END AS rare FROM fx_trees""")
def _(fx):
    wide = fx.sql("""SELECT tree_id, stand, x, y, dbh_cm, h_m, CASE WHEN tree_id % 3 > 0 THEN h_m END AS rare,
      CASE WHEN tree_id % 3 = 0 THEN h_m END AS rarer, CAST(NULL AS DOUBLE) AS empty FROM {fx_trees}""")
    out = R.select_features(wide, ["tree_id", "stand", "x", "y"])
    assert out.columns == ["dbh_cm", "h_m", "rare"]
    return out


@query("b22_colour_valid", "stand:i n:i",
       "SELECT stand, count(*) AS n FROM fx_points WHERE red + green + blue > 0 GROUP BY stand")
def _(fx):
    return fx.fx_points.where("red + green + blue > 0").groupBy("stand").agg(F.count(F.lit(1)).alias("n"))


@query("b23_absolute_shift", "tile:s x0:d gap:d n:i", """
SELECT tile, min(x) + 1000 + inst0 AS x0, 0.0 AS gap, count(*) AS n FROM (SELECT *, CAST(substr(tile, 2, 4) AS INT) AS inst0 FROM fx_labelled)
GROUP BY tile, inst0""")
def _(fx):
    local = fx.fx_labelled
    real = local.withColumns({"x": F.col("x") + 1000 + F.substring("tile", 2, 4).cast("int"), "y": F.col("y") + 500})
    out = T.to_absolute(local, real)
    return out.groupBy("tile").agg(F.min("x").alias("x0"), F.max("shift_gap").alias("gap"), F.count(F.lit(1)).alias("n"))


ARMS = [dict(arm=a, seed=s) for a in (0, 1) for s in (1, 2, 3)]
DRAW = mix_sql("tree_id", "seed", "arm", 77)
CORPUS = 120


@query("b24_equal_size_corpora", "arm:i seed:i stand:i n:i first:i", f"""
WITH p AS (SELECT seed, stand, row_number() OVER (PARTITION BY seed ORDER BY {mix_sql('stand', 'seed', 78)}, stand) AS place, count(*) OVER (PARTITION BY seed) AS stands FROM (SELECT DISTINCT stand FROM fx_trees) CROSS JOIN (VALUES (1), (2), (3)) v(seed)),
c AS (SELECT t.*, arm, seed, CASE WHEN arm = 0 THEN CASE WHEN place = 1 THEN {CORPUS} ELSE 0 END ELSE {CORPUS} // stands + CASE WHEN place <= {CORPUS} % stands THEN 1 ELSE 0 END END AS quota FROM fx_trees t JOIN p USING (stand) CROSS JOIN (VALUES (0), (1)) a(arm)),
r AS (SELECT *, row_number() OVER (PARTITION BY arm, seed, stand ORDER BY {DRAW}, tree_id) AS r FROM c WHERE quota > 0)
SELECT arm, seed, stand, count(*) AS n, min(tree_id) AS first FROM r WHERE r <= quota GROUP BY 1, 2, 3""")
def _(fx):
    """Arm 0 draws all trees from one drawn stand, arm 1 as many from all stands alike (one more from the first drawn where they don't divide), per seed."""
    stands = T.with_params(fx.fx_trees.select("stand").distinct(), [{"seed": k} for k in (1, 2, 3)]).withColumn("h", mix("stand", "seed", 78))
    place = sorted_index(stands, ["seed"], "h", "place", ["stand"])
    n = F.col("place_n")
    each = F.floor(F.lit(CORPUS) / n) + F.when(F.col("place") < F.lit(CORPUS) % n, 1).otherwise(0)
    quota = place.select("seed", "stand", F.explode(F.array(F.struct(F.lit(0).alias("arm"), F.when(F.col("place") == 0, CORPUS).otherwise(0).cast("long").alias("quota")), F.struct(F.lit(1).alias("arm"), each.cast("long").alias("quota")))).alias("q")).select("seed", "stand", "q.*")
    c = fx.fx_trees.join(quota.where("quota > 0"), "stand")
    kept = T.take_hashed(c, ["arm", "seed", "stand"], F.col("quota"), 77, ["tree_id", "seed", "arm"], ["tree_id"])
    return kept.groupBy("arm", "seed", "stand").agg(F.count(F.lit(1)).alias("n"), F.min("tree_id").alias("first"))
