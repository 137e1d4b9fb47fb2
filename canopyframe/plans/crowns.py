"""Crowns, section volumes, stand totals."""
import math

from pyspark.sql import functions as F

from canopyframe.functions import scalars as X
from canopyframe.operators import assign as A, crowns as C, inventory as V, metrics as Q, panel as P, polygons as G, raster as R, transforms as T
from canopyframe.operators.nms import merge
from canopyframe.operators.ranks import exact_quantiles
from canopyframe.operators.spatial import grid_join, nearest_within
from canopyframe.plans.joins import KNN, LENSP, PLOTS, VORONOI, airborne, stems_of
from canopyframe.plans.rasters import DIST_COLS, LMOM_COLS, VOXEL_COLS, canopy
from canopyframe.plans.registry import query
from canopyframe.session import cut

# ---- hulls and crown tables -------------------------------------------------------------------------


def leaves(fx):
    return fx.fx_tree_pts.where("semantic = 2")


@query("d17_crown_feature_table", f"inst:i n_wood:i n_leaf:i wood_ratio:d area:d crown_diameter:d volume:d lbi:d {VOXEL_COLS} {DIST_COLS} {LMOM_COLS}")
def _(fx):
    p = fx.fx_tree_pts
    n = p.groupBy("inst").agg(F.count_if(F.col("semantic") == 1).alias("n_wood"), F.count_if(F.col("semantic") == 2).alias("n_leaf"), F.avg((F.col("semantic") == 1).cast("double")).alias("wood_ratio"))
    circle = C.enclosing_circles(leaves(fx), ["inst"]).select("inst", (2 * F.col("r")).alias("crown_diameter"))
    parts = [C.hull_area(leaves(fx), ["inst"]), circle, C.hull_volumes(leaves(fx), ["inst"]), Q.biomass_index(p, ["inst"]), Q.voxel_metrics(p, ["inst"]), Q.height_distribution(leaves(fx), ["inst"])]
    for t in parts:
        n = n.join(t, "inst", "left")
    return n


@query("d20_hull_area", "inst:i area:d")
def _(fx):
    return C.hull_area(leaves(fx), ["inst"])


@query("d21_hull_volume", "inst:i volume:d")
def _(fx):
    return C.hull_volumes(leaves(fx), ["inst"])


@query("d22_enclosing_circle", "inst:i cx:d cy:d r:d")
def _(fx):
    return C.enclosing_circles(leaves(fx), ["inst"])


@query("d58_crown_channels", "stem:i n:i int_mean:d int_sd:d int_top:d first:d last:d single:d returns_mean:d deep:d gcc:d rcc:d exg:d bright:d int_p10:d int_p90:d", f"""
WITH v AS ({VORONOI}), p AS (SELECT *, quantile_cont(z, 0.8) OVER (PARTITION BY stem) AS z80, count(*) OVER (PARTITION BY stem) AS c FROM v)
SELECT stem, count(*) AS n, avg(intensity) AS int_mean, stddev_pop(intensity) AS int_sd, avg(intensity) FILTER (z > z80) AS int_top, avg((return_number = 1)::INT) AS first, avg((return_number = number_of_returns)::INT) AS last,
 avg((number_of_returns = 1)::INT) AS single, avg(number_of_returns) AS returns_mean, avg((return_number >= 3)::INT) AS deep, avg(green / (red + green + blue + CAST(1e-9 AS DOUBLE))) AS gcc, avg(red / (red + green + blue + CAST(1e-9 AS DOUBLE))) AS rcc,
 avg(2 * green - red - blue) AS exg, avg(red + green + blue + CAST(1e-9 AS DOUBLE)) AS bright, quantile_cont(intensity, 0.1) AS int_p10, quantile_cont(intensity, 0.9) AS int_p90 FROM p WHERE c >= 20 GROUP BY stem""")
def _(fx):
    v = cut(A.voronoi(airborne(fx), stems_of(fx)))
    return C.channels(v, ["stem"], 20)


@query("d59_crown_features", "stem:i n_pts:i zmax:d zmean:d zsd:d zskew:d area:d depth:d crown_vol:d crown_dens:d slender:d radius_med:d radius_p90:d")
def _(fx):
    v = cut(A.voronoi(airborne(fx), stems_of(fx)).select("stem", "x", "y", "z"))
    return C.crown_features(v, ["stem"], 20)


def sized(fx):
    return fx.fx_trees.withColumn("area", F.pi() * X.sq(0.0927 * F.col("dbh_cm")))


SIZED = "(SELECT *, pi() * (CAST(0.0927 AS DOUBLE) * dbh_cm) * (CAST(0.0927 AS DOUBLE) * dbh_cm) AS area FROM fx_trees)"


@query("d60_competition", "tree_id:i d_nn1:d d_nn_mean:d h_rel:d area_rel:d n_near:i hegyi:d", f"""
WITH k AS ({KNN}), a AS (SELECT k.tree_id, min(sqrt(d2)) AS d_nn1, avg(sqrt(d2)) AS d_nn_mean, any_value(t.h_m) - avg(n.h_m) AS h_rel, any_value(t.area) / avg(n.area) AS area_rel FROM k JOIN {SIZED} t ON t.tree_id = k.tree_id JOIN {SIZED} n ON n.tree_id = k.nb GROUP BY 1),
r AS (SELECT t.tree_id, count(*) AS n_near, sum(n.area / t.area / greatest(sqrt((t.x-n.x)*(t.x-n.x) + (t.y-n.y)*(t.y-n.y)), 0.3)) AS hegyi FROM {SIZED} t JOIN {SIZED} n ON t.stand = n.stand AND t.tree_id <> n.tree_id AND (t.x-n.x)*(t.x-n.x) + (t.y-n.y)*(t.y-n.y) <= 25 GROUP BY 1)
SELECT a.*, coalesce(n_near, 0) AS n_near, coalesce(hegyi, 0) AS hegyi FROM a LEFT JOIN r USING (tree_id)""")
def _(fx):
    return C.competition(sized(fx), "tree_id", "h_m", "area", side=8.0)


@query("d61_neighbour_blocks", "tree_id:i d_nn1:d d_sd:d nb_max_h_m:d nb_sd_h_m:d dif_mean_h_m:d n_larger_h_m:i v1_d:d v1_dx:d v6_dy:d v3_dif_h_m:d", f"""
SELECT k.tree_id, min(sqrt(d2)) AS d_nn1, stddev_pop(sqrt(d2)) AS d_sd, max(n.h_m) AS nb_max_h_m, stddev_pop(n.h_m) AS nb_sd_h_m, avg(n.h_m - t.h_m) AS dif_mean_h_m, count(*) FILTER (n.h_m > t.h_m) AS n_larger_h_m,
 max(sqrt(d2)) FILTER (k = 1) AS v1_d, max(dx) FILTER (k = 1) AS v1_dx, max(dy) FILTER (k = 6) AS v6_dy, max(n.h_m - t.h_m) FILTER (k = 3) AS v3_dif_h_m FROM ({KNN}) k JOIN fx_trees t ON t.tree_id = k.tree_id JOIN fx_trees n ON n.tree_id = k.nb GROUP BY k.tree_id""")
def _(fx):
    return C.neighbour_blocks(fx.fx_trees, "tree_id", ["h_m", "dbh_cm"], side=8.0)


@query("d62_relative_channels", "tree_id:i h_m_rel:d dbh_cm_rel:d", f"""
SELECT k.tree_id, any_value(t.h_m) - avg(n.h_m) AS h_m_rel, any_value(t.dbh_cm) - avg(n.dbh_cm) AS dbh_cm_rel FROM ({KNN}) k JOIN fx_trees t ON t.tree_id = k.tree_id JOIN fx_trees n ON n.tree_id = k.nb GROUP BY k.tree_id""")
def _(fx):
    return C.relative_to_neighbours(fx.fx_trees, "tree_id", ["h_m", "dbh_cm"], side=8.0)


@query("d63_crown_disposition", "stand:i n_ha:d area_mean:d area_cv:d area_gini:d packing:d h_mean:d h_max:d nn_spacing:d", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY stand ORDER BY area, tree_id) AS i, count(*) OVER (PARTITION BY stand) AS n FROM {SIZED}),
d AS (SELECT a.stand, a.tree_id, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) AS nn FROM fx_trees a JOIN fx_trees b ON a.stand = b.stand AND a.tree_id <> b.tree_id GROUP BY 1, 2)
SELECT r.stand, CAST(count(*) AS DOUBLE) AS n_ha, avg(area) AS area_mean, stddev_pop(area) / avg(area) AS area_cv, sum((2 * i - n - 1) * area) / (max(n) * sum(area)) AS area_gini, sum(area) / 10000 AS packing, avg(h_m) AS h_mean, max(h_m) AS h_max,
 avg(nn) AS nn_spacing FROM r JOIN d USING (tree_id) GROUP BY r.stand""")
def _(fx):
    return C.disposition(sized(fx).withColumnRenamed("h_m", "h"), "tree_id", ["stand"], 10000.0)


@query("d64_instance_position", "inst:i cx:d cy:d bx:d byy:d", """
WITH s AS (SELECT *, avg(x) OVER (PARTITION BY inst) AS cx, avg(y) OVER (PARTITION BY inst) AS cy, min(CASE WHEN semantic <> 0 THEN z END) OVER (PARTITION BY inst) AS z0 FROM fx_tree_pts)
SELECT inst, any_value(cx) AS cx, any_value(cy) AS cy, avg(x) FILTER (semantic <> 0 AND z <= z0 + 3) AS bx, avg(y) FILTER (semantic <> 0 AND z <= z0 + 3) AS byy FROM s GROUP BY inst""")
def _(fx):
    a = C.instance_position(fx.fx_tree_pts, ["inst"], False).withColumnsRenamed({"x": "cx", "y": "cy"})
    return a.join(C.instance_position(fx.fx_tree_pts, ["inst"], True).withColumnsRenamed({"x": "bx", "y": "byy"}), "inst")


# ---- sections -------------------------------------------------------------------------------------

SV = """(SELECT tree_id, sum(pi() / 8 * (d_cm*d_cm + d2*d2) / 10000 * (h2 - h_m)) AS smalian_m3, sum(pi() / 4 * ((d_cm + d2) / 2) * ((d_cm + d2) / 2) / 10000 * (h2 - h_m)) AS huber_m3, count(h2) AS n_sections
 FROM (SELECT *, lead(h_m) OVER w AS h2, lead(d_cm) OVER w AS d2 FROM fx_sections WINDOW w AS (PARTITION BY tree_id ORDER BY h_m)) GROUP BY tree_id)"""


@query("d42_isotonic_radius", "tree_id:i h_m:d r_iso:d", """
WITH s AS (SELECT tree_id, h_m, d_cm + (tree_id * 7 + CAST(h_m * 10 AS BIGINT)) % 9 AS r, row_number() OVER (PARTITION BY tree_id ORDER BY h_m) AS k FROM fx_sections),
m AS (SELECT a.tree_id, a.k AS i, b.k AS j, avg(c.r) AS m FROM s a JOIN s b ON a.tree_id = b.tree_id AND b.k >= a.k JOIN s c ON c.tree_id = a.tree_id AND c.k BETWEEN a.k AND b.k GROUP BY 1, 2, 3)
SELECT tree_id, h_m, min(v) AS r_iso FROM (SELECT s.tree_id, s.h_m, m.i, max(m.m) AS v FROM s JOIN m ON m.tree_id = s.tree_id AND m.i <= s.k AND m.j >= s.k GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(fx):
    s = fx.fx_sections.withColumn("r", F.col("d_cm") + (F.col("tree_id") * 7 + F.round(F.col("h_m") * 10).cast("bigint")) % 9)
    return V.isotonic(s, ["tree_id"])


@query("d43_section_volumes", "tree_id:i smalian_m3:d huber_m3:d n_sections:i", f"SELECT * FROM {SV}")
def _(fx):
    return V.section_volumes(fx.fx_sections, ["tree_id"])


@query("d44_reference_volumes", "tree_id:i volume_m3:d n_sections:i", """
SELECT tree_id, coalesce(sum(pi() / 8 * (d*d + d2*d2) / 10000 * (h2 - h_m)), 0) AS volume_m3, count(*) AS n_sections FROM (SELECT *, lead(h_m) OVER w AS h2, lead(d) OVER w AS d2 FROM
 (SELECT tree_id, h_m, CASE WHEN (tree_id + CAST(h_m * 10 AS BIGINT)) % 7 <> 0 THEN d_cm + 0.5 END AS d FROM fx_sections) WINDOW w AS (PARTITION BY tree_id ORDER BY h_m)) GROUP BY tree_id""")
def _(fx):
    s = fx.fx_sections.select("tree_id", "h_m", F.col("d_cm").alias("d1"), F.when((F.col("tree_id") + F.round(F.col("h_m") * 10).cast("bigint")) % 7 != 0, F.col("d_cm") + 1).alias("d2"))
    return V.reference_volumes(s, ["tree_id"])


def heights(fx):
    return fx.fx_sections.select("tree_id").distinct().withColumn("total_h", 16 + F.col("tree_id") % 50 / 10.0)


@query("d45_stem_volume", "tree_id:i stump_m3:d above_m3:d total_m3:d")
def _(fx):
    curve = V.taper_curve(V.relative_taper(fx.fx_sections, heights(fx), ["tree_id"]))
    return V.stem_volume(fx.fx_sections, heights(fx), curve, ["tree_id"])


@query("d46_taper_curve", "hrel:d q:d", """
WITH h AS (SELECT tree_id, 16 + tree_id % 50 / CAST(10 AS DOUBLE) AS hh FROM fx_sections GROUP BY tree_id), s AS (SELECT *, lead(h_m) OVER w AS h2, lead(d_cm) OVER w AS d2 FROM fx_sections WINDOW w AS (PARTITION BY tree_id ORDER BY h_m)),
d AS (SELECT tree_id, coalesce(max(CASE WHEN h_m <= 1.3 AND h2 > 1.3 THEN d_cm + (d2 - d_cm) * (CAST(1.3 AS DOUBLE) - h_m) / (h2 - h_m) END), CASE WHEN min(h_m) > 1.3 THEN arg_min(d_cm, h_m) ELSE arg_max(d_cm, h_m) END) AS d13 FROM s GROUP BY tree_id),
r AS (SELECT least(greatest(floor(h_m / hh * 25), 0), 24) AS b, d_cm / d13 AS q FROM fx_sections JOIN d USING (tree_id) JOIN h USING (tree_id))
SELECT (b + 0.5) / 25 AS hrel, median(q) AS q FROM r GROUP BY b UNION ALL SELECT 1, 0""")
def _(fx):
    return V.taper_curve(V.relative_taper(fx.fx_sections, heights(fx), ["tree_id"]))


@query("d47_taper_fit", "tree_id:i a:d b:d sse:d taper_m3:d")
def _(fx):
    return V.taper_fit(fx.fx_sections, heights(fx), ["tree_id"])


def slices(fx):
    return fx.fx_sections.join(heights(fx), "tree_id").withColumn("chi2_pass", F.col("tree_id") % 3 > 0)


@query("d48_trunk_summary", "tree_id:i n_heights:i height_range:d d_max:d d_mean:d d_13:d d_third:d smalian_m3:d form_m3:d", f"""
WITH s AS (SELECT *, 16 + tree_id % 50 / CAST(10 AS DOUBLE) AS hh FROM fx_sections), n AS (SELECT tree_id, count(*) AS n_heights, max(h_m) - min(h_m) AS height_range, max(d_cm) AS d_max, avg(d_cm) AS d_mean, any_value(hh) AS hh,
 arg_min(d_cm, abs(h_m - CAST(1.3 AS DOUBLE)) * 1000 + h_m / 1000) AS d1, min(abs(h_m - CAST(1.3 AS DOUBLE))) AS g1, arg_min(d_cm, abs(h_m - hh / 3) * 1000 + h_m / 1000) AS d3, min(abs(h_m - hh / 3)) AS g3 FROM s GROUP BY tree_id)
SELECT n.*, CASE WHEN g1 <= 0.5 THEN d1 END AS d_13, CASE WHEN g3 <= 1 THEN d3 END AS d_third, smalian_m3, CASE WHEN g1 <= 0.5 THEN pi() * d1 / 200 * d1 / 200 * hh * 0.5 END AS form_m3 FROM n JOIN {SV} USING (tree_id)""")
def _(fx):
    return V.trunk_summary(slices(fx), ["tree_id"])


@query("d49_feature_table_pivot", "tree_id:i d_at_0_5m:d d_at_2_5m:d d_at_4_5m:d d_at_12_5m:d", """
SELECT tree_id, max(d_cm) FILTER (h_m < 1) AS d_at_0_5m, max(d_cm) FILTER (h_m BETWEEN 2 AND 3) AS d_at_2_5m, max(d_cm) FILTER (h_m BETWEEN 4 AND 5) AS d_at_4_5m, max(d_cm) FILTER (h_m BETWEEN 12 AND 13) AS d_at_12_5m FROM fx_sections GROUP BY tree_id""")
def _(fx):
    return V.pivot_diameters(fx.fx_sections, ["tree_id"], [0.5, 2.5, 4.5, 12.5])


# ---- stand totals -----------------------------------------------------------------------------------


@query("d67_in_plot_counts", "plot:i n:i", """
SELECT p.plot, count(t.tree_id) AS n FROM fx_plots p LEFT JOIN fx_trees t ON p.stand = t.stand AND (t.x-cx)*(t.x-cx) + (t.y-cy)*(t.y-cy) <= 11.28 * 11.28 GROUP BY p.plot""")
def _(fx):
    n = grid_join(fx.fx_trees.select("stand", "x", "y"), fx.fx_plots.select(*PLOTS), 11.28).groupBy("plot").agg(F.count(F.lit(1)).alias("n"))
    return fx.fx_plots.select("plot").join(n, "plot", "left").na.fill(0, ["n"])


@query("d68_stand_summary_total", "stand:i n:i views_per_tree:d is_total:b", """
SELECT stand, count(*) AS n, CAST(count(*) AS DOUBLE) / count(DISTINCT tree_id) AS views_per_tree, grouping(stand) = 1 AS is_total FROM fx_detections GROUP BY ROLLUP (stand)""")
def _(fx):
    per = fx.fx_detections.groupBy("stand", "tree_id").agg(F.count(F.lit(1)).alias("v"))
    return V.with_total(per, "stand", [F.sum("v").alias("n"), F.avg("v").alias("views_per_tree")])


@query("d69_tree_to_plot_totals", "talhao:i v:d n:i per_ha:d", "SELECT talhao, sum(v) AS v, count(*) AS n, sum(v) / 1.0 AS per_ha FROM fx_volumes GROUP BY talhao")
def _(fx):
    return fx.fx_volumes.groupBy("talhao").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"), (F.sum("v") / 1.0).alias("per_ha"))


@query("d70_basal_area", "plot:i g_ha:d n_ha:d dq:d dq_identity:d", """
SELECT plot, sum(pi() * d_cm / 200 * d_cm / 200) / 0.04 AS g_ha, count(d_cm) / 0.04 AS n_ha, sqrt(avg(d_cm*d_cm)) AS dq, sqrt(avg(d_cm*d_cm)) AS dq_identity FROM fx_census WHERE d_cm IS NOT NULL GROUP BY plot""")
def _(fx):
    return V.basal_area(fx.fx_census, ["plot"], 0.04)


@query("d71_detected_plot_volume", "plot:i n:i vol_ha:d")
def _(fx):
    tops = R.treetops(R.rasterise(canopy(fx), 1.0), 1.0)
    near = grid_join(tops, fx.fx_plots.select(*PLOTS), 12.0)
    f = P.linear_fit(fx.fx_volumes.select(F.log("h_m").alias("lh"), F.log("v").alias("lv")), ["lh"], "lv").select(F.struct("b_0", "b_1").alias("f")).scalar()
    v = near.withColumn("f", f).withColumn("v", X.volume_from_height("h", F.col("f.b_0"), F.col("f.b_1")))
    got = v.groupBy("plot").agg(F.count(F.lit(1)).alias("n"), (F.sum("v") / 0.04524).alias("vol_ha"))
    return fx.fx_plots.select("plot").join(got, "plot", "left").na.fill(0, ["n"]).na.fill(0.0, ["vol_ha"])


@query("d72_virtual_plots", "stand:i gx:i gy:i n:i hmean:d total:d", """
SELECT t.stand, i AS gx, j AS gy, count(*) AS n, avg(h_m) AS hmean, sum(dbh_cm) AS total FROM fx_trees t, range(1, 9) a(i), range(1, 9) b(j)
WHERE (t.x - i * 11.28) * (t.x - i * 11.28) + (t.y - j * 11.28) * (t.y - j * 11.28) <= 11.28 * 11.28 GROUP BY 1, 2, 3 HAVING count(*) >= 15""")
def _(fx):
    r = 11.28
    c = fx.fx_trees.select("stand").distinct().withColumn("gx", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("gy", F.explode(F.sequence(F.lit(1), F.lit(8))))
    c = c.withColumns({"cx": F.col("gx") * r, "cy": F.col("gy") * r}).withColumnsRenamed({"gx": "px", "gy": "py"})
    near = grid_join(fx.fx_trees.select("stand", "x", "y", "h_m", "dbh_cm"), c, r)
    g = near.groupBy("stand", "px", "py").agg(F.count(F.lit(1)).alias("n"), F.avg("h_m").alias("hmean"), F.sum("dbh_cm").alias("total")).where("n >= 15")
    return g.withColumnsRenamed({"px": "gx", "py": "gy"})


SIZES = (25.0, 50.0, 100.0, 200.0, 400.0, 900.0)  # fixed values, square metres


@query("d73_plot_reference_by_size", "area_m2:d scale:d n:i disc:d cont:d bias:d disagreement:d r:d", f"""
WITH q AS (SELECT p.plot, p.stand, p.cx, p.cy, a AS area_m2, sqrt(a / pi()) AS rp, s AS scale FROM fx_plots p CROSS JOIN (VALUES {', '.join(f'({a})' for a in SIZES)}) v(a) CROSS JOIN (VALUES (0.75), (1.0), (1.25)) w(s)),
j AS (SELECT q.*, CAST(0.0927 AS DOUBLE) * scale * dbh_cm AS rc, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) AS d FROM q JOIN fx_trees t ON q.stand = t.stand AND abs(x - cx) < 22 AND abs(y - cy) < 22),
g AS (SELECT plot, area_m2, scale, sum(CASE WHEN d <= rp THEN 1.0 ELSE 0 END) AS a, sum({LENSP} / (pi() * rc * rc)) AS b FROM j WHERE d <= rp + rc GROUP BY 1, 2, 3),
r AS (SELECT q.plot, q.area_m2, q.scale, coalesce(a, 0) / (q.area_m2 / 10000) AS dd, coalesce(b, 0) / (q.area_m2 / 10000) AS c FROM q LEFT JOIN g USING (plot, area_m2, scale))
SELECT area_m2, scale, count(*) AS n, avg(dd) AS disc, avg(c) AS cont, 100 * avg(c - dd) / avg(dd) AS bias, 100 * sqrt(avg((c - dd)*(c - dd))) / avg(dd) AS disagreement, corr(dd, c) AS r FROM r GROUP BY 1, 2""")
def _(fx):
    pl = T.with_params(fx.fx_plots.select(*PLOTS), [{"area_m2": a, "scale": s} for a in SIZES for s in (0.75, 1.0, 1.25)])
    pl = pl.withColumn("rp", F.sqrt(F.col("area_m2") / F.pi())).withColumn("pid", F.col("plot")).withColumn("plot", F.struct("plot", "area_m2", "scale"))
    trees = T.with_params(fx.fx_trees, [{"scale": s} for s in (0.75, 1.0, 1.25)]).select("stand", "scale", "x", "y", (0.0927 * F.col("scale") * F.col("dbh_cm")).alias("rc"), F.lit(1.0).alias("basal"))
    r = A.crown_overlap(pl, trees, math.sqrt(900 / math.pi) + 0.0927 * 1.25 * 30, ["stand", "scale"])
    e = F.col("n_cont") - F.col("n_disc")
    return r.groupBy("area_m2", "scale").agg(F.count(F.lit(1)).alias("n"), F.avg("n_disc").alias("disc"), F.avg("n_cont").alias("cont"), (100 * F.avg(e) / F.avg("n_disc")).alias("bias"),
                                             (100 * F.sqrt(F.avg(e * e)) / F.avg("n_disc")).alias("disagreement"), P.pearson("n_disc", "n_cont").alias("r"))


@query("d74_canopy_provenance", "plot:i n_inside:i enters:d leaves:d", f"""
WITH j AS (SELECT plot, CAST(11.28 AS DOUBLE) AS rp, CAST(0.0927 AS DOUBLE) * dbh_cm AS rc, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) AS d FROM fx_plots p JOIN fx_trees t ON p.stand = t.stand AND abs(x - cx) < 16 AND abs(y - cy) < 16),
w AS (SELECT *, {LENSP} / (pi() * rc * rc) AS w FROM j WHERE d <= rp + rc)
SELECT plot, count(*) FILTER (d <= rp) AS n_inside, coalesce(sum(w) FILTER (d > rp), 0) AS enters, coalesce(sum(1 - w) FILTER (d <= rp), 0) AS leaves FROM w GROUP BY plot""")
def _(fx):
    t = fx.fx_trees.select("stand", "x", "y", (0.0927 * F.col("dbh_cm")).alias("rc"))
    j = grid_join(t, fx.fx_plots.select(*PLOTS), 11.28 + 0.0927 * 30, limit=F.lit(11.28) + F.col("rc"))
    d = F.sqrt("d2")
    w = X.circle_overlap(d, "rc", 11.28) / (F.pi() * F.col("rc") * F.col("rc"))
    ins = d <= 11.28
    return j.groupBy("plot").agg(F.count_if(ins).alias("n_inside"), F.sum(F.when(~ins, w).otherwise(0.0)).alias("enters"), F.sum(F.when(ins, 1 - w).otherwise(0.0)).alias("leaves"))


@query("d83_segmentation_stand_features", "plot:i n_det:i z_med:d z_sd:d z_q90:d pts_med:d dens:d")
def _(fx):
    kept = merge(fx.fx_detections, "det_id", "n_pts", 1.5)
    near = cut(grid_join(kept.select("stand", "x", "y", "z_max", "n_pts"), fx.fx_plots.select(*PLOTS), 11.28))
    g = near.groupBy("plot").agg(F.count(F.lit(1)).alias("n_det"), F.avg("z_max").alias("z_med"), F.stddev_samp("z_max").alias("z_sd"), F.avg("n_pts").alias("pts_med"), (F.count(F.lit(1)) / 0.04).alias("dens"))
    return g.join(exact_quantiles(near, ["plot"], "z_max", {"z_q90": 0.9}), "plot")


@query("d85_detection_by_size_class", "view_id:i dominant:b n:i rate:d bias:d", """
WITH t AS (SELECT *, h_m >= max(h_m) OVER (PARTITION BY stand) - 5 AS dominant FROM fx_trees), v AS (SELECT DISTINCT view_id FROM fx_detections),
m AS (SELECT v.view_id, t.tree_id, t.dominant, t.h_m, d.z_max, row_number() OVER (PARTITION BY v.view_id, t.tree_id ORDER BY (t.x-d.x)*(t.x-d.x) + (t.y-d.y)*(t.y-d.y), d.det_id) AS k FROM t CROSS JOIN v LEFT JOIN fx_detections d
 ON d.stand = t.stand AND d.view_id = v.view_id AND (t.x-d.x)*(t.x-d.x) + (t.y-d.y)*(t.y-d.y) <= 2.25)
SELECT view_id, dominant, count(*) AS n, avg((z_max IS NOT NULL)::INT) AS rate, avg(z_max - h_m) AS bias FROM m WHERE k = 1 GROUP BY 1, 2""")
def _(fx):
    top = fx.fx_trees.groupBy("stand").agg(F.max("h_m").alias("top"))
    t = fx.fx_trees.join(top, "stand").withColumn("dominant", F.col("h_m") >= F.col("top") - 5).withColumn("view_id", F.explode(F.sequence(F.lit(0), F.lit(8))))
    d = fx.fx_detections.withColumnRenamed("det_id", "did")
    h = A.hits(t.select("stand", "view_id", F.col("tree_id").alias("rid"), "x", "y"), d.select("stand", "view_id", "did", "x", "y"), 1.5, ["stand", "view_id"])
    j = h.join(t.select("view_id", F.col("tree_id").alias("rid"), "dominant", "h_m"), ["view_id", "rid"]).join(d.select("did", "z_max"), "did", "left")
    return j.groupBy("view_id", "dominant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("rate"), F.avg(F.col("z_max") - F.col("h_m")).alias("bias"))


@query("d86_candidate_shortlist", "stem:i inst:i votes:i size:i zmax:d dist:d", """
WITH v AS (SELECT stem, inst, any_value(s.cx) AS cx, any_value(s.cy) AS cy, count(*) AS votes FROM fx_stems s JOIN fx_tree_pts p ON abs(p.x - s.cx) <= 2.5 AND (p.x-s.cx)*(p.x-s.cx) + (p.y-s.cy)*(p.y-s.cy) <= 6.25 GROUP BY 1, 2),
i AS (SELECT inst, count(*) AS size, max(z) AS zmax, avg(x) AS mx, avg(y) AS my FROM fx_tree_pts GROUP BY inst)
SELECT stem, inst, votes, size, zmax, sqrt((mx-cx)*(mx-cx) + (my-cy)*(my-cy)) AS dist FROM v JOIN i USING (inst)""")
def _(fx):
    p = cut(fx.fx_tree_pts.select(F.lit(0).alias("k0"), "inst", "x", "y", "z"))
    return A.shortlist(p, fx.fx_stems.select(F.lit(0).alias("k0"), "stem", "cx", "cy"), 2.5, ["k0"])


@query("d87_detector_sweep", "detector:s radius:d n:i field:i rate:d")
def _(fx):
    raster = cut(R.rasterise(canopy(fx), 1.0))
    cells = cut(R.basins(raster))
    depths = cut(R.merge_depths(cells))
    dets = R.treetops(raster, 1.0).withColumn("detector", F.lit("local_max"))
    for tol in (None, 0.25, 0.5, 1.0, 1.5, 2.0):
        c = R.crowns(cells, depths, tol, 1.0).drop("n_cells").withColumn("detector", F.lit(f"basins_{tol}"))
        dets = dets.unionByName(c)
    census = fx.fx_census.where("d_cm is not null").groupBy("plot").agg(F.count(F.lit(1)).alias("field"))
    near = T.with_params(grid_join(dets, fx.fx_plots.select(*PLOTS), 12.0), [{"radius": 11.28}, {"radius": 12.0}]).where("d2 <= radius * radius")
    n = near.groupBy("plot", "detector", "radius").agg(F.count(F.lit(1)).alias("n")).join(census, "plot")
    return n.groupBy("detector", "radius").agg(F.sum("n").alias("n"), F.sum("field").alias("field")).withColumn("rate", F.col("n") / F.col("field"))


# ---- maps -------------------------------------------------------------------------------------------

FEATURES = ["zmax", "zmean", "zsd", "zq50", "zq90", "pzabovezmean"]
SCORED = "0.02 * c.vol * 0.04"


@query("j19_wall_to_wall_map", "stand:i x0:d y0:d volume_m3:d vol_lo:d vol_hi:d extrapolated:b")
def _(fx):
    cells, _ = Q.split_finite(Q.cell_metrics(canopy(fx), 20.0), FEATURES)
    train = fx.fx_panel.select(F.log("hdom").alias("lx"), F.log("vol_ha").alias("ly"), F.col("hdom").alias("zmax"))
    f = P.linear_fit(train, ["lx"], "ly").select(F.struct("b_0", "b_1", "resid_sd").alias("f")).scalar()
    c = T.flag_outside(cells, train, ["zmax"]).withColumn("f", f)
    lp = F.col("f.b_0") + F.col("f.b_1") * F.log("zmax")
    ha = 0.04
    return c.select("stand", "x0", "y0", "extrapolated", (F.exp(lp) * ha).alias("volume_m3"), (F.exp(lp - X.Z_975 * F.col("f.resid_sd")) * ha).alias("vol_lo"), (F.exp(lp + X.Z_975 * F.col("f.resid_sd")) * ha).alias("vol_hi"))


@query("j20_stand_and_estate_totals", "stand:i cells:i mean_ha:d total_m3:d sd:d is_total:b", """
WITH c AS (SELECT stand, floor(x / 20) AS ix, floor(y / 20) AS iy, avg(z) * 10 AS v FROM fx_points WHERE z BETWEEN 2 AND 45 GROUP BY 1, 2, 3)
SELECT stand, count(*) AS cells, avg(v) AS mean_ha, sum(v * 0.04) AS total_m3, stddev_samp(v) AS sd, grouping(stand) = 1 AS is_total FROM c GROUP BY ROLLUP (stand)""")
def _(fx):
    c = fx.fx_points.where("z between 2 and 45").groupBy("stand", F.floor(F.col("x") / 20).alias("ix"), F.floor(F.col("y") / 20).alias("iy")).agg((F.avg("z") * 10).alias("v"))
    return V.with_total(c, "stand", [F.count(F.lit(1)).alias("cells"), F.avg("v").alias("mean_ha"), F.sum(F.col("v") * 0.04).alias("total_m3"), F.stddev_samp("v").alias("sd")])


@query("l02_per_cell_ages", "stand:i gx:i gy:i si:d", """
WITH a AS (SELECT stand, avg(age) AS age FROM fx_panel GROUP BY stand) SELECT stand, floor(x / 20) AS gx, floor(y / 20) AS gy, max(z) * (7 / any_value(age)) AS si FROM fx_points JOIN a USING (stand) WHERE z BETWEEN 2 AND 45 GROUP BY 1, 2, 3""")
def _(fx):
    ages = fx.fx_panel.groupBy("stand").agg(F.avg("age").alias("age"))
    c = fx.fx_points.where("z between 2 and 45").groupBy("stand", F.floor(F.col("x") / 20).alias("gx"), F.floor(F.col("y") / 20).alias("gy")).agg(F.max("z").alias("top"))
    return c.join(ages, "stand").withColumn("si", X.site_index("top", "age"))
