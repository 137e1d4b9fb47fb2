"""Spatial and keyed joins."""
import math

from pyspark.sql import functions as F

from canopyframe.functions import scalars as X
from canopyframe.functions.hashing import mix_sql, uniform, uniform_sql
from canopyframe.operators import assign as A, matching as M, polygons as P, spatial as S, transforms as T
from canopyframe.operators.nms import merge, nms
from canopyframe.operators.ranks import exact_quantiles
from canopyframe.plans.registry import query
from canopyframe.plans.scans import IN_PLOT

PLOTS = ["plot", "stand", "cx", "cy"]


@query("c01_zonal_join", "plot:i n:i zmean:d zmax:d", f"""
SELECT plot, count(*) AS n, avg(z) AS zmean, max(z) AS zmax FROM ({IN_PLOT}) WHERE classification NOT IN (2, 18) GROUP BY plot""")
def _(fx):
    pts = fx.fx_points.where("classification not in (2, 18)").select("stand", "x", "y", "z")
    return (A.in_zones(pts, fx.fx_plots.select(*PLOTS), 12.0).groupBy("plot")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("zmean"), F.max("z").alias("zmax")))


@query("c02_tile_join", "stand:i ti:i tj:i n:i zmean:d", """
SELECT stand, ti, tj, count(*) AS n, avg(z) AS zmean FROM fx_points, range(0, 7) a(ti), range(0, 7) b(tj)
WHERE x >= ti * 16 AND x < ti * 16 + 32 AND y >= tj * 16 AND y < tj * 16 + 32 GROUP BY 1, 2, 3""")
def _(fx):
    t = A.in_tiles(fx.fx_points.select("stand", "x", "y", "z"), 32.0, 16.0)
    return t.groupBy("stand", "ti", "tj").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("zmean"))


@query("c03_tile_floor", "stand:i ti:i tj:i n:i", """
WITH c AS (SELECT stand, CAST(floor(x / 16) AS INT) AS gx, CAST(floor(y / 16) AS INT) AS gy, count(*) AS c FROM fx_points GROUP BY 1, 2, 3)
SELECT stand, gx + i AS ti, gy + j AS tj, sum(c) AS n FROM c, range(-1, 2) a(i), range(-1, 2) b(j) GROUP BY 1, 2, 3 HAVING sum(c) >= 1500""")
def _(fx):
    return A.tile_counts(fx.fx_points.select("stand", "x", "y"), 16.0, 1500)


@query("c04_nearest_neighbour", "stand:i n:i spacing:d", """
WITH d AS (SELECT a.stand, a.tree_id, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) AS nn FROM fx_trees a
 JOIN fx_trees b ON a.stand = b.stand AND a.tree_id <> b.tree_id GROUP BY 1, 2)
SELECT stand, count(*) AS n, median(nn) AS spacing FROM d GROUP BY stand""")
def _(fx):
    nn = S.nn_distance(fx.fx_trees.select("stand", "tree_id", "x", "y"), "tree_id", 4.0)
    return exact_quantiles(nn, ["stand"], "nn", {"spacing": 0.5}).join(nn.groupBy("stand").agg(F.count(F.lit(1)).alias("n")), "stand")


KNN = """SELECT a.stand, a.tree_id, b.tree_id AS nb, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) AS d2, b.x - a.x AS dx, b.y - a.y AS dy,
 row_number() OVER (PARTITION BY a.tree_id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.tree_id) AS k
 FROM fx_trees a JOIN fx_trees b ON a.stand = b.stand AND a.tree_id <> b.tree_id QUALIFY k <= 6"""


@query("c05_k_nearest", "tree_id:i k:i nb:i d:d", f"SELECT tree_id, k, nb, sqrt(d2) AS d FROM ({KNN})")
def _(fx):
    nb = S.self_neighbours(fx.fx_trees, "tree_id", 6, 8.0)
    return nb.select("tree_id", F.col("rank").alias("k"), "nb", F.sqrt("d2").alias("d"))


def airborne(fx):
    """Canopy returns with a row number made of their own values (copies are equal rows)."""
    p = fx.fx_points.where("classification not in (2, 18)").select("stand", "x", "y", "z", "intensity", "pid",
                                                                  "return_number", "number_of_returns", "red", "green", "blue")
    return p.withColumn("row_id", F.concat_ws(":", "pid", F.round(F.col("x") * 100).cast("bigint"), F.round(F.col("y") * 100).cast("bigint"),
                                              F.round(F.col("z") * 100).cast("bigint"), "intensity"))


VORONOI = """SELECT * EXCLUDE (rr) FROM (SELECT p.*, t.tree_id AS stem, (p.x-t.x)*(p.x-t.x) + (p.y-t.y)*(p.y-t.y) AS d2, row_number() OVER (
 PARTITION BY p.rid ORDER BY (p.x-t.x)*(p.x-t.x) + (p.y-t.y)*(p.y-t.y), t.tree_id) AS rr
 FROM (SELECT *, row_number() OVER () AS rid FROM fx_points WHERE classification NOT IN (2, 18)) p JOIN fx_trees t ON p.stand = t.stand
 AND abs(p.x - t.x) <= 2.5 AND abs(p.y - t.y) <= 2.5 AND (p.x-t.x)*(p.x-t.x) + (p.y-t.y)*(p.y-t.y) <= 6.25) WHERE rr = 1"""


def stems_of(fx):
    return fx.fx_trees.select("stand", F.col("tree_id").alias("stem"), F.col("x").alias("cx"), F.col("y").alias("cy"))


@query("c06_voronoi_crowns", "stem:i n:i zmean:d dmean:d", f"""
SELECT stem, count(*) AS n, avg(z) AS zmean, avg(sqrt(d2)) AS dmean FROM ({VORONOI}) GROUP BY stem""")
def _(fx):
    v = A.voronoi(airborne(fx), stems_of(fx))
    return v.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("zmean"), F.avg(F.sqrt("d2")).alias("dmean"))


AXES = """SELECT stand, tree_id AS stem, x AS cx, y AS cy, (tree_id % 5 - 2) * 0.02 AS ax, (tree_id % 3 - 1) * 0.03 AS ay,
 0.5 + (tree_id % 4) * 0.2 AS env FROM fx_trees"""


@query("c07_guided_crowns", "stem:i n:i smean:d", f"""
WITH p AS (SELECT *, row_number() OVER () AS rid FROM fx_points WHERE classification NOT IN (2, 18) AND z >= 2),
s AS ({AXES}), j AS (SELECT rid, stem, env, p.x - (cx + ax * (floor(z) + 0.5)) AS dx, p.y - (cy + ay * (floor(z) + 0.5)) AS dy
 FROM p JOIN s ON p.stand = s.stand AND abs(p.x - cx) < 6 AND abs(p.y - cy) < 6),
r AS (SELECT rid, stem, sqrt(dx*dx + dy*dy) / greatest(env, 0.15) AS s, row_number() OVER (PARTITION BY rid ORDER BY
 sqrt(dx*dx + dy*dy) / greatest(env, 0.15), stem) AS k FROM j WHERE dx*dx + dy*dy <= 9)
SELECT stem, count(*) AS n, avg(s) AS smean FROM r WHERE k = 1 GROUP BY stem""")
def _(fx):
    axes = fx.sql(AXES.replace("fx_trees", "{fx_trees}"))
    g = A.guided(airborne(fx), axes, 3.0, True)
    return g.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("smean"))


def view_pairs(fx, cap=2.0):
    refs = fx.fx_trees.select("stand", F.col("tree_id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    refs = refs.withColumn("view_id", F.explode(F.sequence(F.lit(0), F.lit(8))))
    dets = fx.fx_detections.select("stand", "view_id", F.col("det_id").alias("did"), "x", "y")
    return refs, dets, M.match(refs, dets, cap, ["stand", "view_id"])


@query("c08_optimal_matching", "stand:i view_id:i n_ref:i n_pred:i tp:i rmse:d")
def _(fx):
    refs, dets, pairs = view_pairs(fx)
    return M.match_counts(refs, dets, pairs, ["stand", "view_id"])


@query("c09_hit_match", "stand:i n:i rate:d dmean:d", """
WITH h AS (SELECT t.stand, t.tree_id, min(sqrt((t.x-d.x)*(t.x-d.x) + (t.y-d.y)*(t.y-d.y))) AS d FROM fx_trees t LEFT JOIN fx_detections d
 ON t.stand = d.stand AND (t.x-d.x)*(t.x-d.x) + (t.y-d.y)*(t.y-d.y) <= 0.36 GROUP BY 1, 2)
SELECT stand, count(*) AS n, avg(CASE WHEN d IS NOT NULL THEN 1.0 ELSE 0.0 END) AS rate, avg(d) AS dmean FROM h GROUP BY stand""")
def _(fx):
    h = A.hits(fx.fx_trees.withColumnRenamed("tree_id", "rid"), fx.fx_detections.withColumnRenamed("det_id", "did"), 0.6)
    return h.groupBy("stand").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("rate"), F.avg(F.sqrt("d2")).alias("dmean"))


@query("c10_greedy_merge", "det_id:i stand:i")
def _(fx):
    return nms(fx.fx_detections, "det_id", "n_pts", 1.5)


@query("c11_merge_clip_boundary", "det_id:i stand:i edge_m:d")
def _(fx):
    kept = merge(fx.fx_detections, "det_id", "n_pts", 1.5)
    clipped = P.inside(kept, fx.fx_edges).where("inside")
    return P.boundary_distance(clipped, fx.fx_edges)


@query("c12_greedy_coordinate_match", "det_id:i tree_id:i d:d")
def _(fx):
    d = fx.fx_detections.select("stand", "det_id", "x", "y")
    cand = S.grid_join(d, fx.fx_trees.select("stand", "tree_id", F.col("x").alias("cx"), F.col("y").alias("cy")), 3.0).where("d2 < 9")
    got = M.greedy_in_order(cand.withColumn("d", F.sqrt("d2")), "det_id", "tree_id", "d", ["stand"])
    return got


@query("c13_instance_vote", "stem:i inst:i", """
WITH near AS (SELECT stem, inst, z FROM fx_stems s JOIN fx_labelled p ON abs(p.x - cx) <= 1.2 AND (p.x-cx)*(p.x-cx) + (p.y-cy)*(p.y-cy) <= 1.44),
b AS (SELECT stem, count(*) FILTER (z BETWEEN 2 AND 12) AS nb FROM near GROUP BY stem),
v AS (SELECT stem, inst, CASE WHEN nb >= 5 THEN count(*) FILTER (z BETWEEN 2 AND 12) ELSE count(*) END AS v FROM near JOIN b USING (stem)
 WHERE inst >= 0 GROUP BY stem, inst, nb),
r AS (SELECT stem, inst, row_number() OVER (PARTITION BY stem ORDER BY v DESC, inst) AS k FROM v WHERE v > 0)
SELECT s.stem, coalesce(r.inst, -1) AS inst FROM fx_stems s LEFT JOIN r ON s.stem = r.stem AND k = 1""")
def _(fx):
    return A.instance_vote(fx.fx_labelled, fx.fx_stems)


@query("c14_position_volume_link", "arv:i x:d v:d", """
SELECT t.tree_id AS arv, x, v FROM fx_trees t JOIN fx_volumes ON arv = t.tree_id WHERE talhao = 1""")
def _(fx):
    return fx.fx_trees.withColumnRenamed("tree_id", "arv").join(fx.fx_volumes.where("talhao = 1").select("arv", "v"), "arv")


@query("c15_map_lookup", "plot:i x0:d y0:d snap:d", """
WITH c AS (SELECT stand, floor(x / 10) * 10 AS x0, floor(y / 10) * 10 AS y0 FROM fx_trees GROUP BY 1, 2, 3 HAVING count(*) >= 3),
d AS (SELECT plot, x0, y0, cx >= x0 AND cx < x0 + 10 AND cy >= y0 AND cy < y0 + 10 AS ins,
 sqrt((cx - x0 - 5)*(cx - x0 - 5) + (cy - y0 - 5)*(cy - y0 - 5)) AS d FROM fx_plots p JOIN c ON p.stand = c.stand),
r AS (SELECT *, row_number() OVER (PARTITION BY plot ORDER BY ins DESC, d, x0 * 1000 + y0) AS k FROM d)
SELECT plot, x0, y0, CASE WHEN ins THEN 0 ELSE d END AS snap FROM r WHERE k = 1""")
def _(fx):
    cells = (fx.fx_trees.groupBy("stand", (F.floor(F.col("x") / 10) * 10).alias("x0"), (F.floor(F.col("y") / 10) * 10).alias("y0"))
             .count().where("count >= 3").select("stand", "x0", "y0", (F.col("x0") * 1000 + F.col("y0")).alias("cell"),
                                                 (F.col("x0") + 5.0).alias("ux"), (F.col("y0") + 5.0).alias("uy")))
    plots = fx.fx_plots.select(*PLOTS)
    hit = plots.join(cells, (plots.stand == cells.stand) & (F.floor(F.col("cx") / 10) * 10 == F.col("x0")) & (F.floor(F.col("cy") / 10) * 10 == F.col("y0")))
    hit = hit.select("plot", "x0", "y0", F.lit(0.0).alias("snap"))
    rest = plots.join(hit, "plot", "left_anti")
    near = S.nearest(rest, cells, "plot", "cell", 10.0, at=("cx", "cy"), to=("ux", "uy"))
    near = near.join(cells.select("stand", "cell", "x0", "y0"), ["stand", "cell"]).select("plot", "x0", "y0", F.sqrt("d2").alias("snap"))
    return hit.unionByName(near)


@query("c16_exclusion_join", "stand:i n:i", """
SELECT stand, count(*) AS n FROM fx_trees t WHERE NOT EXISTS (SELECT 1 FROM fx_plots p WHERE p.stand = t.stand
 AND (t.x-cx)*(t.x-cx) + (t.y-cy)*(t.y-cy) <= 64) GROUP BY stand""")
def _(fx):
    keep = A.outside_all(fx.fx_trees.withColumnRenamed("tree_id", "pid"), fx.fx_plots.select(*PLOTS), 8.0)
    return keep.groupBy("stand").agg(F.count(F.lit(1)).alias("n"))


CROSS = """SELECT p.{pid}, count(*) FILTER ((y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / (CASE WHEN y2 = y1 THEN NULL ELSE y2 - y1 END) + x1) % 2 = 1 AS ins
 FROM {t} p JOIN fx_edges e ON p.stand = e.stand GROUP BY p.{pid}"""


@query("c17_point_in_polygon", "tree_id:i ins:b", CROSS.format(pid="tree_id", t="fx_trees"))
def _(fx):
    return P.inside(fx.fx_trees, fx.fx_edges).select("tree_id", F.col("inside").alias("ins"))


SEG = """sqrt((p.x - x1 - t * (x2 - x1)) * (p.x - x1 - t * (x2 - x1)) + (p.y - y1 - t * (y2 - y1)) * (p.y - y1 - t * (y2 - y1)))"""


@query("c18_boundary_share", "stand:i n:i ring_share:d metres_per_ha:d edge_mean:d", f"""
WITH i AS ({CROSS.format(pid="tree_id", t="fx_trees")}),
s AS (SELECT p.*, e.x1, e.y1, e.x2, e.y2, least(greatest(((p.x-x1)*(x2-x1) + (p.y-y1)*(y2-y1)) / ((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)), 0), 1) AS t
 FROM fx_trees p JOIN fx_edges e ON p.stand = e.stand),
d AS (SELECT p.stand, p.tree_id, min({SEG}) AS d FROM s p GROUP BY 1, 2),
a AS (SELECT stand, abs(sum(x1*y2 - x2*y1)) / 2 AS area, sum(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1))) AS per FROM fx_edges GROUP BY stand)
SELECT d.stand, count(*) AS n, avg(CASE WHEN d < 3 THEN 1.0 ELSE 0.0 END) AS ring_share, max(per / (area / 10000)) AS metres_per_ha, avg(d) AS edge_mean
FROM d JOIN i USING (tree_id) JOIN a ON a.stand = d.stand WHERE ins GROUP BY d.stand""")
def _(fx):
    ins = P.boundary_distance(P.inside(fx.fx_trees, fx.fx_edges).where("inside"), fx.fx_edges)
    shape = P.area_and_perimeter(fx.fx_edges)
    g = ins.groupBy("stand").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("edge_m") < 3).cast("double")).alias("ring_share"), F.avg("edge_m").alias("edge_mean"))
    return g.join(shape, "stand").withColumn("metres_per_ha", F.col("perimeter_m") / (F.col("area_m2") / 10000))


@query("c19_tiles_touching_polygon", "stand:i ti:i tj:i")
def _(fx):
    tiles = A.in_tiles(fx.fx_points.select("stand", "x", "y"), 16.0, 16.0).select("stand", "ti", "tj").distinct()
    sq = tiles.select("stand", "ti", "tj", (F.col("ti") * 16 + 8.0).alias("x"), (F.col("tj") * 16 + 8.0).alias("y"))
    return P.squares_touching(sq, fx.fx_edges, 8.0)


@query("c20_hull_setback", "stand:i n:i", """
WITH e AS (SELECT a.stand, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM fx_trees a JOIN fx_trees b ON a.stand = b.stand AND (a.x <> b.x OR a.y <> b.y)
 WHERE (a.x < 12 OR a.x > 88 OR a.y < 12 OR a.y > 88) AND (b.x < 12 OR b.x > 88 OR b.y < 12 OR b.y > 88)
 AND NOT EXISTS (SELECT 1 FROM fx_trees c WHERE c.stand = a.stand AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))
SELECT t.stand, count(*) AS n FROM fx_trees t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.stand = t.stand AND
 ((x2-x1)*(t.y-y1) - (y2-y1)*(t.x-x1)) / sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) < 5) GROUP BY t.stand""")
def _(fx):
    hull = P.hull_edges(P.hull_vertices(fx.fx_trees, ["stand"]), ["stand"])
    return P.within_setback(fx.fx_trees, hull, 5.0).groupBy("stand").agg(F.count(F.lit(1)).alias("n"))


@query("c21_close_pairs", "stand:i pairs:i involved:i", """
WITH p AS (SELECT a.stand, a.tree_id AS a, b.tree_id AS b FROM fx_trees a JOIN fx_trees b ON a.stand = b.stand AND a.tree_id < b.tree_id
 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) < 2.56)
SELECT stand, count(*) AS pairs, (SELECT count(DISTINCT i) FROM (SELECT a AS i FROM p q WHERE q.stand = p.stand UNION ALL SELECT b FROM p q WHERE q.stand = p.stand)) AS involved
FROM p GROUP BY stand""")
def _(fx):
    p = S.close_pairs(fx.fx_trees, "tree_id", 1.6)
    ids = p.select("stand", F.explode(F.array("a", "b")).alias("i")).groupBy("stand").agg(F.count_distinct("i").alias("involved"))
    return p.groupBy("stand").agg(F.count(F.lit(1)).alias("pairs")).join(ids, "stand")


@query("c22_common_keys", "stand:i n:i", """
SELECT stand, count(*) AS n FROM fx_trees WHERE tree_id IN (SELECT tree_id FROM fx_detections WHERE view_id = 0)
 AND tree_id IN (SELECT tree_id FROM fx_detections WHERE view_id = 1) GROUP BY stand""")
def _(fx):
    d = fx.fx_detections
    return (fx.fx_trees.join(d.where("view_id = 0"), "tree_id", "left_semi").join(d.where("view_id = 1"), "tree_id", "left_semi")
            .groupBy("stand").agg(F.count(F.lit(1)).alias("n")))


@query("c23_interpolating_join", "plot:i expected:d outside:b", """
WITH r AS (SELECT stand, plot, ln(n_obs + plot / 1000.0) AS t, n_obs / n_field AS v FROM fx_panel),
c AS (SELECT * FROM r WHERE (plot // 6) % 3 <> 0), q AS (SELECT * FROM r WHERE (plot // 6) % 3 = 0),
lo AS (SELECT q.plot, arg_max(c.t, c.t) AS t, arg_max(c.v, c.t) AS v FROM q JOIN c ON q.stand = c.stand AND c.t <= q.t GROUP BY q.plot),
hi AS (SELECT q.plot, arg_min(c.t, c.t) AS t, arg_min(c.v, c.t) AS v FROM q JOIN c ON q.stand = c.stand AND c.t >= q.t GROUP BY q.plot)
SELECT q.plot, CASE WHEN lo.t IS NULL THEN hi.v WHEN hi.t IS NULL THEN lo.v ELSE lo.v + (hi.v - lo.v) * (q.t - lo.t) / (hi.t - lo.t) END AS expected,
 lo.t IS NULL OR hi.t IS NULL AS outside FROM q LEFT JOIN lo ON lo.plot = q.plot LEFT JOIN hi ON hi.plot = q.plot
WHERE q.stand IN (SELECT stand FROM c GROUP BY stand HAVING count(*) >= 3)""")
def _(fx):
    r = fx.fx_panel.select("stand", "plot", F.log(F.col("n_obs") + F.col("plot") / 1000.0).alias("t"), (F.col("n_obs") / F.col("n_field")).alias("v"))
    return A.interpolate(r.where("plot div 6 % 3 = 0").select("stand", "plot", "t"), r.where("plot div 6 % 3 <> 0"), "stand")


@query("c24_relative_to_own", "tile:s condition:i rel:d", """
WITH c AS (SELECT tile, pid % 4 AS condition, count(*) AS n FROM fx_labelled GROUP BY 1, 2)
SELECT c.tile, c.condition, 100.0 * c.n / f.n AS rel FROM c JOIN c f ON f.tile = c.tile AND f.condition = 0""")
def _(fx):
    c = fx.fx_labelled.groupBy("tile", (F.col("pid") % 4).alias("condition")).agg(F.count(F.lit(1)).alias("n"))
    full = c.where("condition = 0").select("tile", F.col("n").alias("full"))
    return c.join(full, "tile").withColumn("rel", 100.0 * F.col("n") / F.col("full"))


@query("c25_largest_instance_per_stem", "stem:i inst:i n_pts:i", """
WITH q AS (SELECT inst, quantile_cont(z, 0.1) AS q, count(*) AS n_pts FROM fx_tree_pts GROUP BY inst),
b AS (SELECT p.inst, n_pts, avg(x) AS x, avg(y) AS y FROM fx_tree_pts p JOIN q ON p.inst = q.inst WHERE z <= q GROUP BY 1, 2),
n AS (SELECT b.inst, n_pts, stem, row_number() OVER (PARTITION BY b.inst ORDER BY (x-cx)*(x-cx) + (y-cy)*(y-cy), stem) AS k
 FROM b JOIN fx_stems ON (x-cx)*(x-cx) + (y-cy)*(y-cy) <= 4)
SELECT stem, inst, n_pts FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n_pts DESC, inst) AS m FROM n WHERE k = 1) WHERE m = 1""")
def _(fx):
    b = A.stem_base(fx.fx_tree_pts, ["inst"]).withColumn("stand", F.lit(0))
    return A.claim_stems(b, fx.fx_stems.select(F.lit(0).alias("stand"), "stem", "cx", "cy"))


@query("c26_lineage_link", "tile:s n_pts:i missing:b", """
WITH m AS (SELECT DISTINCT tile FROM fx_labelled), o AS (SELECT tile || '_round2' AS name, count(*) AS n FROM fx_labelled WHERE tile NOT LIKE '%3_p1' GROUP BY tile)
SELECT m.tile, n AS n_pts, n IS NULL AS missing FROM m LEFT JOIN o ON split_part(o.name, '_round', 1) = m.tile""")
def _(fx):
    man = fx.fx_labelled.select("tile").distinct()
    out = (fx.fx_labelled.where("tile not like '%3_p1'").groupBy(F.concat("tile", F.lit("_round2")).alias("name"))
           .agg(F.count(F.lit(1)).alias("n_pts")))
    out = out.select(F.regexp_extract("name", "^(t[0-9]+_p[0-9]+)", 1).alias("tile"), "n_pts")
    return man.join(out, "tile", "left").withColumn("missing", F.col("n_pts").isNull())


@query("c27_disc_sum", "tree_id:i total:i", """
WITH c AS (SELECT stand, CAST(floor(x / 0.25) AS BIGINT) AS ix, CAST(floor(y / 0.25) AS BIGINT) AS iy, count(*) AS v FROM fx_points WHERE z BETWEEN 1 AND 8 GROUP BY 1, 2, 3)
SELECT t.tree_id, coalesce(sum(v), 0) AS total FROM fx_trees t LEFT JOIN c ON c.stand = t.stand AND
 ((ix + 0.5) * 0.25 - t.x) * ((ix + 0.5) * 0.25 - t.x) + ((iy + 0.5) * 0.25 - t.y) * ((iy + 0.5) * 0.25 - t.y) <= 1 GROUP BY t.tree_id""")
def _(fx):
    c = fx.fx_points.where("z between 1 and 8").groupBy("stand", S.cell("x", 0.25).alias("ix"), S.cell("y", 0.25).alias("iy")).agg(F.count(F.lit(1)).alias("v"))
    return A.disc_sums(fx.fx_trees, c, 1.0, 0.25, pid="tree_id")


LENSP = """CASE WHEN d >= rc + rp THEN 0 WHEN d <= abs(rp - rc) THEN pi() * least(rc, rp) * least(rc, rp) ELSE
 rc*rc * (acos((d*d + rc*rc - rp*rp) / (2*d*rc)) - sin(2 * acos((d*d + rc*rc - rp*rp) / (2*d*rc))) / 2)
 + rp*rp * (acos((d*d + rp*rp - rc*rc) / (2*d*rp)) - sin(2 * acos((d*d + rp*rp - rc*rc) / (2*d*rp))) / 2) END"""


@query("c28_crown_overlap", "plot:i n_disc:d n_cont:d g_disc:d g_cont:d", f"""
WITH j AS (SELECT plot, CAST(11.28 AS DOUBLE) AS rp, CAST(0.0927 AS DOUBLE) * dbh_cm AS rc, pi() * (dbh_cm / 200) * (dbh_cm / 200) AS g,
 sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) AS d FROM fx_plots p JOIN fx_trees t ON p.stand = t.stand AND abs(x - cx) < 16 AND abs(y - cy) < 16),
w AS (SELECT *, {LENSP} / (pi() * rc * rc) AS w FROM j WHERE d <= rp + rc),
s AS (SELECT plot, sum(CASE WHEN d <= rp THEN 1.0 ELSE 0 END) AS a, sum(w) AS b, sum(CASE WHEN d <= rp THEN g ELSE 0 END) AS c, sum(w * g) AS e FROM w GROUP BY plot)
SELECT p.plot, coalesce(a, 0) / ha AS n_disc, coalesce(b, 0) / ha AS n_cont, coalesce(c, 0) / ha AS g_disc, coalesce(e, 0) / ha AS g_cont
FROM (SELECT plot, pi() * CAST(11.28 AS DOUBLE) * CAST(11.28 AS DOUBLE) / 10000 AS ha FROM fx_plots) p LEFT JOIN s ON s.plot = p.plot""")
def _(fx):
    trees = fx.fx_trees.select("stand", "x", "y", (F.lit(0.0927) * F.col("dbh_cm")).alias("rc"),
                               (F.pi() * X.sq(F.col("dbh_cm") / 200)).alias("basal"))
    return A.crown_overlap(fx.fx_plots.select(*PLOTS, F.lit(11.28).alias("rp")), trees, 11.28 + 0.0927 * 30)


@query("c29_position_recall", "strategy:i radius:d n:i recall:d", """
WITH b AS (SELECT DISTINCT t.tree_id, t.stand, t.x, t.y FROM fx_trees t JOIN fx_plots p ON t.stand = p.stand AND abs(t.x - cx) <= 32 AND abs(t.y - cy) <= 32),
h AS (SELECT v.view_id, r.radius, b.tree_id, count(d.det_id) > 0 AS hit FROM b CROSS JOIN (SELECT DISTINCT view_id FROM fx_detections) v
 CROSS JOIN (VALUES (0.5), (1.0), (1.5)) r(radius) LEFT JOIN fx_detections d ON d.stand = b.stand AND d.view_id = v.view_id
 AND (b.x-d.x)*(b.x-d.x) + (b.y-d.y)*(b.y-d.y) <= r.radius * r.radius GROUP BY 1, 2, 3)
SELECT view_id AS strategy, radius, count(*) AS n, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS recall FROM h GROUP BY 1, 2""")
def _(fx):
    box = S.grid_join(fx.fx_trees.select("stand", "tree_id", "x", "y"), fx.fx_plots.select(*PLOTS), 32 * math.sqrt(2) + 1e-9)
    box = box.where(T.in_square("cx", "cy", 32.0)).select("stand", F.col("tree_id").alias("rid"), "x", "y").distinct()
    box = box.withColumn("view_id", F.explode(F.sequence(F.lit(0), F.lit(8))))
    h = A.hits(box, fx.fx_detections.withColumnRenamed("det_id", "did"), 1.5, ["stand", "view_id"])
    h = T.with_params(h, [{"radius": r} for r in (0.5, 1.0, 1.5)])
    ok = F.coalesce(F.col("d2") <= F.col("radius") * F.col("radius"), F.lit(False))
    return h.groupBy(F.col("view_id").alias("strategy"), "radius").agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("recall"))


@query("c30_control_positions", "stand:i n:i", f"""
WITH g AS (SELECT stand, tree_id, 100 * {uniform_sql('tree_id', 11)} AS x, 100 * {uniform_sql('tree_id', 12)} AS y FROM fx_trees)
SELECT stand, count(*) AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM fx_trees t WHERE t.stand = g.stand AND
 (t.x-g.x)*(t.x-g.x) + (t.y-g.y)*(t.y-g.y) <= 0.64) GROUP BY stand""")
def _(fx):
    g = fx.fx_trees.select("stand", F.col("tree_id").alias("pid"), (100 * uniform("tree_id", 11)).alias("x"), (100 * uniform("tree_id", 12)).alias("y"))
    return A.outside_all(g, stems_of(fx), 0.8).groupBy("stand").agg(F.count(F.lit(1)).alias("n"))
