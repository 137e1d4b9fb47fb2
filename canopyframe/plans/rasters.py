"""Rasters, cells, plots and crown metrics."""
from pyspark.sql import functions as F

from canopyframe.functions import scalars as X
from canopyframe.operators import assign as A, metrics as Q, raster as R, transforms as T
from canopyframe.operators.metrics import EXTRA_PERCENTILES
from canopyframe.operators.ranks import exact_quantiles, sorted_index
from canopyframe.operators.spatial import grid_join
from canopyframe.plans.joins import PLOTS
from canopyframe.plans.registry import query
from canopyframe.plans.scans import IN_PLOT


def canopy(fx):
    return fx.fx_points.where("classification not in (2, 18)").select("stand", "x", "y", "z")


CANOPY = "(SELECT * FROM fx_points WHERE classification NOT IN (2, 18))"


def cells_sql(res, agg="max(z)", src=CANOPY, pad=0):
    return f"""SELECT stand, CAST(floor((x - x0) / {res}) AS BIGINT) AS ix, CAST(floor((y - y0) / {res}) AS BIGINT) AS iy, {agg} AS v,
 any_value(x0) AS x0, any_value(y0) AS y0, any_value(nx) AS nx, any_value(ny) AS ny FROM (SELECT *, CAST(floor((x1 - x0) / {res}) AS BIGINT) + 1 AS nx,
 CAST(floor((y1 - y0) / {res}) AS BIGINT) + 1 AS ny FROM (SELECT *, min(x) OVER (PARTITION BY stand) - {pad} AS x0, min(y) OVER (PARTITION BY stand) - {pad} AS y0,
 max(x) OVER (PARTITION BY stand) AS x1, max(y) OVER (PARTITION BY stand) AS y1 FROM {src})) GROUP BY 1, 2, 3"""


def scatter_sql(src, weights, axis):
    n, other = ("nx", "iy") if axis == "ix" else ("ny", "ix")
    r = len(weights) // 2
    taps = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-r, r + 1), weights))
    img = f"unnest([{axis} - k, -1 - {axis} - k, 2 * {n} - 1 - {axis} - k])"
    return f"""SELECT stand, t AS {axis}, {other}, sum(v * w) AS v, any_value(x0) AS x0, any_value(y0) AS y0, any_value(nx) AS nx, any_value(ny) AS ny
 FROM (SELECT *, {img} AS t FROM ({src}) CROSS JOIN (VALUES {taps}) w(k, w)) WHERE t >= 0 AND t < {n} GROUP BY stand, t, {other}"""


def smooth_sql(src, sigma):
    w = R.gaussian_weights(sigma)
    return scatter_sql(scatter_sql(src, w, "ix"), w, "iy")


def tops_sql(src, res, half, hmin, sigma):
    return f"""SELECT c.stand, c.x0 + (c.ix + 0.5) * {res} AS x, c.y0 + (c.iy + 0.5) * {res} AS y, c.v AS h FROM c JOIN s ON c.stand = s.stand AND c.ix = s.ix AND c.iy = s.iy
 WHERE c.v > {hmin} AND s.v >= (SELECT max(o.v) FROM s o WHERE o.stand = s.stand AND o.ix BETWEEN s.ix - {half} AND s.ix + {half} AND o.iy BETWEEN s.iy - {half} AND s.iy + {half})"""


@query("d01_canopy_height_model", "stand:i ix:i iy:i v:d", f"SELECT stand, ix, iy, v FROM ({cells_sql(0.5)})")
def _(fx):
    return R.rasterise(canopy(fx), 0.5)


@query("d02_fill_gaps", "stand:i ix:i iy:i v:d", f"""
WITH c AS ({cells_sql(2.0)}), g AS (SELECT stand, nx, ny FROM c GROUP BY ALL),
e AS (SELECT stand, ix, iy FROM (SELECT stand, ix, unnest(range(0, ny)) AS iy FROM (SELECT stand, ny, unnest(range(0, nx)) AS ix FROM g)) d ANTI JOIN c USING (stand, ix, iy))
SELECT stand, ix, iy, v FROM c UNION ALL SELECT stand, ix, iy, v FROM (SELECT e.stand, e.ix, e.iy, c.v, row_number() OVER (PARTITION BY e.stand, e.ix, e.iy
 ORDER BY (c.ix-e.ix)*(c.ix-e.ix) + (c.iy-e.iy)*(c.iy-e.iy), c.ix * 10000000 + c.iy) AS k FROM e JOIN c ON e.stand = c.stand AND abs(c.ix-e.ix) <= 8 AND abs(c.iy-e.iy) <= 8) WHERE k = 1""")
def _(fx):
    return R.fill_gaps(R.rasterise(canopy(fx), 2.0))


@query("d03_gaussian_smoothing", "stand:i ix:i iy:i v:d", smooth_sql(cells_sql(1.0), 0.6))
def _(fx):
    return R.smooth(R.rasterise(canopy(fx), 1.0), 0.6)


@query("d04_treetops", "stand:i x:d y:d h:d", f"WITH c AS ({cells_sql(1.0)}), s AS ({smooth_sql(cells_sql(1.0), 0.6)}) {tops_sql('', 1.0, 2, 5.0, 0.6)}")
def _(fx):
    return R.treetops(R.rasterise(canopy(fx), 1.0), 1.0)


@query("d05_watershed_crowns", "stand:i x:d y:d h:d n_cells:i tol:d")
def _(fx):
    cells = R.basins(R.rasterise(canopy(fx), 1.0))
    depths = R.merge_depths(cells)
    out = None
    for tol in (None, 1.0):
        c = R.crowns(cells, depths, tol, 1.0).withColumn("tol", F.lit(tol).cast("double"))
        out = c if out is None else out.unionByName(c)
    return out


GROUND2 = f"""WITH c AS ({cells_sql(2.0, 'min(z)', 'fx_points', 1)}), g AS (SELECT stand, nx, ny, x0, y0 FROM c GROUP BY ALL),
e AS (SELECT stand, nx, ny, x0, y0, ix, iy FROM (SELECT stand, nx, ny, x0, y0, ix, unnest(range(0, ny)) AS iy FROM (SELECT *, unnest(range(0, nx)) AS ix FROM g)) d ANTI JOIN c USING (stand, ix, iy)),
f AS (SELECT stand, ix, iy, v, x0, y0, nx, ny FROM c UNION ALL SELECT stand, ix, iy, v, x0, y0, nx, ny FROM (SELECT e.*, c.v, row_number() OVER (PARTITION BY e.stand, e.ix, e.iy
 ORDER BY (c.ix-e.ix)*(c.ix-e.ix) + (c.iy-e.iy)*(c.iy-e.iy), c.ix * 10000000 + c.iy) AS k FROM e JOIN c ON e.stand = c.stand AND abs(c.ix-e.ix) <= 8 AND abs(c.iy-e.iy) <= 8) WHERE k = 1),
t AS ({scatter_sql(scatter_sql('SELECT * FROM f', [1 / 7] * 7, 'ix'), [1 / 7] * 7, 'iy')})"""


@query("d06_terrain_model", "stand:i ix:i iy:i v:d", f"{GROUND2} SELECT stand, ix, iy, v FROM t")
def _(fx):
    return R.terrain(fx.fx_points.select("stand", "x", "y", "z"), 2.0, 7)


H_JOIN = """(SELECT p.*, p.z - t.v AS h FROM fx_points p JOIN g ON p.stand = g.stand JOIN t ON t.stand = p.stand
 AND t.ix = CAST(floor((p.x - g.x0) / 2.0) AS BIGINT) AND t.iy = CAST(floor((p.y - g.y0) / 2.0) AS BIGINT))"""


@query("d07_height_above_terrain", "stand:i n:i hmean:d hmax:d", f"{GROUND2} SELECT stand, count(*) AS n, avg(h) AS hmean, max(h) AS hmax FROM {H_JOIN} GROUP BY stand")
def _(fx):
    p = fx.fx_points.select("stand", "x", "y", "z")
    h = R.above_terrain(p, R.terrain(p, 2.0, 7), 2.0)
    return h.groupBy("stand").agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("hmean"), F.max("h").alias("hmax"))


@query("d08_breast_height_slab", "stand:i ix:i iy:i v:i", f"""{GROUND2} SELECT stand, CAST(floor(x / 0.25) AS BIGINT) AS ix, CAST(floor(y / 0.25) AS BIGINT) AS iy, count(*) AS v
 FROM {H_JOIN} WHERE h > 1 AND h < 3 GROUP BY 1, 2, 3""")
def _(fx):
    p = fx.fx_points.select("stand", "x", "y", "z")
    h = R.above_terrain(p, R.terrain(p, 2.0, 7), 2.0).where("h > 1 and h < 3")
    return h.groupBy("stand", F.floor(F.col("x") / 0.25).alias("ix"), F.floor(F.col("y") / 0.25).alias("iy")).agg(F.count(F.lit(1)).alias("v"))


def metrics_sql(src, key):
    return f"""WITH p AS ({src}) SELECT {key}, n_pts, zmax, zmean, zsd, zq50, zq90, pz AS pzabovezmean FROM (
 SELECT {key}, count(*) AS n_pts, max(z) AS zmax, avg(z) AS zmean, stddev_samp(z) AS zsd, quantile_cont(z, 0.5) AS zq50, quantile_cont(z, 0.9) AS zq90,
 100 * avg(CASE WHEN z > m THEN 1.0 ELSE 0.0 END) AS pz FROM (SELECT *, avg(z) OVER (PARTITION BY {key}) AS m FROM p) GROUP BY {key})"""


@query("d09_height_metrics", "inst:i n_pts:i zmax:d zmean:d zsd:d zq50:d zq90:d pzabovezmean:d",
       metrics_sql("SELECT * FROM fx_tree_pts WHERE z BETWEEN 2 AND 45", "inst"))
def _(fx):
    return Q.height_metrics(fx.fx_tree_pts.where("z between 2 and 45"), ["inst"])


@query("d10_plot_footprint_metrics", "plot:i n_pts:i zmax:d zmean:d zsd:d zq50:d zq90:d pzabovezmean:d",
       metrics_sql(f"SELECT * FROM ({IN_PLOT}) WHERE z BETWEEN 2 AND 45 AND classification NOT IN (2, 18)", "plot"))
def _(fx):
    p = A.in_zones(canopy(fx).where("z between 2 and 45"), fx.fx_plots.select(*PLOTS), 12.0)
    return Q.height_metrics(p.select("plot", "z"), ["plot"])


CELLS20 = """SELECT *, CAST(floor((x - mx) / 20) AS BIGINT) AS ix, CAST(floor((y - my) / 20) AS BIGINT) AS iy FROM (SELECT *, min(x) OVER (PARTITION BY stand) AS mx,
 min(y) OVER (PARTITION BY stand) AS my FROM fx_points WHERE classification NOT IN (2, 18) AND z BETWEEN 2 AND 45)"""


@query("d11_cell_metrics", "stand:i ix:i iy:i x0:d n_pts:i zmax:d zmean:d zsd:d zq50:d zq90:d pzabovezmean:d", f"""
SELECT * FROM ({metrics_sql(CELLS20, 'stand, ix, iy')}) JOIN (SELECT stand, ix, iy, min(mx + ix * 20) AS x0 FROM ({CELLS20}) GROUP BY 1, 2, 3) USING (stand, ix, iy) WHERE n_pts >= 20""")
def _(fx):
    good, skipped = Q.split_finite(Q.cell_metrics(canopy(fx), 20.0), ["zmax", "zmean", "zsd", "zq50", "zq90", "pzabovezmean"])
    return good


def distribution_sql(src, key):
    pc = ", ".join(f"100 * avg(CASE WHEN z <= lo + (hi - lo) * {k} / 10.0 THEN 1.0 ELSE 0.0 END) AS zpcum{k}" for k in range(1, 10))
    qs = ", ".join(f"quantile_cont(z, {p / 100}) AS zq{p}" for p in EXTRA_PERCENTILES)
    return f"""WITH p0 AS ({src}), p AS (SELECT {key}, z, CAST(count(*) OVER w AS DOUBLE) AS n, min(z) OVER w AS lo, max(z) OVER w AS hi, avg(z) OVER w AS mu,
  CAST(row_number() OVER (PARTITION BY {key} ORDER BY z) - 1 AS DOUBLE) AS i, median(z) OVER w AS med FROM p0 WINDOW w AS (PARTITION BY {key})),
 b AS (SELECT {key}, avg(z) AS b0, sum(i / (n - 1) * z) / max(n) AS b1, sum(i * (i - 1) / ((n - 1) * (n - 2)) * z) / max(n) AS b2,
  sum(i * (i - 1) * (i - 2) / ((n - 1) * (n - 2) * (n - 3)) * z) / max(n) AS b3, {pc}, {qs}, avg(abs(z - mu)) AS zMADmean, median(abs(z - med)) AS zMADmedian,
  quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS ziqr, max((mu - lo) / (hi - lo)) AS CRR, 100 * avg(CASE WHEN z > mu THEN 1.0 ELSE 0.0 END) AS pzabovemean,
  100 * avg(CASE WHEN z > 2 THEN 1.0 ELSE 0.0 END) AS pzabove2, 100 * avg(CASE WHEN z > 5 THEN 1.0 ELSE 0.0 END) AS pzabove5 FROM p WHERE n >= 4 GROUP BY {key}),
 e1 AS (SELECT {key}, -sum(c / n * ln(c / n)) / ln(10) AS VCI FROM (SELECT {key}, n, least(9, floor((z - lo) / (hi - lo) * 10)) AS k, count(*) AS c FROM p GROUP BY {key}, n, k) GROUP BY {key}),
 e2 AS (SELECT {key}, -sum(c / n * ln(c / n)) AS zentropy FROM (SELECT {key}, n, least(floor(sqrt(n)) - 1, floor((z - lo) / (hi - lo) * floor(sqrt(n)))) AS k, count(*) AS c FROM p GROUP BY {key}, n, k) GROUP BY {key})
 SELECT b.*, b0 AS L1, 2*b1 - b0 AS L2, 6*b2 - 6*b1 + b0 AS L3, 20*b3 - 30*b2 + 12*b1 - b0 AS L4, (6*b2 - 6*b1 + b0) / (2*b1 - b0) AS Lskew,
  (20*b3 - 30*b2 + 12*b1 - b0) / (2*b1 - b0) AS Lkurt, (2*b1 - b0) / b0 AS Lcoefvar, VCI, zentropy FROM b JOIN e1 USING ({key}) JOIN e2 USING ({key})"""


DIST_COLS = " ".join([f"zpcum{k}:d" for k in range(1, 10)] + ["VCI:d CRR:d ziqr:d zMADmean:d zMADmedian:d zentropy:d"]
                     + [f"zq{p}:d" for p in EXTRA_PERCENTILES] + ["pzabovemean:d pzabove2:d pzabove5:d"])
LMOM_COLS = "L1:d L2:d L3:d L4:d Lskew:d Lkurt:d Lcoefvar:d"


@query("d12_height_distribution", "inst:i " + DIST_COLS, distribution_sql("SELECT * FROM fx_tree_pts WHERE semantic = 2", "inst"))
def _(fx):
    return Q.height_distribution(fx.fx_tree_pts.where("semantic = 2"), ["inst"])


@query("d13_l_moments", "plot:i " + LMOM_COLS, distribution_sql(f"SELECT * FROM ({IN_PLOT}) WHERE classification NOT IN (2, 18)", "plot"))
def _(fx):
    p = A.in_zones(canopy(fx), fx.fx_plots.select(*PLOTS), 12.0)
    return Q.height_distribution(p.select("plot", "z"), ["plot"])


def voxel_sql(src, key, s=0.25):
    return f"""WITH p0 AS ({src}), b AS (SELECT {key}, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz FROM p0 GROUP BY {key}),
 v AS (SELECT DISTINCT {key}, CAST(floor((x - lx) / {s}) AS BIGINT) AS vx, CAST(floor((y - ly) / {s}) AS BIGINT) AS vy, CAST(floor((z - lz) / {s}) AS BIGINT) AS vz FROM p0 JOIN b USING ({key})),
 l AS (SELECT v.{key}, vz, min(vz) OVER w AS a, max(vz) OVER w AS bb, avg(vz) OVER w AS mu, count(*) OVER w AS t, greatest(1, floor(sz / {s})) AS nb FROM v JOIN b ON b.{key} = v.{key} WINDOW w AS (PARTITION BY v.{key})),
 h AS (SELECT {key}, hb, count(*) / max(CAST(t AS DOUBLE)) AS p FROM (SELECT *, least(nb - 1, floor((vz - a) / CAST(bb - a AS DOUBLE) * nb)) AS hb FROM l) GROUP BY 1, 2),
 e AS (SELECT {key}, -sum(p * ln(p + 1e-10)) AS ent FROM h GROUP BY {key}),
 m AS (SELECT {key}, avg((vz - mu) * (vz - mu)) AS m2, avg((vz - mu) * (vz - mu) * (vz - mu)) AS m3, count(*) AS nv FROM l GROUP BY {key}),
 c AS (SELECT {key}, count(*) AS nc FROM (SELECT DISTINCT {key}, vx, vy FROM v) GROUP BY {key})
 SELECT b.{key}, CAST(nv AS DOUBLE) AS voxel_count, nv * {s ** 3} AS voxel_volume, nv / ((floor(sx / {s}) + 1) * (floor(sy / {s}) + 1) * (floor(sz / {s}) + 1)) AS voxel_density, ent AS voxel_h_entropy,
  m3 / pow(m2, 1.5) AS voxel_h_skewness, 1 - nc / ((floor(sx / {s}) + 1) * (floor(sy / {s}) + 1)) AS voxel_gap_fraction FROM b JOIN e USING ({key}) JOIN m USING ({key}) JOIN c USING ({key})"""


VOXEL_COLS = "voxel_count:d voxel_volume:d voxel_density:d voxel_h_entropy:d voxel_h_skewness:d voxel_gap_fraction:d"


@query("d14_voxel_metrics", "inst:i " + VOXEL_COLS, voxel_sql("SELECT * FROM fx_tree_pts", "inst"))
def _(fx):
    return Q.voxel_metrics(fx.fx_tree_pts, ["inst"])


@query("d15_biomass_index", "inst:i lbi:d", "SELECT inst, sum(1 / ((100 - z) * (100 - z))) AS lbi FROM fx_tree_pts GROUP BY inst HAVING count(*) >= 3")
def _(fx):
    return Q.biomass_index(fx.fx_tree_pts, ["inst"])


@query("d16_crown_block", "inst:i n_points:i H_max:d H_min:d H_mean:d H_std:d z99:d crown_diameter:d", """
SELECT inst, count(*) AS n_points, max(z) AS H_max, min(z) AS H_min, avg(z) AS H_mean, stddev_pop(z) AS H_std, quantile_cont(z, 0.99) AS z99,
 2 * max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS crown_diameter FROM (SELECT *, avg(x) OVER (PARTITION BY inst) AS mx, avg(y) OVER (PARTITION BY inst) AS my
 FROM fx_tree_pts WHERE semantic = 2) GROUP BY inst""")
def _(fx):
    return Q.crown_block(fx.fx_tree_pts.where("semantic = 2"), ["inst"])


@query("d18_self_supervision_targets", "inst:i zq10:d zq25:d zq50:d zq75:d zq90:d zq95:d zskew:d zkurt:d pzabovezmean:d q25:d q95:d radius5:d logn10:d sd10:d", """
WITH p AS (SELECT inst, x, y, z, avg(z) OVER w AS m, stddev_samp(z) OVER w AS s, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM fx_tree_pts WHERE semantic = 2 WINDOW w AS (PARTITION BY inst))
SELECT inst, quantile_cont(z, 0.1) AS zq10, quantile_cont(z, 0.25) AS zq25, quantile_cont(z, 0.5) AS zq50, quantile_cont(z, 0.75) AS zq75, quantile_cont(z, 0.9) AS zq90,
 quantile_cont(z, 0.95) AS zq95, avg(pow(z - m, 3)) / pow(max(s), 3) AS zskew, avg(pow(z - m, 4)) / pow(max(s), 4) AS zkurt, 100 * avg(CASE WHEN z > m THEN 1.0 ELSE 0.0 END) AS pzabovezmean,
 (quantile_cont(z, 0.25) - min(z)) / (max(z) - min(z)) AS q25, (quantile_cont(z, 0.95) - min(z)) / (max(z) - min(z)) AS q95,
 max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) / 5 AS radius5, ln(1 + count(*)) / 10 AS logn10, stddev_pop(z) / 10 AS sd10 FROM p GROUP BY inst""")
def _(fx):
    p = fx.fx_tree_pts.where("semantic = 2")
    return Q.shape_vector(p, ["inst"]).join(Q.scaled_crown(p, ["inst"]), "inst")


COVER = """SELECT plot, avg(CASE WHEN z > 2 THEN 1.0 ELSE 0.0 END) AS cover, 1 - avg(CASE WHEN z > 2 THEN 1.0 ELSE 0.0 END) AS gap_fraction,
 avg(CASE WHEN z <= lo + 0.5 * (hi - lo) THEN 1.0 ELSE 0.0 END) AS penetration FROM (SELECT *, min(z) OVER (PARTITION BY plot) AS lo, max(z) OVER (PARTITION BY plot) AS hi FROM p) GROUP BY plot"""


@query("d19_cover_metrics", "plot:i cover:d gap_fraction:d penetration:d", f"WITH p AS ({IN_PLOT}) {COVER}")
def _(fx):
    return Q.cover_metrics(grid_join(fx.fx_points.select("stand", "x", "y", "z"), fx.fx_plots.select(*PLOTS), 12.0), ["plot"])


@query("d50_dominant_height", "plot:i hdom:d top:d", """
WITH p AS (SELECT p.plot, floor((q.x - (p.cx - 12)) / 4) AS ix, floor((q.y - (p.cy - 12)) / 4) AS iy, max(z) AS v, count(*) AS c FROM fx_plots p JOIN fx_points q ON p.stand = q.stand
 AND (q.x - p.cx) * (q.x - p.cx) + (q.y - p.cy) * (q.y - p.cy) <= 144 WHERE classification NOT IN (2, 18) AND z BETWEEN 2 AND 45 GROUP BY 1, 2, 3),
r AS (SELECT plot, v, row_number() OVER (PARTITION BY plot ORDER BY v DESC) AS k, count(*) OVER (PARTITION BY plot) AS n, sum(c) OVER (PARTITION BY plot) AS t FROM p)
SELECT plot, avg(v) FILTER (k <= greatest(1, floor(n * 0.5))) AS hdom, avg(v) AS top FROM r WHERE t >= 50 GROUP BY plot""")
def _(fx):
    p = A.in_zones(canopy(fx), fx.fx_plots.select(*PLOTS), 12.0)
    return Q.dominant_height(p, ["plot"]).join(Q.dominant_height(p, ["plot"], share=1.0).withColumnRenamed("hdom", "top"), "plot")


@query("d51_height_above_stems", "stem:i h:d", """
SELECT t.tree_id AS stem, quantile_cont(z, 0.995) AS h FROM fx_trees t JOIN fx_points p ON t.stand = p.stand AND (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) <= 6.25
 WHERE classification NOT IN (2, 18) GROUP BY 1 HAVING count(*) >= 20""")
def _(fx):
    s = fx.fx_trees.select("stand", F.col("tree_id").alias("stem"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = A.in_zones(canopy(fx), s, 2.5)
    many = near.groupBy("stem").count().where("count >= 20").select("stem")
    return exact_quantiles(near.join(many, "stem", "left_semi"), ["stem"], "z", {"h": 0.995})


def rumple_sql(key, res):
    return f"""g AS (SELECT {key}, nx, ny, ix, unnest(range(0, ny)) AS iy FROM (SELECT {key}, nx, ny, unnest(range(0, nx)) AS ix FROM (SELECT DISTINCT {key}, nx, ny FROM c))),
 d AS (SELECT g.*, coalesce(c.v, 0) AS v FROM g LEFT JOIN c USING ({key}, ix, iy)),
 s AS (SELECT *, lead(v) OVER wx AS ex, lag(v) OVER wx AS bx, lead(v) OVER wy AS ey, lag(v) OVER wy AS byy FROM d WINDOW wx AS (PARTITION BY {key}, iy ORDER BY ix), wy AS (PARTITION BY {key}, ix ORDER BY iy)),
 rum AS (SELECT {key}, avg(sqrt(1 + gx * gx + gy * gy)) AS rumple FROM (SELECT {key}, CASE WHEN bx IS NULL THEN (ex - v) / {res} WHEN ex IS NULL THEN (v - bx) / {res} ELSE (ex - bx) / (2 * {res}) END AS gx,
  CASE WHEN byy IS NULL THEN (ey - v) / {res} WHEN ey IS NULL THEN (v - byy) / {res} ELSE (ey - byy) / (2 * {res}) END AS gy FROM s) GROUP BY {key})"""


@query("d52_rumple", "stand:i rumple:d", f"WITH c AS ({cells_sql(1.0)}), {rumple_sql('stand', 1.0)} SELECT stand, rumple FROM rum")
def _(fx):
    return R.rumple(R.rasterise(canopy(fx), 1.0), 1.0)


@query("d53_plot_structure", "plot:i rumple:d cover:d gap_fraction:d penetration:d zmean:d n:i", f"""
WITH q AS ({IN_PLOT}), k AS (SELECT * FROM q WHERE z BETWEEN 2 AND 45), c AS (SELECT * RENAME (stand AS plot) FROM ({cells_sql(0.5, src='(SELECT * EXCLUDE (stand), plot AS stand FROM k)')})),
{rumple_sql('plot', 0.5)}, cov AS (SELECT plot, avg(CASE WHEN z > 2 THEN 1.0 ELSE 0.0 END) AS cover FROM q GROUP BY plot),
pen AS (SELECT plot, avg(CASE WHEN z <= lo + 0.5 * (hi - lo) THEN 1.0 ELSE 0.0 END) AS penetration, avg(z) AS zmean, count(*) AS n FROM (SELECT *, min(z) OVER (PARTITION BY plot) AS lo, max(z) OVER (PARTITION BY plot) AS hi FROM k) GROUP BY plot)
SELECT plot, rumple, cover, 1 - cover AS gap_fraction, penetration, zmean, n FROM rum JOIN cov USING (plot) JOIN pen USING (plot) WHERE n >= 10""")
def _(fx):
    allp = grid_join(fx.fx_points.select("stand", "x", "y", "z"), fx.fx_plots.select(*PLOTS), 12.0).drop("d2", "cx", "cy", "stand")
    k = allp.where("z between 2 and 45")
    rum = R.rumple(R.rasterise(k, 0.5, ["plot"]), 0.5, ["plot"])
    cov = Q.cover_metrics(allp, ["plot"]).select("plot", "cover", "gap_fraction")
    pen = Q.cover_metrics(k, ["plot"]).select("plot", "penetration")
    n = k.groupBy("plot").agg(F.avg("z").alias("zmean"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    return rum.join(cov, "plot").join(pen, "plot").join(n, "plot")


@query("d54_canopy_image", "plot:i px:i py:i top:d density:d spread:d", f"""
SELECT plot, px, py, least(max(z), 45) AS top, ln(1 + count(*)) AS density, stddev_pop(z) AS spread FROM (SELECT q.z, p.plot,
 least(greatest(floor((q.x - p.cx + 12) / 24 * 32), 0), 31) AS px, least(greatest(floor((q.y - p.cy + 12) / 24 * 32), 0), 31) AS py FROM fx_plots p JOIN fx_points q ON p.stand = q.stand
 AND (q.x - p.cx) * (q.x - p.cx) + (q.y - p.cy) * (q.y - p.cy) <= 144 WHERE z BETWEEN 2 AND 45) WHERE (px - 15.5) * (px - 15.5) + (py - 15.5) * (py - 15.5) <= 256 GROUP BY 1, 2, 3""")
def _(fx):
    return Q.canopy_image(grid_join(fx.fx_points.select("stand", "x", "y", "z"), fx.fx_plots.select(*PLOTS), 12.0), ["plot"])


@query("d55_sampled_plot_chm", "inst:i ix:i iy:i v:d", """
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY %s, x, y, z) AS r FROM fx_tree_pts) WHERE r <= 256)
SELECT inst, CAST(floor((x - mx) / 0.2) AS BIGINT) AS ix, CAST(floor((y - my) / 0.2) AS BIGINT) AS iy, max(z) AS v FROM (SELECT *, min(x) OVER (PARTITION BY inst) AS mx, min(y) OVER (PARTITION BY inst) AS my FROM s)
GROUP BY 1, 2, 3""" % __import__("canopyframe.functions.hashing", fromlist=["mix_sql"]).mix_sql("pid", "CAST(round(x * 10000) AS BIGINT)", "inst", 4))
def _(fx):
    s = T.take_hashed(fx.fx_tree_pts, ["inst"], F.lit(256), 4, ["pid", "CAST(round(x * 10000) AS BIGINT)", "inst"], ["x", "y", "z"])
    return R.rasterise(s, 0.2, ["inst"])


@query("d56_return_structure", "plot:i n:i single_pulse:d first:d last:d middle:d returns_mean:d returns_sd:d ground_share:d int_mean:d int_sd:d int_q90:d last_over_first:d canopy_over_ground:d", f"""
WITH p AS ({IN_PLOT}), a AS (SELECT plot, count(*) FILTER (z BETWEEN 2 AND 45) AS n, avg(CASE WHEN number_of_returns = 1 THEN 1.0 ELSE 0.0 END) FILTER (z BETWEEN 2 AND 45) AS single_pulse,
 avg(CASE WHEN return_number = 1 THEN 1.0 ELSE 0.0 END) FILTER (z BETWEEN 2 AND 45) AS first, avg(CASE WHEN return_number = number_of_returns THEN 1.0 ELSE 0.0 END) FILTER (z BETWEEN 2 AND 45) AS last,
 avg(CASE WHEN return_number > 1 AND return_number < number_of_returns THEN 1.0 ELSE 0.0 END) FILTER (z BETWEEN 2 AND 45) AS middle, avg(number_of_returns) FILTER (z BETWEEN 2 AND 45) AS returns_mean,
 stddev_pop(number_of_returns) FILTER (z BETWEEN 2 AND 45) AS returns_sd, avg(CASE WHEN classification = 2 THEN 1.0 ELSE 0.0 END) AS ground_share, avg(intensity) FILTER (z BETWEEN 2 AND 45) AS int_mean,
 stddev_pop(intensity) FILTER (z BETWEEN 2 AND 45) AS int_sd, quantile_cont(intensity, 0.9) FILTER (z BETWEEN 2 AND 45) AS int_q90, count(*) FILTER (classification = 2) AS ns,
 avg(intensity) FILTER (classification = 2) AS si FROM p GROUP BY plot)
SELECT *, last / first AS last_over_first, CASE WHEN ns > 50 THEN int_mean / si END AS canopy_over_ground FROM a WHERE n >= 100""")
def _(fx):
    return Q.return_metrics(grid_join(fx.fx_points.drop("scan_angle", "red", "green", "blue", "pid"), fx.fx_plots.select(*PLOTS), 12.0), ["plot"])


@query("d57_colour_indices", "plot:i exg:d exg_sd:d gli:d vari:d ngrdi:d green_share:d red_share:d brightness:d brightness_sd:d", f"""
WITH p AS (SELECT plot, CAST(red AS DOUBLE) AS r, CAST(green AS DOUBLE) AS g, CAST(blue AS DOUBLE) AS b, CAST(red + green + blue AS DOUBLE) AS s FROM ({IN_PLOT}) WHERE z BETWEEN 2 AND 45 AND red + green + blue > 0)
SELECT plot, avg(2 * g / s - r / s - b / s) AS exg, stddev_pop(2 * g / s - r / s - b / s) AS exg_sd, avg((2 * g - r - b) / greatest(2 * g + r + b, 1)) AS gli,
 avg(least(greatest((g - r) / greatest(g + r - b, 1), -2), 2)) AS vari, avg((g - r) / greatest(g + r, 1)) AS ngrdi, avg(g / s) AS green_share, avg(r / s) AS red_share,
 avg(s / 3) AS brightness, stddev_pop(s / 3) AS brightness_sd FROM p GROUP BY plot""")
def _(fx):
    p = fx.fx_points.where("z between 2 and 45").select("stand", "x", "y", "red", "green", "blue")
    return Q.colour_indices(grid_join(p, fx.fx_plots.select(*PLOTS), 12.0), ["plot"])


@query("d82_condition_summary", "condition:i axis:s dmin:d dmax:d dmean:d", """
WITH c AS (SELECT stand, (scan_angle % 4 + 4) % 4 AS condition, count(*) / 10000.0 AS d FROM fx_points GROUP BY 1, 2)
SELECT condition, CASE WHEN condition = 0 THEN 'full' WHEN condition < 3 THEN 'density' ELSE 'angle' END AS axis, min(d) AS dmin, max(d) AS dmax, avg(d) AS dmean FROM c GROUP BY 1, 2""")
def _(fx):
    c = fx.fx_points.groupBy("stand", F.pmod("scan_angle", F.lit(4)).alias("condition")).agg((F.count(F.lit(1)) / 10000.0).alias("d"))
    axis = F.when(F.col("condition") == 0, "full").when(F.col("condition") < 3, "density").otherwise("angle")
    return c.groupBy("condition", axis.alias("axis")).agg(F.min("d").alias("dmin"), F.max("d").alias("dmax"), F.avg("d").alias("dmean"))


@query("d84_site_index_from_heights", "plot:i si:d", f"""
WITH q AS (SELECT plot, any_value(stand) AS stand, quantile_cont(z, 0.95) AS q FROM ({IN_PLOT}) WHERE z BETWEEN 2 AND 45 GROUP BY plot)
SELECT plot, avg(q) OVER (PARTITION BY stand) AS si FROM q""")
def _(fx):
    p = grid_join(fx.fx_points.where("z between 2 and 45").select("stand", "x", "y", "z"), fx.fx_plots.select(*PLOTS), 12.0)
    q = exact_quantiles(p, ["stand", "plot"], "z", {"q": 0.95})
    return Q.with_means(q, ["stand"], si="q")
