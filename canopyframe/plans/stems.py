"""Stem slices, fits and profiles."""
from pyspark.sql import functions as F

from canopyframe.operators import stems as S
from canopyframe.plans.registry import query
from canopyframe.session import cut


def wood(fx):
    s = fx.fx_stems.select(F.col("stem").alias("inst"), "cx", "cy", "r0")
    w = fx.fx_tree_pts.where("semantic = 1").join(s, "inst")
    # written once: filters on what is derived from the coordinates would evaluate the views' formulas anew for each mention
    return cut(w.select("inst", F.col("inst").alias("stem"), "pid", "x", "y", "z", F.col("z").alias("h"), (F.col("x") - F.col("cx")).alias("u"), (F.col("y") - F.col("cy")).alias("v"), F.col("r0").alias("rt"),
                        F.floor(F.col("z") / 0.5).alias("bin")))


WOOD = """(SELECT inst, inst AS stem, pid, x, y, z, z AS h, x - cx AS u, y - cy AS v, r0 AS rt, CAST(floor(z / CAST(0.5 AS DOUBLE)) AS BIGINT) AS bin FROM fx_tree_pts JOIN fx_stems ON stem = inst WHERE semantic = 1)"""
KEY = ["inst", "bin"]


@query("d23_density_profile", "inst:i bin:i n:i viable:b", f"SELECT inst, bin, count(*) AS n, count(*) >= 10 AS viable FROM {WOOD} GROUP BY 1, 2")
def _(fx):
    return S.density_profile(wood(fx).withColumn("z0", F.lit(0.0)), ["inst"])


@query("d24_angular_coverage", "inst:i bin:i coverage:d4", f"""
WITH a AS (SELECT inst, bin, degrees(atan2(y - my, x - mx)) AS a FROM (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM {WOOD} WINDOW w AS (PARTITION BY inst, bin))),
g AS (SELECT inst, bin, a, lead(a) OVER (PARTITION BY inst, bin ORDER BY a) - a AS g FROM a)
SELECT inst, bin, 360 - greatest(coalesce(max(g), 0), 360 - (max(a) - min(a))) AS coverage FROM g GROUP BY 1, 2""")
def _(fx):
    return S.angular_coverage(wood(fx), KEY)


@query("d25_sector_coverage", "inst:i coverage:d", f"SELECT inst, count(DISTINCT floor(degrees(atan2(v, u)) / 15)) * 15 AS coverage FROM {WOOD} GROUP BY inst")
def _(fx):
    return S.sector_coverage(wood(fx), ["inst"])


KASA = f"""(WITH m AS (SELECT inst, bin, avg(x) AS mx, avg(y) AS my FROM {WOOD} GROUP BY 1, 2), s AS (SELECT inst, bin, mx, my, count(*) AS n, sum((x-mx)*(x-mx)) AS uu, sum((x-mx)*(y-my)) AS uv, sum((y-my)*(y-my)) AS vv,
 sum((x-mx)*((x-mx)*(x-mx) + (y-my)*(y-my))) AS uw, sum((y-my)*((x-mx)*(x-mx) + (y-my)*(y-my))) AS vw FROM {WOOD} JOIN m USING (inst, bin) GROUP BY 1, 2, 3, 4),
 f AS (SELECT *, (uw*vv - vw*uv) / (2 * (uu*vv - uv*uv)) AS a, (vw*uu - uw*uv) / (2 * (uu*vv - uv*uv)) AS b FROM s WHERE n >= 10)
 SELECT inst, bin, n, mx + a AS cx, my + b AS cy, sqrt(a*a + b*b + (uu + vv) / n) AS r FROM f)"""


def viable(fx):
    w = wood(fx)
    return w.join(w.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).where("c >= 10").select(*KEY), KEY, "left_semi")


@query("d26_circle_fit", "inst:i bin:i n:i cx:d cy:d r:d", f"SELECT * FROM {KASA}")
def _(fx):
    return S.circle_kasa(viable(fx), KEY)


@query("d26_refined_circle", "inst:i bin:i cx:d cy:d r:d")
def _(fx):
    w = viable(fx)
    return S.refine_circle(w, S.circle_kasa(w, KEY), KEY)


@query("d27_taubin_circle", "inst:i bin:i cx:d cy:d r:d")
def _(fx):
    return S.circle_taubin(viable(fx), KEY)


@query("d28_ransac_circle", "inst:i bin:i cx:d cy:d r:d inliers:i")
def _(fx):
    return S.circle_ransac(cut(viable(fx)), KEY, "pid")


@query("d29_ellipse_fit", "inst:i bin:i cx:d cy:d a:d b:d")
def _(fx):
    return S.ellipse(viable(fx), KEY)


@query("d30_slice_measurement", "inst:i bin:i fit:s d_cm:d residual_cm:d n_points:i coverage:d chi2_p:d chi2_pass:b")
def _(fx):
    return S.measure_slices(wood(fx), KEY, "pid")


@query("d31_circle_residual", "inst:i bin:i rmse:d chi2:d dof:i", f"""
SELECT inst, bin, sqrt(avg(e*e)) AS rmse, CAST(count(*) - 3 AS DOUBLE) AS chi2, count(*) - 3 AS dof FROM (SELECT w.inst, w.bin, sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) - r AS e FROM {WOOD} w JOIN {KASA} k ON w.inst = k.inst AND w.bin = k.bin) GROUP BY 1, 2""")
def _(fx):
    w = viable(fx)
    return S.circle_residual(w, S.circle_kasa(w, KEY), KEY)


@query("d32_adaptive_slices", "inst:i slice:i width:d d_cm:d n_points:i")
def _(fx):
    p = cut(S.slice_candidates(wood(fx).drop("bin"), ["inst"]).select("inst", "slice", "width", "pid", "x", "y"))
    m = S.measure_slices(p, ["inst", "slice", "width"], "pid")
    best = m.groupBy("inst", "slice").agg(F.min(F.struct("width", "d_cm", "n_points")).alias("m"))
    return best.select("inst", "slice", "m.*")


@query("d33_section_diameters", "inst:i section:d d_cm:d n_points:i")
def _(fx):
    tops = fx.fx_tree_pts.groupBy("inst").agg(F.max("z").alias("total_h"))
    p = cut(S.section_points(wood(fx).drop("bin"), tops, ["inst"]).select("inst", "section", "pid", "x", "y"))
    return S.measure_slices(p, ["inst", "section"], "pid")


MODE = f"""(SELECT inst, (k + 0.5) * 0.005 AS r FROM (SELECT inst, k, row_number() OVER (PARTITION BY inst ORDER BY c / (2 * k + 1) DESC, k) AS o FROM (SELECT inst, floor(sqrt(u*u + v*v) / CAST(0.005 AS DOUBLE)) AS k, count(*) AS c FROM {WOOD}
 WHERE sqrt(u*u + v*v) >= 0.03 AND sqrt(u*u + v*v) < 0.22 GROUP BY 1, 2)) WHERE o = 1)"""


@query("d34_radial_mode", "inst:i r:d", f"SELECT * FROM {MODE}")
def _(fx):
    return S.radial_mode(wood(fx), ["inst"])


@query("d34_mode_radius_refined", "inst:i r:d cu:d cv:d inliers:i")
def _(fx):
    return S.mode_radius(wood(fx).where("h < 3"), ["inst"], least=20)


@query("d35_principal_axis", "inst:i dx:d dy:d dz:d")
def _(fx):
    return S.principal_axis(wood(fx), ["inst"])


@query("d36_slice_agreement", "inst:i n_slices:i r_med:d mad:d reason:s")
def _(fx):
    return S.slice_agreement(wood(fx).where("h < 4"), ["inst"], least=15)


@query("d37_kernel_radius", "inst:i peak:d", f"""
WITH g AS (SELECT inst, i, 0.03 + i * CAST(0.002 AS DOUBLE) AS r, sum(exp(-0.5 * ((sqrt(u*u + v*v) - (0.03 + i * CAST(0.002 AS DOUBLE))) / 0.015) * ((sqrt(u*u + v*v) - (0.03 + i * CAST(0.002 AS DOUBLE))) / 0.015))) AS w FROM {WOOD}, range(0, 135) t(i) GROUP BY 1, 2)
SELECT inst, CASE WHEN i > 0 THEN r END AS peak FROM (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY w / r DESC, i) AS k FROM g) WHERE k = 1""")
def _(fx):
    return S.profile_peak(S.kernel_profile(wood(fx), ["inst"]), ["inst"])


@query("d38_relative_ring_profile", "band:i core:d bark:d bark_share:d contrast:d", f"""
WITH n AS (SELECT floor(h / 4) AS band, count(DISTINCT stem) AS n FROM {WOOD} GROUP BY 1), c AS (SELECT floor(h / 4) AS band, floor(sqrt(u*u + v*v) / rt / CAST(0.1 AS DOUBLE)) AS k, count(*) AS c FROM {WOOD} WHERE sqrt(u*u + v*v) / rt < 4 GROUP BY 1, 2),
p AS (SELECT band, (k + 0.5) * 0.1 AS mid, c, c / (pi() * 0.01 * (2 * k + 1) * n) AS d FROM c JOIN n USING (band))
SELECT band, avg(d) FILTER (mid < 0.3) AS core, avg(d) FILTER (mid >= 0.9 AND mid < 1.1) AS bark, coalesce(sum(c) FILTER (mid >= 0.8 AND mid < 1.2), 0) / sum(c) AS bark_share,
 avg(d) FILTER (mid >= 0.9 AND mid < 1.1) / avg(d) FILTER (mid < 0.3) AS contrast FROM p GROUP BY band""")
def _(fx):
    w = wood(fx).withColumn("band", F.floor(F.col("h") / 4))
    return S.ring_contrast(S.ring_profile(w, ["band"], 0.1, 4.0, scale="rt"), ["band"])


@query("d39_stem_evidence", "inst:i n:i d_sd:d near15:d near25:d concentration:d d_p10:d d_p25:d d_med:d", f"""
SELECT inst, count(*) AS n, stddev_pop(d) AS d_sd, avg((d < 0.15)::INT) AS near15, avg((d < 0.25)::INT) AS near25, avg((d < 0.2)::INT) / ((0.2 / 0.6) * (0.2 / 0.6)) AS concentration, quantile_cont(d, 0.1) AS d_p10, quantile_cont(d, 0.25) AS d_p25, median(d) AS d_med
FROM (SELECT inst, sqrt(u*u + v*v) AS d FROM {WOOD} WHERE h BETWEEN 1 AND 6) GROUP BY inst HAVING count(*) >= 5""")
def _(fx):
    return S.stem_evidence(wood(fx).where("h between 1 and 6"), ["inst"])


@query("d40_ring_centre", "inst:i n:i")
def _(fx):
    return S.ring_centre(wood(fx).where("abs(h - 1.3) <= 0.5"), ["inst"], "rt", 0.06)


@query("d41_taper_walk", "stem:i h_m:d r:d")
def _(fx):
    w = cut(wood(fx))
    anchors = w.groupBy("stem").agg(F.first("rt").alias("r"))
    return S.taper_walk(w, anchors, (1.7, 2.6, 3.7, 5.0, 7.0), least=8, inliers=5)


def section_centres(fx):
    return wood(fx).groupBy("stem", "bin").agg(F.avg("u").alias("cu"), F.avg("v").alias("cv"), ((F.first("bin") + 0.5) * 0.5).alias("h_m"))


@query("d65_axis_fit", "stem:i n:i a0x:d a1x:d a0y:d a1y:d", f"""
SELECT stem, count(*) AS n, regr_intercept(cu, h) AS a0x, regr_slope(cu, h) AS a1x, regr_intercept(cv, h) AS a0y, regr_slope(cv, h) AS a1y FROM (SELECT stem, (bin + 0.5) * 0.5 AS h, avg(u) AS cu, avg(v) AS cv FROM {WOOD} GROUP BY stem, bin) GROUP BY stem HAVING count(*) >= 4""")
def _(fx):
    return S.axis_fit(section_centres(fx), ["stem"])


@query("d66_envelope_radius", "stem:i band:i r90:d n:i", f"""
WITH a AS (SELECT stem, regr_intercept(cu, h) AS a0x, regr_slope(cu, h) AS a1x, regr_intercept(cv, h) AS a0y, regr_slope(cv, h) AS a1y FROM (SELECT stem, (bin + 0.5) * 0.5 AS h, avg(u) AS cu, avg(v) AS cv FROM {WOOD} GROUP BY stem, bin) GROUP BY stem HAVING count(*) >= 4),
d AS (SELECT w.stem, floor(h) AS band, sqrt(pow(u - a0x - a1x * (floor(h) + 0.5), 2) + pow(v - a0y - a1y * (floor(h) + 0.5), 2)) AS d FROM {WOOD} w JOIN a ON a.stem = w.stem)
SELECT stem, band, quantile_cont(d, 0.9) AS r90, count(*) AS n FROM d WHERE d <= 2.5 GROUP BY 1, 2 HAVING count(*) >= 15""")
def _(fx):
    return S.envelope_radius(wood(fx), S.axis_fit(section_centres(fx), ["stem"]).drop("n"))
