"""Scalar formulas."""
from pyspark.sql import functions as F

from canopyframe.functions import scalars as X
from canopyframe.plans.registry import query
from canopyframe.sources.readers import assert_finite

DEN = "ln(hmean) - 2.6939602 - 0.3348264 * ln(hdom)"


@query("h01_height_from_diameter", "tree_id:i h:d", """
SELECT tree_id, exp(2.6939602 - 9.9588349 / dbh_cm + 0.3348264 * ln(25.0)) AS h FROM fx_trees""")
def _(fx):
    return fx.fx_trees.select("tree_id", X.hypsometric_height("dbh_cm", F.lit(25.0)).alias("h"))


@query("h02_diameter_from_height", "plot:i d:d", f"""
SELECT plot, least(greatest(-9.9588349 / (CASE WHEN abs({DEN}) < 0.001 THEN -0.001 ELSE {DEN} END), 4), 45) AS d FROM fx_panel""")
def _(fx):
    return fx.fx_panel.select("plot", X.hypsometric_diameter("hmean", "hdom").alias("d"))


@query("h03_mean_tree_volume", "tree_id:i v:d", """
SELECT tree_id, -0.00490367 + 0.0001403 * dbh_cm * dbh_cm + 0.00003216 * dbh_cm * dbh_cm * h_m + 0.00035781 * h_m AS v FROM fx_trees""")
def _(fx):
    return fx.fx_trees.select("tree_id", X.mean_tree_volume("dbh_cm", "h_m").alias("v"))


@query("h04_loglog_volume", "tree_id:i v_h:d v_dh:d", """
SELECT tree_id, exp(-9.5 + 2.7 * ln(greatest(h_m, 0.001))) AS v_h, exp(-10.1 + 1.9 * ln(dbh_cm) + 1.05 * ln(h_m)) AS v_dh FROM fx_trees""")
def _(fx):
    return fx.fx_trees.select("tree_id", X.volume_from_height("h_m", -9.5, 2.7).alias("v_h"),
                              X.volume_from_diameter_height("dbh_cm", "h_m", -10.1, 1.9, 1.05).alias("v_dh"))


@query("h05_form_factor", "tree_id:i v:d kg:d none:d", """
SELECT tree_id, pi() * (dbh_cm / 200) * (dbh_cm / 200) * h_m * 0.5 AS v, exp(-2.977 + ln(0.5 * dbh_cm * dbh_cm * h_m)) AS kg,
 CAST(NULL AS DOUBLE) AS none FROM fx_trees""")
def _(fx):
    return fx.fx_trees.select("tree_id", X.form_factor_volume("dbh_cm", "h_m").alias("v"), X.stem_biomass("dbh_cm", "h_m").alias("kg"),
                              X.stem_biomass(F.col("dbh_cm") * 0, "h_m").alias("none"))


@query("h06_section_formulas", "tree_id:i s:d h:d", """
SELECT tree_id, pi() / 8 * ((dbh_cm / 100) * (dbh_cm / 100) + (dbh_cm / 125) * (dbh_cm / 125)) * 2 AS s,
 pi() / 4 * (dbh_cm / 100) * (dbh_cm / 100) * 2 AS h FROM fx_trees""")
def _(fx):
    return fx.fx_trees.select("tree_id", X.smalian("dbh_cm", F.col("dbh_cm") * 0.8, 2.0).alias("s"), X.huber("dbh_cm", 2.0).alias("h"))


@query("h07_site_index", "plot:i si:d si_b:d", """
SELECT plot, hdom * (7 / age) AS si, hdom * pow(7 / age, 0.6) AS si_b FROM fx_panel""")
def _(fx):
    return fx.fx_panel.select("plot", X.site_index("hdom", "age").alias("si"), X.site_index("hdom", "age", 7.0, 0.6).alias("si_b"))


@query("h08_biomass_from_volume", "plot:i agb:d", "SELECT plot, vol_ha * 0.5 * 1.2 AS agb FROM fx_panel")
def _(fx):
    return fx.fx_panel.select("plot", X.above_ground_biomass("vol_ha", 0.5, 1.2).alias("agb"))


@query("h09_density_and_rate", "stand:i dens:d rate:d", """
SELECT stand, avg(n_obs / 0.04524) AS dens, sum(n_obs) / sum(n_field) AS rate FROM fx_panel GROUP BY stand""")
def _(fx):
    return fx.fx_panel.groupBy("stand").agg(F.avg(X.density_per_ha("n_obs", 0.04524)).alias("dens"),
                                            (F.sum("n_obs") / F.nullif(F.sum("n_field"), F.lit(0))).alias("rate"))


@query("h10_adaptive_radius", "plot:i r:d", """
SELECT plot, CASE WHEN plot % 9 = 0 THEN 1.5 ELSE least(greatest(0.8 * zsd / 2, 1.0), 2.0) END AS r FROM fx_panel""")
def _(fx):
    s = F.when(F.col("plot") % 9 != 0, F.col("zsd") / 2)
    return fx.fx_panel.select("plot", X.adaptive_radius(s).alias("r"))


@query("h11_back_calculated_diameter", "arv:i d:d", """
SELECT arv, CASE WHEN arv % 8 <> 0 THEN sqrt(v / (pi() / 4 * h_m * 0.5)) * 100 END AS d FROM fx_volumes""")
def _(fx):
    return fx.fx_volumes.select("arv", X.diameter_from_volume(F.when(F.col("arv") % 8 == 0, 0.0).otherwise(F.col("v")), "h_m").alias("d"))


LENS = """CASE WHEN d >= r + 2 THEN 0 WHEN d <= abs(2 - r) THEN pi() * least(r, 2) * least(r, 2) ELSE
 r * r * (acos((d*d + r*r - 4) / (2*d*r)) - sin(2 * acos((d*d + r*r - 4) / (2*d*r))) / 2)
 + 4 * (acos((d*d + 4 - r*r) / (4*d)) - sin(2 * acos((d*d + 4 - r*r) / (4*d))) / 2) END"""


@query("h12_circle_overlap", "tree_id:i a:d", f"""
SELECT tree_id, {LENS} AS a FROM (SELECT tree_id, x / 20 AS d, dbh_cm / 10 AS r FROM fx_trees)""")
def _(fx):
    return fx.fx_trees.select("tree_id", X.circle_overlap(F.col("x") / 20, F.col("dbh_cm") / 10, 2.0).alias("a"))


@query("h13_circumcircle", "stem:i ux:d uy:d r:d flat:d", """
SELECT stem, cx AS ux, cy AS uy, r0 AS r, CAST(NULL AS DOUBLE) AS flat FROM fx_stems""")
def _(fx):
    def p(a):
        return F.col("cx") + F.col("r0") * F.cos(F.lit(a)), F.col("cy") + F.col("r0") * F.sin(F.lit(a))
    ux, uy, r = X.circumcircle(*p(0.3), *p(2.2), *p(4.4))
    flat = X.circumcircle("cx", "cy", F.col("cx") + 1, "cy", F.col("cx") + 2, "cy")[2]
    return fx.fx_stems.select("stem", ux.alias("ux"), uy.alias("uy"), r.alias("r"), flat.alias("flat"))


@query("h14_wrapped_distance", "tree_id:i w:d", """
SELECT tree_id, least(x - floor(x / 2.87) * 2.87, 2.87 - (x - floor(x / 2.87) * 2.87)) AS w FROM fx_trees""")
def _(fx):
    return fx.fx_trees.select("tree_id", X.wrapped("x", 2.87).alias("w"))


@query("h15_precision_recall_f1", "stand:i p:d r:d f1:d none:d", """
WITH c AS (SELECT stand, sum(n_obs) AS tp, sum(n_field) AS nr, sum(n_obs) * 1.25 AS np FROM fx_panel GROUP BY stand)
SELECT stand, tp / np AS p, tp / nr AS r, 2 * (tp / np) * (tp / nr) / (tp / np + tp / nr) AS f1, 0.0 AS none FROM c""")
def _(fx):
    c = fx.fx_panel.groupBy("stand").agg(F.sum("n_obs").alias("tp"), F.sum("n_field").alias("nr"))
    p, r, f = X.precision_recall_f1("tp", F.col("tp") * 1.25, "nr")
    none = X.precision_recall_f1(0, 0, 0)[2]
    return c.select("stand", p.alias("p"), r.alias("r"), f.alias("f1"), none.alias("none"))


@query("h17_finite_guard", "n:i", "SELECT count(*) AS n FROM fx_panel")
def _(fx):
    return assert_finite(fx.fx_panel, ["hdom", "age", "vol_ha"]).agg(F.count(F.lit(1)).alias("n"))
