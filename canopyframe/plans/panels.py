"""Windows, rankings, set operations, panel statistics and linear models."""
from itertools import combinations

from pyspark.sql import functions as F

from canopyframe.functions import scalars as X
from canopyframe.functions.hashing import mix_sql, normal, normal_sql
from canopyframe.functions.scalars import Z_975
from canopyframe.operators import panel as P, transforms as T
from canopyframe.operators.metrics import with_means
from canopyframe.operators.ranks import exact_quantiles, sorted_index, top_fraction
from canopyframe.operators.spatial import grid_join
from canopyframe.plans.registry import query
from canopyframe.session import cut
from canopyframe.sources.sinks import require_same_keys


def panel(fx):
    return fx.fx_panel.select("plot", "stand", "age", "cx", "hdom", "hmean", "zsd", "cover", "n_field", "n_obs", F.col("vol_ha").alias("y"), "pred")


PANEL = "(SELECT *, vol_ha AS y FROM fx_panel)"
SCORES = """count(*) AS n, 1 - sum((pred-y)*(pred-y)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((pred-y)*(pred-y))) AS rmse, 100 * sqrt(avg((pred-y)*(pred-y))) / avg(y) AS rrmse,
 avg(pred-y) AS bias, 100 * avg(pred-y) / avg(y) AS bias_pct"""
SCORE_COLS = "n:i r2:d rmse:d rrmse:d bias:d bias_pct:d"

# ---- windows ------------------------------------------------------------------------------------


@query("e01_group_deviation", "plot:i dev:d", f"SELECT plot, y - avg(y) OVER (PARTITION BY stand) AS dev FROM {PANEL}")
def _(fx):
    return P.centred(panel(fx), "stand", ["y"]).select("plot", F.col("y_c").alias("dev"))


@query("e02_consecutive_sections", "tree_id:i h_m:d h_next:d d_next:d", """
SELECT tree_id, h_m, lead(h_m) OVER w AS h_next, lead(d_cm) OVER w AS d_next FROM fx_sections WINDOW w AS (PARTITION BY tree_id ORDER BY h_m)""")
def _(fx):
    return fx.sql("SELECT tree_id, h_m, lead(h_m) OVER w AS h_next, lead(d_cm) OVER w AS d_next FROM {fx_sections} WINDOW w AS (PARTITION BY tree_id ORDER BY h_m)")


@query("e03_top_fraction", "stand:i n:i hmean:d", """
SELECT stand, count(*) AS n, avg(h_m) AS hmean FROM (SELECT stand, h_m, row_number() OVER (PARTITION BY stand ORDER BY h_m DESC) AS r, count(*) OVER (PARTITION BY stand) AS c FROM fx_trees)
WHERE r <= greatest(1, floor(c * 0.2)) GROUP BY stand""")
def _(fx):
    return top_fraction(fx.fx_trees, ["stand"], "h_m", 0.2).groupBy("stand").agg(F.count(F.lit(1)).alias("n"), F.avg("h_m").alias("hmean"))


BLOCKS = """(SELECT t.*, (x >= a)::INT + (x >= b)::INT + (x >= c)::INT + (x >= d)::INT AS block FROM fx_trees t, (SELECT quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.4) AS b,
 quantile_cont(x, 0.6) AS c, quantile_cont(x, 0.8) AS d FROM fx_trees))"""


@query("e04_equal_count_blocks", "block:i n:i xmin:d", f"SELECT block, count(*) AS n, min(x) AS xmin FROM {BLOCKS} GROUP BY block")
def _(fx):
    return P.blocks(fx.fx_trees, "x", 5).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("xmin"))


@query("e05_quantile_classes", "cls:i n:i dmax:d", """
SELECT (dbh_cm > a)::INT + (dbh_cm > b)::INT AS cls, count(*) AS n, max(dbh_cm) AS dmax FROM fx_trees, (SELECT quantile_cont(dbh_cm, 1/3) AS a, quantile_cont(dbh_cm, 2/3) AS b FROM fx_trees) GROUP BY 1""")
def _(fx):
    return P.blocks(fx.fx_trees, "dbh_cm", 3, "cls", right=True).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("dbh_cm").alias("dmax"))


@query("e06_best_row_per_group", "stand:i tree_id:i h_m:d", """
SELECT stand, tree_id, h_m FROM (SELECT *, row_number() OVER (PARTITION BY stand ORDER BY h_m DESC, tree_id) AS r FROM fx_trees) WHERE r = 1""")
def _(fx):
    b = fx.fx_trees.groupBy("stand").agg(F.max(F.struct("h_m", (-F.col("tree_id")).alias("t"))).alias("m"))
    return b.select("stand", (-F.col("m.t")).alias("tree_id"), "m.h_m")


@query("e08_row_position", "plot:i arvore:i linha:i pos:i", "SELECT plot, arvore, linha, arvore - min(arvore) OVER (PARTITION BY plot, linha) AS pos FROM fx_census")
def _(fx):
    m = fx.fx_census.groupBy("plot", "linha").agg(F.min("arvore").alias("a0"))
    return fx.fx_census.join(m, ["plot", "linha"]).withColumn("pos", F.col("arvore") - F.col("a0"))


LOO = """WITH r AS (SELECT plot, pred, y, abs(y - pred) AS res, row_number() OVER (ORDER BY abs(y - pred), plot) - 1 AS i, count(*) OVER () AS n FROM {0}),
k AS (SELECT *, CAST(ceil(least(ceil(CAST(0.95 AS DOUBLE) * n) / (n - 1), 1) * (n - 2)) AS BIGINT) AS k FROM r)
SELECT plot, pred - h AS lo, pred + h AS hi, y FROM (SELECT k.*, CASE WHEN k.i <= k.k THEN (SELECT res FROM r q WHERE q.i = k.k + 1) ELSE (SELECT res FROM r q WHERE q.i = k.k) END AS h FROM k)"""


@query("e09_leave_one_out_order_statistic", "plot:i lo:d hi:d", LOO.format(PANEL))
def _(fx):
    return P.loo_conformal(panel(fx))


# ---- sorts, limits, sets ------------------------------------------------------------------------

MODELS = [("hdom", ["hdom"]), ("hdom_age", ["hdom", "age"]), ("age", ["age"])]


def oof(fx, scheme):
    out = None
    for name, xs in MODELS:
        m = P.linear_oof(panel(fx), "plot", xs, "y", "stand" if scheme == "loto" else None).withColumn("model", F.lit(name))
        m = m.select("model", "plot", "y", "pred")
        out = m if out is None else out.unionByName(m)
    return out


def oof_sql(scheme, x):
    """Refit on the remaining rows of every fold (one covariate)."""
    k = "stand" if scheme == "loto" else "plot"
    return f"""SELECT a.plot, any_value(a.y) AS y, regr_intercept(b.y, b.{x}) + regr_slope(b.y, b.{x}) * any_value(a.{x}) AS pred
 FROM {PANEL} a JOIN {PANEL} b ON a.{k} <> b.{k} GROUP BY a.plot"""


OOF2 = """SELECT plot, any_value(y0) AS y, avg(y) + ((sxx2 * sxy1 - sx12 * sxy2) / det) * (any_value(h0) - avg(h)) + ((sxx1 * sxy2 - sx12 * sxy1) / det) * (any_value(a0) - avg(a)) AS pred FROM (
 SELECT a.plot, a.y AS y0, a.hdom AS h0, a.age AS a0, b.y, b.hdom AS h, b.age AS a, var_pop(b.hdom) OVER w AS sxx1, var_pop(b.age) OVER w AS sxx2, covar_pop(b.hdom, b.age) OVER w AS sx12,
 covar_pop(b.hdom, b.y) OVER w AS sxy1, covar_pop(b.age, b.y) OVER w AS sxy2, sxx1 * sxx2 - sx12 * sx12 AS det FROM {0} a JOIN {0} b ON a.{1} <> b.{1} WINDOW w AS (PARTITION BY a.plot)) GROUP BY plot, sxx1, sxx2, sx12, sxy1, sxy2, det"""


def all_oof_sql(scheme):
    k = "stand" if scheme == "loto" else "plot"
    return f"""SELECT 'hdom' AS model, * FROM ({oof_sql(scheme, 'hdom')}) UNION ALL SELECT 'age', * FROM ({oof_sql(scheme, 'age')}) UNION ALL SELECT 'hdom_age', * FROM ({OOF2.format(PANEL, k)})"""


@query("f01_model_ranking", "model:s loto_rrmse:d lopo_rrmse:d", f"""
WITH a AS (SELECT model, 100 * sqrt(avg((pred-y)*(pred-y))) / avg(y) AS loto_rrmse, 1 - sum((pred-y)*(pred-y)) / (var_pop(y) * count(*)) AS r2 FROM ({all_oof_sql('loto')}) GROUP BY 1),
b AS (SELECT model, 100 * sqrt(avg((pred-y)*(pred-y))) / avg(y) AS lopo_rrmse FROM ({all_oof_sql('lopo')}) GROUP BY 1)
SELECT model, loto_rrmse, lopo_rrmse FROM a JOIN b USING (model) WHERE r2 > 0 ORDER BY loto_rrmse, lopo_rrmse LIMIT 1""")
def _(fx):
    a = P.scores(oof(fx, "loto"), ["model"]).select("model", F.col("rrmse").alias("loto_rrmse"), F.col("r2").alias("gate"))
    b = P.scores(oof(fx, "lopo"), ["model"]).select("model", F.col("rrmse").alias("lopo_rrmse"))
    j = a.join(b, "model")
    return j.orderBy((F.col("gate") <= 0).cast("int"), "loto_rrmse", "lopo_rrmse").limit(1)


LEV = """SELECT plot, (1 - (sse - e2) / ((syy - y*y) - (sy - y) * (sy - y) / (n - 1))) - (1 - sse / (syy - sy*sy/n)) AS dr2 FROM (SELECT plot, y, (pred-y)*(pred-y) AS e2, sum((pred-y)*(pred-y)) OVER () AS sse,
 sum(y) OVER () AS sy, sum(y*y) OVER () AS syy, count(*) OVER () AS n FROM {0})"""


def leverage(df):
    e2 = (F.col("pred") - F.col("y")) * (F.col("pred") - F.col("y"))
    s = df.agg(F.struct(F.sum(e2).alias("sse"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.count(F.lit(1)).alias("n"))).scalar()
    d = df.withColumn("s", s)
    y, n = F.col("y"), F.col("s.n")
    full = 1 - F.col("s.sse") / (F.col("s.syy") - F.col("s.sy") * F.col("s.sy") / n)
    sst = (F.col("s.syy") - y * y) - (F.col("s.sy") - y) * (F.col("s.sy") - y) / (n - 1)
    return d.withColumn("dr2", (1 - (F.col("s.sse") - e2) / sst) - full).drop("s")


@query("f02_influence_ranking", "plot:i dr2:d", f"SELECT * FROM ({LEV.format(PANEL)}) ORDER BY abs(dr2) DESC, plot")
def _(fx):
    return leverage(panel(fx)).orderBy(F.abs("dr2").desc(), "plot")


@query("f04_nearest_to_census", "plot:i gap:d", f"SELECT plot, abs(n_obs / n_field - 0.61) AS gap FROM fx_panel ORDER BY 2, 1 LIMIT 12")
def _(fx):
    return fx.fx_panel.withColumn("gap", F.abs(F.col("n_obs") / F.col("n_field") - 0.61)).orderBy("gap", "plot").limit(12)


@query("g01_pooled_views", "n:i n_views:i", "SELECT count(*) AS n, count(DISTINCT view_id) AS n_views FROM fx_detections")
def _(fx):
    return fx.fx_detections.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("view_id").alias("n_views"))


@query("g02_concatenated_stands", "stand:i n:i", "SELECT stand, count(*) AS n FROM fx_detections GROUP BY stand")
def _(fx):
    return fx.fx_detections.groupBy("stand").agg(F.count(F.lit(1)).alias("n"))


@query("g03_reachable_intersection", "tree_id:i", "SELECT tree_id FROM fx_detections WHERE view_id = 2 INTERSECT SELECT tree_id FROM fx_detections WHERE view_id = 5")
def _(fx):
    d = fx.fx_detections
    return d.where("view_id = 2").select("tree_id").intersect(d.where("view_id = 5").select("tree_id"))


@query("g05_equal_key_sets", "n:i", "SELECT count(*) AS n FROM fx_trees")
def _(fx):
    require_same_keys(fx.fx_trees, fx.fx_volumes.withColumnRenamed("arv", "tree_id"), ["tree_id"])
    return fx.fx_trees.agg(F.count(F.lit(1)).alias("n"))


# ---- scores and folds ---------------------------------------------------------------------------

@query("i01_regression_scores", "stand:i " + SCORE_COLS, f"SELECT stand, {SCORES} FROM {PANEL} GROUP BY stand")
def _(fx):
    return P.scores(panel(fx), ["stand"])


@query("i02_fold_scores", "n_folds:i mae:d mae_sd:d mape:d r:d r2:d", f"""
SELECT count(*) AS n_folds, avg(mae) AS mae, stddev_samp(mae) AS mae_sd, avg(mape) AS mape, avg(r) AS r, avg(r2) AS r2 FROM (SELECT stand, avg(abs(pred-y)) AS mae, 100 * avg(abs(pred-y) / abs(y)) FILTER (y <> 0) AS mape,
 corr(y, pred) AS r, {SCORES} FROM {PANEL} GROUP BY stand)""")
def _(fx):
    f = P.fold_scores(panel(fx), ["stand"])
    return f.agg(F.count(F.lit(1)).alias("n_folds"), F.avg("mae").alias("mae"), F.stddev_samp("mae").alias("mae_sd"), F.avg("mape").alias("mape"), F.avg("r").alias("r"), F.avg("r2").alias("r2"))


@query("i03_leave_one_out", "plot:i y:d pred:d", oof_sql("lopo", "hdom"))
def _(fx):
    return P.linear_oof(panel(fx), "plot", ["hdom"], "y")


@query("i04_leave_one_stand_out", "plot:i y:d pred:d", OOF2.format(PANEL, "stand"))
def _(fx):
    return P.linear_oof(panel(fx), "plot", ["hdom", "age"], "y", "stand")


@query("i05_both_schemes_ensemble", "scheme:s plot:i pred:d", f"""
SELECT 'lopo' AS scheme, plot, avg(pred) AS pred FROM ({all_oof_sql('lopo')}) GROUP BY plot UNION ALL SELECT 'loto', plot, avg(pred) FROM ({all_oof_sql('loto')}) GROUP BY plot""")
def _(fx):
    both = oof(fx, "lopo").withColumn("scheme", F.lit("lopo")).unionByName(oof(fx, "loto").withColumn("scheme", F.lit("loto")))
    return both.groupBy("scheme", "plot").agg(F.avg("pred").alias("pred"))


@query("i06_model_report", "model:s r2:d rrmse:d r2_group:d rrmse_group:d n_groups:i r2_lo:d r2_hi:d rrmse_lo:d rrmse_hi:d coverage:d score:d coverage_parametric:d perm_p:d")
def _(fx):
    """One row a model: both schemes, bootstrap intervals, conformal and normal coverage, permutation p."""
    lopo = None
    for name, xs in MODELS:
        m = P.linear_oof(panel(fx), "plot", xs, "y").select(F.lit(name).alias("model"), "plot", "y", "pred", "sd")
        lopo = m if lopo is None else lopo.unionByName(m)
    lopo, loto = cut(lopo), oof(fx, "loto")
    b = cut(P.weighted_scores(P.bootstrap(lopo, "plot", BOOT, 3, ["y", "pred"], ["model"]), ["model", "rep"]).where("r2 is not null"))
    ci = exact_quantiles(b, ["model"], "rrmse", {"rrmse_lo": 0.025, "rrmse_hi": 0.975}).join(exact_quantiles(b, ["model"], "r2", {"r2_lo": 0.025, "r2_hi": 0.975}), "model")
    q = P.interval_quality(P.loo_conformal(lopo.drop("sd"), 0.05, ["model"]), ["model"])
    half = Z_975 * F.col("sd")
    normal_q = lopo.groupBy("model").agg(F.avg(F.col("y").between(F.col("pred") - half, F.col("pred") + half).cast("double")).alias("coverage_parametric"))
    g = P.scores(loto, ["model"]).select("model", F.col("r2").alias("r2_group"), F.col("rrmse").alias("rrmse_group")).withColumn("n_groups", panel(fx).agg(F.count_distinct("stand")).scalar())
    own = P.scores(lopo, ["model"]).select("model", "r2", "rrmse")
    null = P.scores(P.permuted(lopo.drop("sd"), "plot", "y", PERM, 5, ["model"]), ["model", "rep"]).select("model", F.col("r2").alias("null"))
    p = null.join(own, "model").groupBy("model").agg(((1 + F.count_if(F.col("null") >= F.col("r2"))) / (F.count(F.lit(1)) + 1)).alias("perm_p"))
    for t in (g, ci, q, normal_q, p):
        own = own.join(t, "model")
    return own


@query("i07_shuffled_folds", "fold:i n:i", f"""
SELECT (row_number() OVER (ORDER BY {mix_sql('plot', 42)}, plot) - 1) % 5 AS fold, count(*) AS n FROM fx_panel GROUP BY 1""".replace("SELECT (row_number()", "SELECT fold, count(*) AS n FROM (SELECT (row_number()").replace(" AS fold, count(*) AS n FROM fx_panel GROUP BY 1", " AS fold FROM fx_panel) GROUP BY fold"))
def _(fx):
    from canopyframe.functions.hashing import mix
    r = sorted_index(panel(fx).withColumn("h", mix("plot", 42)), [], "h", "i", ["plot"])
    return r.groupBy((F.col("i") % 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


# Resamples of scores, label permutations, refitted permutations, resamples of efficiency and counts, error draws.
BOOT, PERM, REFIT, EFFICIENCY, ERRORS = 2000, 5000, 200, 4000, 300


def boot_sql(reps, seed, key=""):
    return f"""(SELECT d.rep, p.* FROM (SELECT rep, {mix_sql('rep', 'slot', seed)} % n AS i FROM (SELECT unnest(range(0, {reps})) AS rep, slot, n FROM (SELECT row_number() OVER (ORDER BY plot) - 1 AS slot, count(*) OVER () AS n FROM fx_panel))) d
 JOIN (SELECT *, row_number() OVER (ORDER BY plot) - 1 AS i FROM {PANEL}) p ON p.i = d.i)"""


@query("i09_bootstrap_scores", "rmse_lo:d rmse_hi:d rrmse_lo:d rrmse_hi:d r2_lo:d r2_hi:d n:i dropped:i", f"""
WITH s AS (SELECT rep, {SCORES} FROM {boot_sql(BOOT, 7)} GROUP BY rep) SELECT quantile_cont(rmse, 0.025) AS rmse_lo, quantile_cont(rmse, 0.975) AS rmse_hi, quantile_cont(rrmse, 0.025) AS rrmse_lo, quantile_cont(rrmse, 0.975) AS rrmse_hi,
 quantile_cont(r2, 0.025) AS r2_lo, quantile_cont(r2, 0.975) AS r2_hi, count(*) AS n, {BOOT} - count(*) AS dropped FROM s WHERE r2 IS NOT NULL""")
def _(fx):
    """Constant resamples have no R2; they are dropped and counted."""
    s = cut(P.weighted_scores(P.bootstrap(panel(fx), "plot", BOOT, 7, ["y", "pred"]), ["rep"]).where("r2 is not null"))
    out = s.agg(F.count(F.lit(1)).alias("n")).withColumn("dropped", F.lit(BOOT) - F.col("n"))
    for c in ("rmse", "rrmse", "r2"):
        q = exact_quantiles(s, [], c, {f"{c}_lo": 0.025, f"{c}_hi": 0.975})
        out = out.withColumn(c, q.select(F.struct(f"{c}_lo", f"{c}_hi")).scalar())
    return out.select("rmse.*", "rrmse.*", "r2.*", "n", "dropped")


@query("i11_loo_conformal", "coverage:d width:d", f"SELECT avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS coverage, avg(hi - lo) AS width FROM ({LOO.format(PANEL)})")
def _(fx):
    return P.loo_conformal(panel(fx)).agg(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"))


@query("i12_mondrian_interval", "plot:i half:d", f"""
WITH r AS (SELECT stand, plot, abs(y - pred) AS res, row_number() OVER (PARTITION BY stand ORDER BY abs(y - pred), plot) - 1 AS i, count(*) OVER (PARTITION BY stand) AS n FROM {PANEL}),
k AS (SELECT *, CAST(ceil(least(ceil(CAST(0.95 AS DOUBLE) * n) / (n - 1), 1) * (n - 2)) AS BIGINT) AS k FROM r),
g AS (SELECT quantile_disc(res, 1.0) AS q FROM r)
SELECT k.plot, CASE WHEN k.n >= 3 THEN (SELECT res FROM r q WHERE q.stand = k.stand AND q.i = CASE WHEN k.i <= k.k THEN k.k + 1 ELSE k.k END) ELSE (SELECT q FROM g) END AS half FROM k""")
def _(fx):
    return P.mondrian_interval(panel(fx), "stand")


@query("i13_weighted_interval", "plot:i half:d", f"""
WITH r AS (SELECT plot, pred, abs(y - pred) / pred AS s, row_number() OVER (ORDER BY abs(y - pred) / pred) - 1 AS i, count(*) OVER () AS n FROM {PANEL})
SELECT plot, pred * (SELECT s FROM r WHERE i = CAST(ceil(least(ceil(CAST(0.95 AS DOUBLE) * (n + 1)) / n, 1) * (n - 1)) AS BIGINT)) AS half FROM r""")
def _(fx):
    return P.weighted_interval(panel(fx), "pred")


@query("i14_interval_quality", "stand:i coverage:d score:d", f"""
SELECT stand, avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS coverage, avg(hi - lo + CASE WHEN y < lo THEN 40 * (lo - y) WHEN y > hi THEN 40 * (y - hi) ELSE 0 END) AS score
FROM (SELECT stand, y, pred * 0.95 AS lo, pred * 1.08 AS hi FROM {PANEL}) GROUP BY stand""")
def _(fx):
    d = panel(fx).withColumns({"lo": F.col("pred") * 0.95, "hi": F.col("pred") * 1.08})
    return P.interval_quality(d, ["stand"])


@query("i15_leakage_guard", "feature:s r:d kept:b", f"""
SELECT 'hdom' AS feature, abs(corr(hdom, y)) AS r, abs(corr(hdom, y)) <= 0.999 AS kept FROM {PANEL} UNION ALL SELECT 'copy', abs(corr(2 * y + 1, y)), abs(corr(2 * y + 1, y)) <= 0.999 FROM {PANEL}
UNION ALL SELECT 'flat', NULL, TRUE UNION ALL SELECT 'cover', abs(corr(cover, y)), abs(corr(cover, y)) <= 0.999 FROM {PANEL}""")
def _(fx):
    d = panel(fx).withColumn("copy", 2 * F.col("y") + 1).withColumn("flat", F.lit(3.0))
    cols = ["hdom", "copy", "flat", "cover"]
    a = d.agg(*[F.abs(P.pearson(c, "y")).alias(f"r_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(f"s_{c}") > 0, F.col(f"r_{c}")).alias("r"),
                              ((F.col(f"s_{c}") == 0) | F.coalesce(F.col(f"r_{c}") <= 0.999, F.lit(False))).alias("kept")) for c in cols])
    return a.select(F.explode(rows).alias("s")).select("s.*")


def permuted_sql(reps, seed, part):
    return f"""(WITH m AS (SELECT p.*, rep, row_number() OVER (PARTITION BY rep, {part} ORDER BY plot) AS i, row_number() OVER (PARTITION BY rep, {part} ORDER BY {mix_sql('rep', 'plot', seed)}, plot) AS j FROM {PANEL} p CROSS JOIN range(0, {reps}) r(rep))
 SELECT a.rep, a.plot, a.stand, a.pred, a.hdom, a.age, b.y FROM m a JOIN m b ON a.rep = b.rep AND a.{part} = b.{part} AND a.i = b.j)"""


PANEL1 = PANEL.replace("*,", "*, 1 AS one,")


@query("i16_permutation_test", "p_value:d null_mean:d null_sd:d", f"""
WITH o AS (SELECT 1 - sum((pred-y)*(pred-y)) / (var_pop(y) * count(*)) AS r2 FROM {PANEL}), s AS (SELECT rep, {SCORES} FROM {permuted_sql(PERM, 5, 'one').replace(PANEL, PANEL1)} GROUP BY rep)
SELECT (1 + count(*) FILTER (s.r2 >= o.r2)) / (count(*) + 1) AS p_value, avg(s.r2) AS null_mean, stddev_samp(s.r2) AS null_sd FROM s, o""")
def _(fx):
    null = P.scores(P.permuted(panel(fx), "plot", "y", PERM, 5), ["rep"])
    return P.add_one_p(null, "r2", P.scores(panel(fx), []).select("r2").scalar())


@query("i17_refit_permutation_test", "p_value:d null_mean:d null_sd:d", f"""
WITH q AS {permuted_sql(REFIT, 6, 'one').replace(PANEL, PANEL1)}, f AS (SELECT a.rep, a.plot, any_value(a.y) AS y, regr_intercept(b.y, b.hdom) + regr_slope(b.y, b.hdom) * any_value(a.hdom) AS pred FROM q a JOIN q b ON a.rep = b.rep AND a.stand <> b.stand GROUP BY 1, 2),
s AS (SELECT rep, {SCORES} FROM f GROUP BY rep), o AS (SELECT {SCORES} FROM ({oof_sql('loto', 'hdom')}))
SELECT (1 + count(*) FILTER (s.r2 >= o.r2)) / (count(*) + 1) AS p_value, avg(s.r2) AS null_mean, stddev_samp(s.r2) AS null_sd FROM s, o""")
def _(fx):
    perm = P.permuted(panel(fx).select("plot", "stand", "hdom", "y"), "plot", "y", REFIT, 6)
    null = P.scores(P.linear_oof(perm, "plot", ["hdom"], "y", "stand", by=["rep"]), ["rep"])
    return P.add_one_p(null, "r2", P.scores(P.linear_oof(panel(fx), "plot", ["hdom"], "y", "stand"), []).select("r2").scalar())


@query("i18_seed_summary", "stand:i r2_mean:d r2_sd:d r2_min:d r2_max:d n:i", f"""
SELECT stand, avg(r2) AS r2_mean, stddev_samp(r2) AS r2_sd, min(r2) AS r2_min, max(r2) AS r2_max, count(*) AS n FROM (SELECT stand, plot % 3 AS seed, 1 - sum((pred-y)*(pred-y)) / (var_pop(y) * count(*)) AS r2 FROM {PANEL} GROUP BY 1, 2) GROUP BY stand""")
def _(fx):
    s = P.scores(panel(fx).withColumn("seed", F.col("plot") % 3), ["stand", "seed"])
    return s.groupBy("stand").agg(F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_sd"), F.min("r2").alias("r2_min"), F.max("r2").alias("r2_max"), F.count(F.lit(1)).alias("n"))


def two_stage_sql(src, rep=""):
    r, j = (f"{rep}, ", f"a.{rep} = b.{rep} AND ") if rep else ("", "")
    ar = f"a.{rep}, " if rep else ""
    return f"""(WITH d AS {src}, g AS (SELECT DISTINCT {r}stand FROM d),
 c AS (SELECT {ar}a.stand, regr_intercept(b.y, b.age) AS b0, regr_slope(b.y, b.age) AS b1 FROM g a JOIN d b ON {j}a.stand <> b.stand GROUP BY {ar}a.stand),
 e AS (SELECT {ar}a.stand, regr_intercept(b.y - b0 - b1 * b.age, b.hdom) AS c0, regr_slope(b.y - b0 - b1 * b.age, b.hdom) AS c1 FROM c a JOIN d b ON {j}a.stand <> b.stand GROUP BY {ar}a.stand)
 SELECT d.*, b0 + b1 * age AS base_pred, c0 + c1 * hdom AS resid_pred, y - b0 - b1 * age AS resid_true FROM d JOIN c USING ({r}stand) JOIN e USING ({r}stand))"""


@query("i19_two_stage_residual", "plot:i base_pred:d resid_pred:d pred:d", f"SELECT plot, base_pred, resid_pred, base_pred + resid_pred AS pred FROM {two_stage_sql(PANEL)}")
def _(fx):
    return P.residual_oof(panel(fx), "plot", "age", "hdom", "y", "stand")


@query("i20_orthogonal_report", "resid_r:d null_mean:d null_sd:d p:d z:d", f"""
WITH o AS (SELECT corr(resid_pred, resid_true) AS r FROM {two_stage_sql(PANEL)}), s AS (SELECT rep, corr(resid_pred, resid_true) AS r FROM {two_stage_sql(permuted_sql(REFIT, 8, 'one').replace(PANEL, PANEL1), 'rep')} GROUP BY rep)
SELECT o.r AS resid_r, avg(s.r) AS null_mean, stddev_samp(s.r) AS null_sd, avg(CASE WHEN s.r >= o.r THEN 1.0 ELSE 0.0 END) AS p, (o.r - avg(s.r)) / stddev_samp(s.r) AS z FROM s, o GROUP BY o.r""")
def _(fx):
    obs = P.residual_oof(panel(fx), "plot", "age", "hdom", "y", "stand").agg(F.corr("resid_pred", "resid_true")).scalar()
    null = P.residual_oof(P.permuted(panel(fx).select("plot", "stand", "age", "hdom", "y"), "plot", "y", REFIT, 8), "plot", "age", "hdom", "y", "stand", by=["rep"])
    null = null.groupBy("rep").agg(F.corr("resid_pred", "resid_true").alias("r")).withColumn("o", obs)
    return null.groupBy(F.col("o").alias("resid_r")).agg(F.avg("r").alias("null_mean"), F.stddev_samp("r").alias("null_sd"), F.avg((F.col("r") >= F.col("o")).cast("double")).alias("p")) \
        .withColumn("z", (F.col("resid_r") - F.col("null_mean")) / F.col("null_sd"))


WITHIN = "(SELECT *, y - avg(y) OVER (PARTITION BY stand) AS yc, pred - avg(pred) OVER (PARTITION BY stand) AS pc FROM {0})"


@query("i21_correlation_split", "r_total:d r_between:d r_within:d n:i n_groups:i n_within_df:i", f"""
SELECT corr(y, pred) AS r_total, (SELECT corr(y, p) FROM (SELECT avg(y) AS y, avg(pred) AS p FROM {PANEL} GROUP BY stand)) AS r_between, corr(yc, pc) AS r_within, count(*) AS n, count(DISTINCT stand) AS n_groups, count(*) - count(DISTINCT stand) AS n_within_df FROM {WITHIN.format(PANEL)}""")
def _(fx):
    return P.correlation_split(panel(fx), "stand")


@query("i22_within_stand_permutation", "r:d p:d null_sd:d", f"""
WITH o AS (SELECT corr(yc, pc) AS r FROM {WITHIN.format(PANEL)}), s AS (SELECT rep, corr(yc, pc) AS r FROM (SELECT *, y - avg(y) OVER (PARTITION BY rep, stand) AS yc, pred - avg(pred) OVER (PARTITION BY rep, stand) AS pc FROM {permuted_sql(PERM, 9, 'stand')}) GROUP BY rep)
SELECT o.r, avg(CASE WHEN abs(s.r) >= abs(o.r) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p, stddev_samp(s.r) AS null_sd FROM s, o GROUP BY o.r""")
def _(fx):
    obs = P.centred(panel(fx), "stand", ["y", "pred"]).agg(F.corr("y_c", "pred_c")).scalar()
    # a shuffle inside stands leaves their means as they are, so rows are centred once
    rows = P.centred(panel(fx), "stand", ["y", "pred"]).select("plot", "stand", "y_c", "pred_c")
    null = P.permuted(rows, "plot", "y_c", PERM, 9, ["stand"]).groupBy("rep").agg(F.corr("y_c", "pred_c").alias("x"))
    return null.withColumn("r", obs).groupBy("r").agg(F.avg((F.abs("x") >= F.abs("r") - 1e-12).cast("double")).alias("p"), F.stddev_samp("x").alias("null_sd"))


@query("i23_residual_analysis", "covariate:s r:d", f"SELECT 'age' AS covariate, corr(abs(y - pred), age) AS r FROM {PANEL} UNION ALL SELECT 'hdom', corr(abs(y - pred), hdom) FROM {PANEL}")
def _(fx):
    res = F.abs(F.col("y") - F.col("pred"))
    a = panel(fx).agg(F.corr(res, F.col("age")).alias("age"), F.corr(res, F.col("hdom")).alias("hdom"))
    return a.unpivot([], ["age", "hdom"], "covariate", "r")


@query("i24_score_on_measured", SCORE_COLS, f"SELECT {SCORES} FROM {PANEL} WHERE plot IN (SELECT DISTINCT plot FROM fx_census WHERE d_cm IS NOT NULL)")
def _(fx):
    measured = fx.fx_census.where("d_cm is not null").select("plot").distinct()
    return P.scores(panel(fx).join(measured, "plot"), [])


@query("i25_group_holdout", "held:b " + SCORE_COLS, f"SELECT stand = 4 AS held, {SCORES} FROM {PANEL} GROUP BY 1")
def _(fx):
    return P.scores(panel(fx).withColumn("held", F.col("stand") == 4), ["held"])


@query("i26_stand_site_index", "stand:i si:d", "SELECT stand, avg(hdom * (7 / age)) AS si FROM fx_panel GROUP BY stand")
def _(fx):
    return fx.fx_panel.groupBy("stand").agg(F.avg(X.site_index("hdom", "age")).alias("si"))


@query("i27_field_mean", "stand:i mean_ha:d se:d lo:d hi:d", f"""
SELECT stand, avg(y) AS mean_ha, sqrt(var_samp(y) / count(*)) AS se, avg(y) - 1.959963984540054 * sqrt(var_samp(y) / count(*)) AS lo, avg(y) + 1.959963984540054 * sqrt(var_samp(y) / count(*)) AS hi FROM {PANEL} GROUP BY stand""")
def _(fx):
    return P.field_mean(panel(fx), ["stand"])


@query("i28_model_assisted_mean", "stand:i mean_ha:d se:d lo:d hi:d", f"""
WITH s AS (SELECT stand, avg(y - pred) AS c, sqrt(var_samp(y - pred) / count(*)) AS se FROM {PANEL} GROUP BY stand), m AS (SELECT stand, avg(h_m * dbh_cm) AS p FROM fx_trees GROUP BY stand)
SELECT stand, p + c AS mean_ha, se, p + c - 1.959963984540054 * se AS lo, p + c + 1.959963984540054 * se AS hi FROM s JOIN m USING (stand)""")
def _(fx):
    pop = fx.fx_trees.select("stand", (F.col("h_m") * F.col("dbh_cm")).alias("cell_pred"))
    return P.assisted_mean(panel(fx), pop, ["stand"])


EFF = "var_samp(y) / var_samp(y - pred)"


@query("i29_relative_efficiency", "re:d equivalent_plots:d se_field:d se_model:d se_reduction:d lo:d hi:d", f"""
WITH b AS (SELECT rep, {EFF} AS re FROM {boot_sql(EFFICIENCY, 11)} GROUP BY rep)
SELECT {EFF} AS re, count(*) * ({EFF} - 1) AS equivalent_plots, sqrt(var_samp(y) / count(*)) AS se_field, sqrt(var_samp(y - pred) / count(*)) AS se_model, 100 * (1 - sqrt(var_samp(y - pred) / var_samp(y))) AS se_reduction,
 (SELECT quantile_cont(re, 0.025) FROM b) AS lo, (SELECT quantile_cont(re, 0.975) FROM b) AS hi FROM {PANEL}""")
def _(fx):
    b = P.bootstrap(panel(fx), "plot", EFFICIENCY, 11, ["y", "pred"])
    w, e = F.col("w"), F.col("y") - F.col("pred")
    def ss(v):
        return F.sum(w * v * v) - F.sum(w * v) * F.sum(w * v) / F.sum(w)
    b = b.groupBy("rep").agg((ss(F.col("y")) / ss(e)).alias("re"))
    q = exact_quantiles(b, [], "re", {"lo": 0.025, "hi": 0.975})
    q = q.select(F.struct("lo", "hi").alias("q")).scalar()
    return P.efficiency(panel(fx), []).withColumn("q", q).select("*", "q.lo", "q.hi")


@query("i30_density_calibration", "plot:i global_pred:d proxy_pred:d", """
WITH z AS (SELECT *, (cover - avg(cover) OVER ()) / stddev_pop(cover) OVER () AS z FROM fx_panel), s AS (SELECT sum(n_field) / sum(n_obs) AS k, sum(n_obs*n_obs) AS xx, sum(n_obs*n_obs*z) AS xz, sum(n_obs*z*n_obs*z) AS zz, sum(n_obs*n_field) AS xy, sum(n_obs*z*n_field) AS zy FROM z)
SELECT plot, n_obs * k AS global_pred, n_obs * least(greatest((xy*zz - zy*xz) / (xx*zz - xz*xz) + (zy*xx - xy*xz) / (xx*zz - xz*xz) * z, 0.25), 6) AS proxy_pred FROM z, s""")
def _(fx):
    f = P.density_factors(fx.fx_panel, "n_obs", "n_field", "cover")
    return P.apply_density(fx.fx_panel, f, "n_obs", "cover")


@query("i31_count_calibration", "plot:i ratio:d line:d raw:d", """
SELECT plot, n_obs * k AS ratio, a + b * n_obs AS line, n_obs AS raw FROM fx_panel, (SELECT sum(n_field) / sum(n_obs) AS k, regr_intercept(n_field, n_obs) AS a, regr_slope(n_field, n_obs) AS b FROM fx_panel)""")
def _(fx):
    s = fx.fx_panel.agg(F.struct((F.sum("n_field") / F.sum("n_obs")).alias("k"), F.regr_intercept("n_field", "n_obs").alias("a"), F.regr_slope("n_field", "n_obs").alias("b"))).scalar()
    return fx.fx_panel.withColumn("s", s).select("plot", (F.col("n_obs") * F.col("s.k")).alias("ratio"), (F.col("s.a") + F.col("s.b") * F.col("n_obs")).alias("line"), F.col("n_obs").alias("raw"))


MECH = """least(greatest(-9.9588349 / (ln(hmean) - 2.6939602 - 0.3348264 * ln(hdom)), 4), 45)"""


@query("i32_mechanistic_volume", "plot:i pred:d", f"""
WITH v AS (SELECT plot, stand, n_obs, n_field, vol_ha AS y, n_obs * (-0.00490367 + 0.0001403 * d*d + 0.00003216 * d*d*hmean + 0.00035781 * hmean) AS raw FROM (SELECT *, {MECH} AS d FROM fx_panel)),
f AS (SELECT a.stand, sum(b.n_field) / sum(b.n_obs) AS k, sum(b.y) / (sum(b.raw) * sum(b.n_field) / sum(b.n_obs)) AS bias FROM (SELECT DISTINCT stand FROM v) a JOIN v b ON a.stand <> b.stand GROUP BY a.stand)
SELECT plot, raw * k * bias AS pred FROM v JOIN f USING (stand)""")
def _(fx):
    v = X.mean_tree_volume(X.hypsometric_diameter("hmean", "hdom"), "hmean")
    d = panel(fx).withColumn("raw", F.col("n_obs") * v)
    cols = ["n_field", "n_obs", "y", "raw"]
    tot = d.agg(F.struct(*[F.sum(c).alias(c) for c in cols])).scalar()
    g = d.groupBy("stand").agg(*[F.sum(c).alias(f"g_{c}") for c in cols]).withColumn("t", tot)
    rest = {c: F.col("t")[c] - F.col(f"g_{c}") for c in cols}
    k = rest["n_field"] / rest["n_obs"]
    g = g.select("stand", k.alias("k"), (rest["y"] / (rest["raw"] * k)).alias("bias"))
    return d.join(g, "stand").withColumn("pred", F.col("raw") * F.col("k") * F.col("bias"))


@query("i33_counting_scores", "mae:d rmse:d rmae:d bias:d r:d ratio:d lo:d hi:d", f"""
WITH b AS (SELECT rep, avg(abs(n_obs - n_field)) AS mae FROM {boot_sql(EFFICIENCY, 12)} GROUP BY rep)
SELECT avg(abs(n_obs - n_field)) AS mae, sqrt(avg((n_obs - n_field) * (n_obs - n_field))) AS rmse, 100 * avg(abs(n_obs - n_field)) / avg(n_field) AS rmae, avg(n_obs - n_field) AS bias, corr(n_obs, n_field) AS r, sum(n_obs) / sum(n_field) AS ratio,
 (SELECT quantile_cont(mae, 0.025) FROM b) AS lo, (SELECT quantile_cont(mae, 0.975) FROM b) AS hi FROM fx_panel""")
def _(fx):
    b = P.weighted_scores(P.bootstrap(panel(fx), "plot", EFFICIENCY, 12, ["n_obs", "n_field"]), ["rep"], "n_field", "n_obs")
    q = exact_quantiles(b, [], "mae", {"lo": 0.025, "hi": 0.975}).select(F.struct("lo", "hi").alias("q")).scalar()
    e = F.col("n_obs") - F.col("n_field")
    a = panel(fx).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.abs(e)) / F.avg("n_field")).alias("rmae"), F.avg(e).alias("bias"),
                      F.corr("n_obs", "n_field").alias("r"), (F.sum("n_obs") / F.sum("n_field")).alias("ratio"))
    return a.withColumn("q", q).select("*", "q.lo", "q.hi")


@query("i41_error_propagation", "sigma:d err_mean:d err_sd:d", f"""
WITH d AS (SELECT sigma, rep, plot, n_field, vol_ha, hmean, {MECH} + sigma * {normal_sql('plot', 'rep', 'CAST(sigma * 10 AS BIGINT)')} AS d FROM fx_panel CROSS JOIN (VALUES (0.0), (0.5), (1.0), (2.0)) s(sigma) CROSS JOIN range(0, {ERRORS}) r(rep)),
v AS (SELECT sigma, rep, vol_ha, n_field * (-0.00490367 + 0.0001403 * d*d + 0.00003216 * d*d*hmean + 0.00035781 * hmean) AS v FROM d),
e AS (SELECT sigma, rep, sqrt(avg((v * k - vol_ha) * (v * k - vol_ha))) / avg(vol_ha) * 100 AS e FROM (SELECT *, sum(vol_ha) OVER w / sum(v) OVER w AS k FROM v WINDOW w AS (PARTITION BY sigma, rep)) GROUP BY 1, 2)
SELECT sigma, avg(e) AS err_mean, stddev_samp(e) AS err_sd FROM e GROUP BY sigma""")
def _(fx):
    d = T.with_params(fx.fx_panel, [{"sigma": s} for s in (0.0, 0.5, 1.0, 2.0)]).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(ERRORS - 1))))
    d = d.withColumn("d", X.hypsometric_diameter("hmean", "hdom") + F.col("sigma") * normal("plot", "rep", "CAST(sigma * 10 AS BIGINT)"))
    d = d.withColumn("v", F.col("n_field") * X.mean_tree_volume("d", "hmean"))
    k = d.groupBy("sigma", "rep").agg((F.sum("vol_ha") / F.sum("v")).alias("k"))
    e = F.col("v") * F.col("k") - F.col("vol_ha")
    e = d.join(k, ["sigma", "rep"]).groupBy("sigma", "rep").agg((F.sqrt(F.avg(e * e)) / F.avg("vol_ha") * 100).alias("e"))
    return e.groupBy("sigma").agg(F.avg("e").alias("err_mean"), F.stddev_samp("e").alias("err_sd"))


@query("i48_welch_comparison", "diff:d se:d t:d dof:d", f"""
WITH g AS (SELECT plot % 2 AS a, avg(pred - y) AS m, var_samp(pred - y) / count(*) AS v, count(*) AS c FROM {PANEL} GROUP BY 1)
SELECT b.m - a.m AS diff, sqrt(a.v + b.v) AS se, (b.m - a.m) / sqrt(a.v + b.v) AS t, (a.v + b.v) * (a.v + b.v) / (a.v*a.v / (a.c - 1) + b.v*b.v / (b.c - 1)) AS dof FROM g a, g b WHERE a.a = 0 AND b.a = 1""")
def _(fx):
    return P.welch(panel(fx).withColumn("arm", F.col("plot") % 2).withColumn("e", F.col("pred") - F.col("y")), "arm", "e")


@query("i49_spearman", "stand:i rho:d", """
SELECT stand, corr(a, b) AS rho FROM (SELECT stand, rank() OVER (PARTITION BY stand ORDER BY dbh_cm) + (count(*) OVER (PARTITION BY stand, dbh_cm) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY stand ORDER BY h_m) + (count(*) OVER (PARTITION BY stand, h_m) - 1) / 2.0 AS b FROM fx_trees) GROUP BY stand""")
def _(fx):
    return P.spearman(fx.fx_trees, "dbh_cm", "h_m", ["stand"])


@query("i50_site_comparison", "stand:i base_rmse:d cand_rmse:d gain:d wins:i", f"""
SELECT stand, sqrt(avg((m - y)*(m - y))) AS base_rmse, sqrt(avg((pred - y)*(pred - y))) AS cand_rmse, sqrt(avg((m - y)*(m - y))) - sqrt(avg((pred - y)*(pred - y))) AS gain, count(*) FILTER (abs(pred - y) < abs(m - y)) AS wins
FROM (SELECT *, avg(y) OVER () AS m FROM {PANEL}) GROUP BY stand HAVING count(*) >= 3""")
def _(fx):
    d = panel(fx).withColumn("m", panel(fx).agg(F.avg("y")).scalar())
    a, b = F.col("m") - F.col("y"), F.col("pred") - F.col("y")
    g = d.groupBy("stand").agg(F.sqrt(F.avg(a * a)).alias("base_rmse"), F.sqrt(F.avg(b * b)).alias("cand_rmse"), F.count_if(F.abs(b) < F.abs(a)).alias("wins"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 3").withColumn("gain", F.col("base_rmse") - F.col("cand_rmse"))


# ---- linear models ------------------------------------------------------------------------------

@query("j01_mean_model", "stand:i pred:d", f"SELECT a.stand, avg(b.y) AS pred FROM (SELECT DISTINCT stand FROM fx_panel) a JOIN {PANEL} b ON a.stand <> b.stand GROUP BY a.stand")
def _(fx):
    d = panel(fx)
    t = d.agg(F.struct(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))).scalar()
    g = d.groupBy("stand").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).withColumn("t", t)
    return g.select("stand", ((F.col("t.s") - F.col("s")) / (F.col("t.n") - F.col("n"))).alias("pred"))


def logs(fx):
    return fx.fx_volumes.select("arv", "talhao", F.log("d_cm").alias("ld"), F.log("h_m").alias("lh"), F.log("v").alias("lv"), "v", "d_cm", "h_m")


LOGFIT = """(SELECT regr_intercept(ln(v), ln(d_cm)) AS a, regr_slope(ln(v), ln(d_cm)) AS b, sqrt((1 - corr(ln(v), ln(d_cm)) * corr(ln(v), ln(d_cm))) * var_samp(ln(v))) AS s FROM fx_volumes)"""


@query("j02_log_allometry", "arv:i pred:d lo:d hi:d", f"""
SELECT arv, exp(a + b * ln(d_cm)) AS pred, exp(a + b * ln(d_cm) - 1.959963984540054 * s) AS lo, exp(a + b * ln(d_cm) + 1.959963984540054 * s) AS hi FROM fx_volumes, {LOGFIT}""")
def _(fx):
    f = P.linear_fit(logs(fx), ["ld"], "lv")
    f = f.select(F.struct("b_0", "b_1", "resid_sd").alias("f")).scalar()
    d = logs(fx).withColumn("f", f)
    lp = F.col("f.b_0") + F.col("f.b_1") * F.col("ld")
    return d.select("arv", F.exp(lp).alias("pred"), F.exp(lp - X.Z_975 * F.col("f.resid_sd")).alias("lo"), F.exp(lp + X.Z_975 * F.col("f.resid_sd")).alias("hi"))


@query("j03_corrected_allometry", "arv:i pred:d", f"SELECT arv, exp(a + b * ln(d_cm) + s * s / 2) AS pred FROM fx_volumes, {LOGFIT}")
def _(fx):
    f = P.linear_fit(logs(fx), ["ld"], "lv").select(F.struct("b_0", "b_1", "resid_sd").alias("f")).scalar()
    d = logs(fx).withColumn("f", f)
    return d.select("arv", F.exp(F.col("f.b_0") + F.col("f.b_1") * F.col("ld") + F.col("f.resid_sd") * F.col("f.resid_sd") / 2).alias("pred"))


@query("j05_volume_refits", "form:s b_0:d b_1:d r2:d", """
SELECT 'v_h' AS form, regr_intercept(ln(v), ln(h_m)) AS b_0, regr_slope(ln(v), ln(h_m)) AS b_1, regr_r2(ln(v), ln(h_m)) AS r2 FROM fx_volumes UNION ALL
SELECT 'h_d', regr_intercept(ln(h_m), ln(d_cm)), regr_slope(ln(h_m), ln(d_cm)), regr_r2(ln(h_m), ln(d_cm)) FROM fx_volumes""")
def _(fx):
    a = P.linear_fit(logs(fx), ["lh"], "lv").withColumn("form", F.lit("v_h"))
    b = P.linear_fit(logs(fx), ["ld"], "lh").withColumn("form", F.lit("h_d"))
    return a.unionByName(b)


@query("j05_mean_tree_equation", "talhao:i n:i r2:d")
def _(fx):
    d = logs(fx).withColumn("d2", F.col("d_cm") * F.col("d_cm")).withColumn("d2h", F.col("d2") * F.col("h_m"))
    return P.linear_fit(d, ["d2", "d2h", "h_m"], "v", ["talhao"])


@query("j10_nearest_plots_regression", "plot:i pred:d", f"""
WITH s AS (SELECT avg(hdom) AS a, stddev_pop(hdom) AS b, avg(cover) AS c, stddev_pop(cover) AS d FROM fx_panel), z AS (SELECT plot, y, (hdom - a) / b AS x, (cover - c) / d AS w FROM {PANEL}, s),
n AS (SELECT p.plot, q.y, sqrt((p.x-q.x)*(p.x-q.x) + (p.w-q.w)*(p.w-q.w)) AS d, row_number() OVER (PARTITION BY p.plot ORDER BY (p.x-q.x)*(p.x-q.x) + (p.w-q.w)*(p.w-q.w), q.plot) AS k FROM z p JOIN z q ON p.plot <> q.plot)
SELECT plot, sum(y / greatest(d, 1e-12)) / sum(1 / greatest(d, 1e-12)) AS pred FROM n WHERE k <= 3 GROUP BY plot""")
def _(fx):
    from canopyframe.operators.spatial import self_neighbours
    d = panel(fx)
    s = d.agg(F.struct(F.avg("hdom").alias("a"), F.stddev_pop("hdom").alias("b"), F.avg("cover").alias("c"), F.stddev_pop("cover").alias("d"))).scalar()
    z = d.withColumn("s", s).select(F.lit(0).alias("k0"), "plot", "y", ((F.col("hdom") - F.col("s.a")) / F.col("s.b")).alias("x"), ((F.col("cover") - F.col("s.c")) / F.col("s.d")).alias("w"))
    nb = self_neighbours(z, "plot", 3, 0.5, ["k0"], ("x", "w")).join(z.select(F.col("plot").alias("nb"), "y"), "nb")
    w = 1 / F.greatest(F.sqrt("d2"), F.lit(1e-12))
    return nb.groupBy("plot").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("pred"))


@query("j13_best_subset", "subset:s err:d", f"""
WITH l AS (SELECT plot, stand, vol_ha AS raw, ln(vol_ha) AS y, ln(hdom) AS hdom, ln(age) AS age FROM fx_panel), o AS (SELECT 'hdom' AS subset, a.plot, exp(regr_intercept(b.y, b.hdom) + regr_slope(b.y, b.hdom) * any_value(a.hdom)) - any_value(a.raw) AS e FROM l a JOIN l b ON a.stand <> b.stand GROUP BY a.plot
 UNION ALL SELECT 'age', a.plot, exp(regr_intercept(b.y, b.age) + regr_slope(b.y, b.age) * any_value(a.age)) - any_value(a.raw) FROM l a JOIN l b ON a.stand <> b.stand GROUP BY a.plot
 UNION ALL SELECT 'hdom,age', q.plot, exp(q.pred) - p.vol_ha FROM ({OOF2.format('l', 'stand')}) q JOIN fx_panel p ON p.plot = q.plot)
SELECT subset, sum(e*e) AS err FROM o GROUP BY subset ORDER BY err LIMIT 1""")
def _(fx):
    d = panel(fx).select("plot", "stand", F.log("y").alias("ly"), F.log("hdom").alias("hdom"), F.log("age").alias("age"))
    raw = panel(fx).select("plot", F.col("y").alias("raw"))
    out = None
    for xs in [c for k in (1, 2) for c in combinations(["hdom", "age"], k)]:
        o = P.linear_oof(d, "plot", list(xs), "ly", "stand").join(raw, "plot").agg(F.sum(X.sq(F.exp("pred") - F.col("raw"))).alias("err")).withColumn("subset", F.lit(",".join(xs)))
        out = o if out is None else out.unionByName(o)
    return out.orderBy("err").limit(1)


@query("j15_baselines", "model:s rmse:d n:i", f"""
WITH h AS (SELECT avg((p - v)*(p - v)) AS m, count(*) AS n FROM (SELECT a.arv, any_value(a.v) AS v, pi() * any_value(a.d_cm) / 200 * any_value(a.d_cm) / 200 * any_value(a.h_m) * 0.5 AS p FROM fx_volumes a GROUP BY a.arv)),
m AS (SELECT avg(((sv - v) / (n - 1) - v) * ((sv - v) / (n - 1) - v)) AS m, count(*) AS n FROM (SELECT v, sum(v) OVER () AS sv, count(*) OVER () AS n FROM fx_volumes)),
t AS (SELECT v, h_m AS x, sum(1) OVER () - 1 AS n, sum(h_m) OVER () - h_m AS sx, sum(v) OVER () - v AS sy, sum(h_m*h_m) OVER () - h_m*h_m AS sxx, sum(h_m*v) OVER () - h_m*v AS sxy FROM fx_volumes),
l AS (SELECT avg(e*e) AS m, count(*) AS n FROM (SELECT (sy - b * sx) / n + b * x - v AS e FROM (SELECT *, (n*sxy - sx*sy) / (n*sxx - sx*sx) AS b FROM t)))
SELECT 'formula' AS model, sqrt(m) AS rmse, n FROM h UNION ALL SELECT 'mean', sqrt(m), n FROM m UNION ALL SELECT 'height', sqrt(m), n FROM l""")
def _(fx):
    v = fx.fx_volumes.withColumnRenamed("v", "y")
    form = v.select("arv", "y", X.form_factor_volume("d_cm", "h_m").alias("pred")).withColumn("model", F.lit("formula"))
    mean = P.linear_oof(v, "arv", ["h_m"], "y").select("arv", "y", "pred").withColumn("model", F.lit("height"))
    t = v.agg(F.struct(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))).scalar()
    avg = v.withColumn("t", t).select("arv", "y", ((F.col("t.s") - F.col("y")) / (F.col("t.n") - 1)).alias("pred")).withColumn("model", F.lit("mean"))
    return P.scores(form.unionByName(mean).unionByName(avg), ["model"])


@query("j16_fixed_column_baseline", "plot:i pred:d", OOF2.format(PANEL, "plot"))
def _(fx):
    return P.linear_oof(panel(fx), "plot", ["hdom", "age"], "y")


@query("h16_yield_curve", "hdom:d vol:d", f"""
SELECT h AS hdom, exp(a + b * ln(h)) AS vol FROM (SELECT unnest(range(10, 41)) AS h), (SELECT regr_intercept(ln(vol_ha), ln(hdom)) AS a, regr_slope(ln(vol_ha), ln(hdom)) AS b FROM fx_panel)""")
def _(fx):
    f = P.linear_fit(fx.fx_panel.select(F.log("hdom").alias("x"), F.log("vol_ha").alias("y")), ["x"], "y")
    return f.withColumn("hdom", F.explode(F.sequence(F.lit(10), F.lit(40)))).withColumn("vol", F.exp(F.col("b_0") + F.col("b_1") * F.log("hdom")))
