"""Lattices, fitted models and model-based evaluation."""
from pyspark.sql import Window, functions as F

from canopyframe.functions import scalars as X
from canopyframe.functions.hashing import mix, mix_sql, uniform
from canopyframe.operators import lattice as L, metrics as Q, models as M, panel as P, penalised as R, poses as O, transforms as T, trees as G
from canopyframe.operators.nms import merge
from canopyframe.operators.ranks import exact_quantiles, sorted_index
from canopyframe.operators.spatial import grid_join, nn_distance
from canopyframe.plans.joins import PLOTS
from canopyframe.plans.panels import PERM, REFIT, panel
from canopyframe.plans.rasters import DIST_COLS, LMOM_COLS, VOXEL_COLS
from canopyframe.plans.registry import query
from canopyframe.session import cut

DEGREES = list(range(0, 180, 15))


# ---- lattices -------------------------------------------------------------------------------------

HALVES = [i / 2 for i in range(360)]
ROW = """WITH p AS (SELECT stand, x - avg(x) OVER (PARTITION BY stand) AS px, y - avg(y) OVER (PARTITION BY stand) AS py FROM fx_trees), t AS (SELECT h / CAST(2 AS DOUBLE) AS d FROM range(0, 360) r(h)),
v AS (SELECT stand, d, -px * sin(radians(d)) + py * cos(radians(d)) AS v FROM p, t),
b AS (SELECT stand, d, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1, 2), h AS (SELECT stand, d, lo, hi, least(399, floor((v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 400)) AS b, count(*) AS c FROM v JOIN b USING (stand, d) GROUP BY ALL),
m AS (SELECT stand, d, c, lo + (b + 0.5) * (hi - lo) / 400 AS mid FROM h)
SELECT stand, d AS deg, sqrt(pow(sum(c * cos(2 * pi() / CAST(2.87 AS DOUBLE) * mid)), 2) + pow(sum(c * sin(2 * pi() / CAST(2.87 AS DOUBLE) * mid)), 2)) / (sum(c) + 1e-9) AS score FROM m GROUP BY 1, 2"""


@query("d75_row_periodicity", "stand:i deg:d score:d", ROW)
def _(fx):
    """Every half degree."""
    return O.rowness(fx.fx_trees, ["stand"], 2.87, HALVES)


@query("d75_best_azimuth", "stand:i deg:d contrast:d")
def _(fx):
    return L.best_azimuth(cut(O.rowness(fx.fx_trees, ["stand"], 2.87, HALVES)), ["stand"])


@query("d76_lattice_fit", "stand:i cost:d theta:d x0:d y0:d null_mean:d null_sd:d p_value:d")
def _(fx):
    """24 x 5 x 5 poses and narrower ones around the best, beside 19 maps of evenly spread points."""
    return O.lattice_null(fx.fx_trees, ["stand"], "tree_id", 2.87, 1.88)


@query("d77_lattice_occupancy", "stand:i nodes:i hit:i occupied:d", """
WITH q AS (SELECT stand, cos(0.3) * (x - 0.4) + sin(0.3) * (y - 0.2) AS u, -sin(0.3) * (x - 0.4) + cos(0.3) * (y - 0.2) AS v FROM fx_trees),
n AS (SELECT stand, (ceil(max(u) / 2.87) - floor(min(u) / 2.87) + 1) * (ceil(max(v) / 1.88) - floor(min(v) / 1.88) + 1) AS nodes FROM q GROUP BY stand),
h AS (SELECT stand, count(*) AS hit FROM (SELECT DISTINCT stand, round(u / 2.87) AS i, round(v / 1.88) AS j FROM q WHERE pow(u - round(u / 2.87) * 2.87, 2) + pow(v - round(v / 1.88) * 1.88, 2) <= 0.94 * 0.94) GROUP BY stand)
SELECT stand, nodes, hit, hit / nodes AS occupied FROM n JOIN h USING (stand)""")
def _(fx):
    pose = fx.fx_trees.select("stand").distinct().select("stand", F.lit(0.3).alias("theta"), F.lit(0.4).alias("x0"), F.lit(0.2).alias("y0"))
    return L.occupancy(fx.fx_trees, pose, ["stand"], 2.87, 1.88)


@query("d78_lattice_residual", "stand:i deg:d residual:d")
def _(fx):
    return L.lattice_residual(fx.fx_trees, ["stand"], 1.88, 2.87, DEGREES)


@query("d79_census_lattice", "plot:i tree_id:i u:d v:d", """
WITH n AS (SELECT plot, tree_id, CASE WHEN linha % 2 = 0 THEN count(*) OVER w - row_number() OVER o ELSE row_number() OVER o - 1 END * CAST(1.88 AS DOUBLE) AS u, (linha - 1) * CAST(2.87 AS DOUBLE) AS v FROM fx_census
 WINDOW w AS (PARTITION BY plot, linha), o AS (PARTITION BY plot, linha ORDER BY arvore)) SELECT plot, tree_id, u - avg(u) OVER (PARTITION BY plot) AS u, v - avg(v) OVER (PARTITION BY plot) AS v FROM n""")
def _(fx):
    return L.census_lattice(fx.fx_census, "plot", 1.88, 2.87, True)


@query("d80_plot_registration", "plot:i cost:d theta:d dx:d dy:d null_mean:d null_sd:d p_value:d")
def _(fx):
    """Every 3 degrees and 0.4 m and narrower poses around the best, beside 400 random poses."""
    return O.register(L.census_lattice(fx.fx_census, "plot", 1.88, 2.87), fx.fx_trees, fx.fx_plots, 2.87)


# Thinnings of the null map, the smallest planting spacing, the share of it that counts as impossible, the merge radius.
THINNINGS, SPACING, SLACK, MERGED = 300, 1.88, 0.98, 1.6


@query("d81_spacing_diagnostics", "stand:i n:i below:d merge_window:d below_1m5:d null_below:d")
def _(fx):
    """Shares of detections too near to another of their view, beside the true map thinned at random to the detection share."""
    det = nn_distance(fx.fx_detections.select("stand", "view_id", "det_id", "x", "y"), "det_id", 4.0, ["stand", "view_id"])
    sy = SPACING * SLACK
    d = det.groupBy("stand").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("nn") < sy).cast("double")).alias("below"), F.avg(((F.col("nn") >= 1.5) & (F.col("nn") < sy)).cast("double")).alias("merge_window"),
                                 F.avg((F.col("nn") < 1.5).cast("double")).alias("below_1m5"))
    # only pairs under the spacing count, so a stem's nearer stems are listed once and each thinning asks which of them it kept
    t = fx.fx_trees.select("stand", "tree_id", "x", "y")
    near = grid_join(t, t.select("stand", F.col("tree_id").alias("oid"), F.col("x").alias("cx"), F.col("y").alias("cy")), sy).where((F.col("tree_id") != F.col("oid")) & (F.col("d2") < sy * sy))
    reps = F.explode(F.sequence(F.lit(1), F.lit(THINNINGS)))
    share = lambda c: uniform(c, "rep", 5) < 0.6
    kept = t.select("stand", "tree_id").withColumn("rep", reps).where(share("tree_id")).groupBy("stand", "rep").agg(F.count(F.lit(1)).alias("kept"))
    hit = near.select("stand", "tree_id", "oid").withColumn("rep", reps).where(share("tree_id") & share("oid")).groupBy("stand", "rep").agg(F.count_distinct("tree_id").alias("hit"))
    null = kept.join(hit, ["stand", "rep"], "left").groupBy("stand").agg(F.avg(F.coalesce("hit", F.lit(0)) / F.col("kept")).alias("null_below"))
    return d.join(null, "stand")


@query("d81_merged_spacing", "stand:i n:i usable:b nn_min:d nn_median:d impossible:d n_impossible:i")
def _(fx):
    """The same after the merge, where the spacing leaves a window above the merge radius."""
    kept = cut(merge(fx.fx_detections.select("stand", "det_id", "n_pts", "x", "y"), "det_id", "n_pts", MERGED))
    nn = cut(nn_distance(kept, "det_id", 4.0, ["stand"]))
    usable = SPACING > MERGED
    bad = F.col("nn") < SPACING * SLACK
    g = nn.groupBy("stand").agg(F.count(F.lit(1)).alias("n"), F.min("nn").alias("nn_min"), F.when(F.lit(usable), F.avg(bad.cast("double"))).alias("impossible"), F.when(F.lit(usable), F.count_if(bad)).otherwise(0).alias("n_impossible"))
    return g.join(exact_quantiles(nn, ["stand"], "nn", {"nn_median": 0.5}), "stand").withColumn("usable", F.lit(usable))


# ---- fitted models ----------------------------------------------------------------------------------

XS = ["hdom", "hmean", "zsd", "cover", "age"]


def folded(fx, k=4):
    return M.with_folds(panel(fx).drop("pred").withColumn("row", F.col("plot")), "stand", k)


@query("j04_robust_yield_model", "plot:i pred:d")
def _(fx):
    d = fx.fx_panel.select("plot", F.log("hdom").alias("lh"), F.log("age").alias("la"), F.log("vol_ha").alias("lv"))
    return M.huber(["lh", "la"], "lv")().fit(d).transform(d).withColumn("pred", F.exp("prediction"))


def chosen_inside(fx, kind):
    out = [R.in_fold(panel(fx), "plot", XS, "y", key, kind).select(F.lit(key).alias("scheme"), "plot", "y", "pred", "share", "penalty") for key in ("plot", "stand")]
    return out[0].unionByName(out[1])


@query("j06_ridge", "scheme:s plot:i y:d pred:d penalty:d")
def _(fx):
    """Every plot and every stand left out, the penalty chosen on the rest alone."""
    return chosen_inside(fx, "ridge")


RIDGE_ONE = f"""
WITH p AS (SELECT plot, stand, hdom AS x, vol_ha AS y, {mix_sql('plot', 17)} % 4 AS part FROM fx_panel), f AS (SELECT DISTINCT stand AS fold FROM p), a AS (SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0]::DOUBLE[]) AS penalty),
t AS (SELECT fold, j, penalty, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / (var_pop(x) * (1 + penalty / count(*))) AS b FROM p JOIN f ON stand <> fold CROSS JOIN range(0, 4) r(j) CROSS JOIN a WHERE part <> j GROUP BY fold, j, penalty),
e AS (SELECT fold, t.penalty, sum(pow(my + b * (x - mx) - y, 2)) AS e FROM t JOIN p ON stand <> fold AND part = j GROUP BY fold, t.penalty),
c AS (SELECT fold, penalty FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY e, penalty) AS o FROM e) WHERE o = 1),
w AS (SELECT fold, penalty, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / (var_pop(x) * (1 + penalty / count(*))) AS b FROM c JOIN p ON stand <> fold GROUP BY fold, penalty)
SELECT plot, y, my + b * (x - mx) AS pred, penalty FROM p JOIN w ON stand = fold"""


@query("j06_ridge_one_feature", "plot:i y:d pred:d penalty:d", RIDGE_ONE)
def _(fx):
    return R.in_fold(panel(fx), "plot", ["hdom"], "y", "stand", "ridge")


@query("j07_elastic_net", "scheme:s plot:i y:d pred:d share:d penalty:d")
def _(fx):
    """Share and penalty chosen on the rest of every left-out plot and stand."""
    return chosen_inside(fx, "elastic")


@query("j13_nested_subsets", "plot:i y:d pred:d subset:s")
def _(fx):
    """Up to three of five features in logarithms, chosen by leaving out each of the other stands in turn, in the target's units."""
    return R.nested_subsets(panel(fx), "plot", XS, "y", "stand", 3)


@query("j13_robust_subsets", "plot:i y:d pred:d subset:s")
def _(fx):
    return R.nested_subsets(panel(fx), "plot", XS, "y", "stand", 3, robust=True)


@query("j08_random_forest", "scheme:s plot:i y:d pred:d")
def _(fx):
    """500 trees for every plot and every stand left out (one plot: those of 1360 whose bootstrap never drew it)."""
    return G.held_out(panel(fx), "plot", XS, "y", ["plot", "stand"], G.forest(500, 2, 0.6), every=False)[0]


@query("j08_forest_report", "scheme:s n:i r2:d rmse:d")
def _(fx):
    return P.scores(G.held_out(panel(fx), "plot", XS, "y", ["plot", "stand"], G.forest(500, 2, 0.6), every=False)[0], ["scheme"])


@query("i18_seeded_forests", "scheme:s r2_mean:d r2_sd:d r2_min:d r2_max:d n_seeds:i")
def _(fx):
    """Held-out R2 of five forests that differ in their seed alone."""
    out = None
    for k in range(5):
        r = P.scores(G.held_out(panel(fx), "plot", XS, "y", ["plot", "stand"], G.forest(500, 2, 0.6, seed=k), every=False)[0], ["scheme"])
        out = r if out is None else out.unionByName(r)
    return out.groupBy("scheme").agg(F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_sd"), F.min("r2").alias("r2_min"), F.max("r2").alias("r2_max"), F.count(F.lit(1)).alias("n_seeds"))


@query("j09_boosted_trees", "scheme:s plot:i y:d pred:d")
def _(fx):
    """100 rounds, refitted for every plot and every stand left out."""
    return G.held_out(panel(fx), "plot", XS, "y", ["plot", "stand"], G.boosting(100, 3, 0.1))[0]


@query("j09_volume_importance", "feature:s importance:d")
def _(fx):
    """Mean drop of R2 over 30 shuffles of each feature, model of all plots."""
    d = panel(fx).drop("pred").withColumn("row", F.col("plot"))
    return M.permutation_importance(G.fit(d, "plot", XS, "y", G.boosting(100, 3, 0.1)), d, XS, "y", 30)


@query("j11_component_regression", "model:s n:i rmse:d r2:d")
def _(fx):
    return M.choose({f"pca_{k}": M.components(XS, "y", k) for k in (1, 2, 3)}, folded(fx), "plot", "y")[1]


@query("j12_partial_least_squares", "plot:i pred:d")
def _(fx):
    b, a = M.partial_least_squares(panel(fx), XS, "y", 2)
    return panel(fx).select("plot", M.linear_score(XS, b, a).alias("pred"))


@query("j14_permutation_importance", "feature:s importance:d")
def _(fx):
    d = folded(fx)
    return M.permutation_importance(M.ridge(XS, "y", 0.01)().fit(d), d, XS, "y", 10)


@query("f05_feature_top_k", "model:s n:i rmse:d r2:d")
def _(fx):
    d = folded(fx)
    rank = M.permutation_importance(M.ridge(XS, "y", 0.01)().fit(d), d, XS, "y", 5).orderBy(F.col("importance").desc(), "feature").limit(5).collect()
    best = [r.feature for r in rank]
    return M.choose({f"top_{k}": M.ridge(best[:k], "y", 0.01) for k in (1, 2, 3, 5)}, d, "plot", "y")[1].orderBy("rmse").limit(1)


@query("j17_ordinal_size_classes", "n:i accuracy:d kappa:d macro_f1:d")
def _(fx):
    """Three size classes from cumulative binaries, 500 trees each, over five blocks left out in turn."""
    d = cut(P.blocks(P.blocks(fx.fx_trees, "dbh_cm", 3, "cls", right=True), "x", 5))
    out = d.select("tree_id", "cls")
    for c in (0, 1):
        p = G.held_out(d.withColumn("above", (F.col("cls") > c).cast("double")), "tree_id", ["h_m", "x", "y"], "above", ["block"], G.forest(500, 3, 0.4), every=False)[0]
        out = out.join(p.select("tree_id", F.col("pred").alias(f"p{c}")), "tree_id")
    share = [1 - F.col("p0"), F.col("p0") - F.col("p1"), F.col("p1")]
    top = F.greatest(*share)
    return M.agreement(out.withColumn("pred", F.when(share[0] == top, 0).when(share[1] == top, 1).otherwise(2)), 3)


@query("j18_stand_intercepts", "stand:i n:i u:d sd_seen:d sd_unseen:d icc:d", """
WITH r AS (SELECT stand, y - pred AS e FROM (SELECT stand, ln(vol_ha) AS y, regr_intercept(ln(vol_ha), ln(hdom)) OVER () + regr_slope(ln(vol_ha), ln(hdom)) OVER () * ln(hdom) AS pred FROM fx_panel)),
g AS (SELECT stand, count(*) AS n, avg(e) AS m, var_samp(e) * (count(*) - 1) AS ss FROM r GROUP BY stand), t AS (SELECT sum(n) AS nn, sum(n*n) AS n2, count(*) AS k, sum(ss) AS sw, sum(n * (m - (SELECT avg(e) FROM r)) * (m - (SELECT avg(e) FROM r))) AS sb FROM g),
v AS (SELECT sw / (nn - k) AS vr, greatest((sb / (k - 1) - sw / (nn - k)) / ((nn - n2 / nn) / (k - 1)), 0) AS vs FROM t)
SELECT stand, n, n * vs / (n * vs + vr) * m AS u, sqrt(vr + vs * (1 - n * vs / (n * vs + vr))) AS sd_seen, sqrt(vr + vs) AS sd_unseen, vs / (vs + vr) AS icc FROM g, v""")
def _(fx):
    d = fx.fx_panel.select("stand", F.log("hdom").alias("x"), F.log("vol_ha").alias("y"))
    f = P.linear_fit(d, ["x"], "y").select(F.struct("b_0", "b_1").alias("f")).scalar()
    return M.stand_intercepts(d.withColumn("f", f).withColumn("e", F.col("y") - F.col("f.b_0") - F.col("f.b_1") * F.col("x")), "stand")


CROWN_XS = ["n_pts", "wood_ratio", *(c.split(":")[0] for c in f"{DIST_COLS} {LMOM_COLS} {VOXEL_COLS}".split()), "lbi"]


def crowns_with_diameter(fx):
    """Crown features of every instance beside the diameter of its stem."""
    p = fx.fx_tree_pts
    d = p.groupBy("inst").agg(F.count(F.lit(1)).alias("n_pts"), F.avg((F.col("semantic") == 1).cast("double")).alias("wood_ratio"))
    for t in (Q.biomass_index(p, ["inst"]), Q.voxel_metrics(p, ["inst"]), Q.height_distribution(p.where("semantic = 2"), ["inst"])):
        d = d.join(t, "inst", "left")
    return cut(d.join(fx.fx_stems.select(F.col("stem").alias("inst"), (200 * F.col("r0")).alias("dbh_cm")), "inst"))


@query("j21_crown_diameter_model", "inst:i y:d pred:d")
def _(fx):
    """100 rounds on all crown features, one crown left out at a time."""
    return G.held_out(crowns_with_diameter(fx), "inst", CROWN_XS, "dbh_cm", ["inst"], G.boosting(100, 3, 0.1))[0]


@query("j21_crown_importance", "feature:s importance:d")
def _(fx):
    """Mean drop of R2 over 30 shuffles of the ten features with the largest share of the splits' gains."""
    d = crowns_with_diameter(fx).withColumn("row", F.col("inst"))
    model = G.fit(d, "inst", CROWN_XS, "dbh_cm", G.boosting(100, 3, 0.1))
    return M.permutation_importance(model, d, model.leading(10), "dbh_cm", 30)


# ---- model-based evaluation -------------------------------------------------------------------------


def block_table(fx):
    return P.blocks(fx.fx_trees, "x", 5, "fold")


@query("i08_spatial_block_cv", "scheme:s n:i rmse:d r2:d")
def _(fx):
    d = cut(block_table(fx))
    out = None
    for name, xs in (("height", ["h_m"]), ("position_only", ["x", "y"])):
        s = P.scores(P.linear_oof(d, "tree_id", xs, "dbh_cm", "fold"), []).withColumn("scheme", F.lit(name))
        out = s if out is None else out.unionByName(s)
    rnd = d.withColumn("fold", mix("tree_id", 5) % 5)
    return out.unionByName(P.scores(P.linear_oof(rnd, "tree_id", ["h_m"], "dbh_cm", "fold"), []).withColumn("scheme", F.lit("random_folds")))


@query("i10_guarded_block_cv", "fold:i n_train:i n_test:i rmse:d")
def _(fx):
    """Training trees closer than 2R to a test tree are left out of that fold."""
    d = cut(block_table(fx).select("stand", "tree_id", "x", "y", "fold", "h_m", "dbh_cm"))
    guard = 4.0
    near = grid_join(d.select("stand", "x", "y", "tree_id", F.col("fold").alias("own")), d.select("stand", "fold", F.col("x").alias("cx"), F.col("y").alias("cy")), guard)
    near = near.where("own <> fold").select("tree_id", "fold").distinct()
    folds = d.select("fold").distinct()
    train = d.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("own <> fold")
    train = train.join(near, ["tree_id", "fold"], "left_anti").join(folds, "fold", "left_semi")
    fit = P.linear_fit(train, ["h_m"], "dbh_cm", ["fold"])
    p = d.join(fit.select("fold", "b_0", "b_1", F.col("n").alias("n_train")), "fold")
    e = F.col("b_0") + F.col("b_1") * F.col("h_m") - F.col("dbh_cm")
    return p.groupBy("fold").agg(F.max("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(e * e)).alias("rmse"))


@query("i39_held_out_classifier", "auc:d seen_threshold:d seen_f1:d f1:d precision:d recall:d")
def _(fx):
    """500 trees over five blocks left out in turn; each block is filtered by the threshold that is best on the other blocks."""
    d = fx.fx_detections.join(fx.fx_trees.select("tree_id", F.col("x").alias("tx"), F.col("y").alias("ty")), "tree_id")
    d = d.withColumn("label", (X.hyp(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")) < 0.9).cast("double"))
    d = cut(P.blocks(d.select("det_id", "n_pts", "z_max", "view_id", "x", "label"), "x", 5))
    s = G.Settings(500, min_leaf=5, depth=8, bins=64)
    p = cut(d.join(G.held_out(d, "det_id", ["n_pts", "z_max", "view_id"], "label", ["block"], s, every=False)[0].select("det_id", "pred"), "det_id").select("block", "label", F.round("pred", 6).alias("p")))
    # counts of each block at each threshold; of all blocks and of all but one by sums
    grid = [round(0.05 + i / 100, 2) for i in range(91)]
    t = (T.with_params(p, [{"threshold": g} for g in grid]).groupBy("block", "threshold")
         .agg(F.sum(F.when(F.col("p") >= F.col("threshold"), F.col("label")).otherwise(0)).alias("tp"), F.sum((F.col("p") >= F.col("threshold")).cast("double")).alias("np"), F.sum("label").alias("nr")))
    t = cut(t)
    every = t.groupBy("threshold").agg(F.sum("tp").alias("a_tp"), F.sum("np").alias("a_np"), F.sum("nr").alias("a_nr"))
    f1 = lambda tp, n, r: F.coalesce(F.try_divide(2 * tp, n + r), F.lit(0.0))
    seen = every.agg(F.max(F.struct(f1(F.col("a_tp"), F.col("a_np"), F.col("a_nr")).alias("f"), (-F.col("threshold")).alias("o"))).alias("m")).select(
        F.struct((-F.col("m.o")).alias("seen_threshold"), F.col("m.f").alias("seen_f1")).alias("s")).scalar()
    rest = t.join(every, "threshold").withColumn("f", f1(F.col("a_tp") - F.col("tp"), F.col("a_np") - F.col("np"), F.col("a_nr") - F.col("nr")))
    own = rest.groupBy("block").agg(F.max(F.struct("f", (-F.col("threshold")).alias("o"), "tp", "np", "nr")).alias("m"))
    out = own.agg(F.sum("m.tp").alias("tp"), F.sum("m.np").alias("np"), F.sum("m.nr").alias("nr"))
    return out.select(M.auc(p, "label", "p").scalar().alias("auc"), seen.alias("s"), f1(F.col("tp"), F.col("np"), F.col("nr")).alias("f1"), F.try_divide("tp", "np").alias("precision"),
                      F.try_divide("tp", "nr").alias("recall")).select("auc", "s.*", "f1", "precision", "recall")


@query("i40_split_half_reliability", "n:i sd_half:d sd_full:d ceiling:d")
def _(fx):
    from canopyframe.operators.stems import radial_mode
    from canopyframe.plans.stems import wood
    w = wood(fx).withColumn("half", mix("pid", 3) % 2)
    r = radial_mode(w, ["inst", "half"]).groupBy("inst").agg(F.max(F.when(F.col("half") == 0, F.col("r"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("r"))).alias("b"))
    g = r.agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp(F.col("a") - F.col("b")) / F.sqrt(F.lit(2.0))).alias("sd_half"), F.var_samp((F.col("a") + F.col("b")) / 2).alias("v"))
    return g.withColumn("sd_full", F.col("sd_half") / F.sqrt(F.lit(2.0))).withColumn("ceiling", 1 - F.col("sd_full") * F.col("sd_full") / F.col("v"))


# Training trees per fold (the last takes all) and seeds.
CURVE, CURVE_SEEDS = (50, 100, 200, 400, 600, 1_000_000_000), (1, 2, 3)


@query("i42_learning_curve", "size:i seed:i n:i r2:d rmse:d")
def _(fx):
    """Five blocks left out in turn; every fold trains on as many of its other trees as the size says."""
    base = cut(block_table(fx).select("tree_id", "fold", "h_m", "dbh_cm"))
    *few, every = CURVE
    others = base.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("own <> fold")
    # every size takes the first rows of one order, so a task sends on only as many as the largest takes
    order = Window.partitionBy("seed", "fold").orderBy(mix("tree_id", "seed", 9), "tree_id")
    first = T.with_params(others, [{"seed": k} for k in CURVE_SEEDS]).withColumn("i", F.row_number().over(order)).where(F.col("i") <= max(few))
    train = T.with_params(cut(first), [{"size": s} for s in few]).where("i <= size")
    names = ["size", "seed", "fold", "b_0", "b_1"]
    fit = P.linear_fit(train, ["h_m"], "dbh_cm", ["size", "seed", "fold"]).select(*names)
    whole = T.with_params(P.linear_fit(others, ["h_m"], "dbh_cm", ["fold"]), [{"size": every, "seed": k} for k in CURVE_SEEDS]).select(*names)
    fits = cut(fit.unionByName(whole))  # one row per size, seed and fold
    p = base.join(fits, "fold", "left").where("size is not null").withColumns({"pred": F.col("b_0") + F.col("b_1") * F.col("h_m"), "y": F.col("dbh_cm")})
    return P.scores(p, ["size", "seed"])


@query("i43_feature_ladder", "rung:s r2:d shuffled_r2:d")
def _(fx):
    """Rungs of growing feature sets, each beside its label-shuffled control and a planted positive one."""
    d = cut(block_table(fx).withColumn("planted", F.col("dbh_cm") + uniform("tree_id", 3)))
    shuffled = cut(P.permuted(d, "tree_id", "dbh_cm", 20, 4))
    out = None
    for name, xs in (("position", ["x", "y"]), ("height", ["x", "y", "h_m"]), ("planted", ["planted"])):
        r = P.scores(P.linear_oof(d, "tree_id", xs, "dbh_cm", "fold"), [])
        s = P.scores(P.linear_oof(shuffled, "tree_id", xs, "dbh_cm", "fold", by=["rep"]), ["rep"]).agg(F.avg("r2")).scalar()
        r = r.select(F.lit(name).alias("rung"), "r2", s.alias("shuffled_r2"))
        out = r if out is None else out.unionByName(r)
    return out


@query("i47_group_peak_correlation", "r:d p_value:d groups:i")
def _(fx):
    from canopyframe.operators.stems import kernel_profile, profile_peak
    from canopyframe.plans.stems import wood
    s = P.blocks(fx.fx_stems, "r0", 10, "grp", right=True)
    w = wood(fx).join(s.select(F.col("stem").alias("inst"), "grp"), "inst")
    peak = profile_peak(kernel_profile(w, ["grp"]), ["grp"]).join(s.groupBy("grp").agg(F.avg("r0").alias("true_r")), "grp").where("peak is not null")
    peak = cut(peak)
    null = P.permuted(peak, "grp", "peak", PERM, 3).groupBy("rep").agg(P.pearson("peak", "true_r").alias("r"))
    obs = peak.agg(P.pearson("peak", "true_r")).scalar()
    n = peak.agg(F.count(F.lit(1))).scalar()
    return P.add_one_p(null, "r", obs).select(obs.alias("r"), "p_value", n.alias("groups"))


@query("l01_model_factory", "scheme:s plot:i y:d pred:d lo:d hi:d")
def _(fx):
    """Any model with fit, predict and predict_interval, refitted for every plot and every stand left out."""
    return M.factory_oof(M.LogLinear, panel(fx), "plot", ["hdom", "age"], "y", ["plot", "stand"])


@query("l03_callback_permutation", "p_value:d null_mean:d null_sd:d")
def _(fx):
    """A DataFrame -> DataFrame fold function runs inside the null with the replicate as a key."""
    def run(df, by=()):
        return P.linear_oof(df, "plot", ["hdom", "age"], "y", "stand", by=by)
    null = P.scores(run(P.permuted(panel(fx), "plot", "y", REFIT, 2), ["rep"]), ["rep"])
    return P.add_one_p(null, "r2", P.scores(run(panel(fx)), []).select("r2").scalar())
