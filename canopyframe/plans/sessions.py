"""Sessions, merge sweeps and matched evaluations."""
from pyspark.sql import functions as F

from canopyframe.functions import scalars as X
from canopyframe.functions.hashing import uniform
from canopyframe.operators import assign as A, matching as M, panel as P, spatial as S, subsets as V, transforms as T
from canopyframe.operators.nms import merge, nms
from canopyframe.operators.ranks import exact_quantiles
from canopyframe.plans.joins import PLOTS, view_pairs
from canopyframe.plans.registry import query
from canopyframe.plans.scans import DISTIL, DISTIL_COLS
from canopyframe.session import cut
from canopyframe.sources.fixtures import VIEWS
from canopyframe.streaming import sessions as K

NN = """(SELECT a.stand, a.tile_seq, a.event_id, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))) AS nn FROM fx_tile_events a JOIN fx_tile_events b
 ON a.stand = b.stand AND a.tile_seq = b.tile_seq AND a.event_id <> b.event_id GROUP BY 1, 2, 3)"""


def tiles(fx):
    return fx.fx_tile_events.select(F.col("event_id").alias("det_id"), "stand", "tile_seq", "x", "y", F.col("size").cast("double").alias("size"))


@query("e07_causal_spacing", "stand:i tile_seq:i spacing:d", f"""
SELECT t.stand, t.tile_seq, median(nn) AS spacing FROM (SELECT DISTINCT stand, tile_seq FROM fx_tile_events) t JOIN {NN} n ON n.stand = t.stand AND n.tile_seq <= t.tile_seq GROUP BY 1, 2""")
def _(fx):
    return K.causal_spacing(tiles(fx), "det_id", side=8.0)


@query("k01_batch_adaptive_merge", "stand:i det_id:i radius:d")
def _(fx):
    return K.merge_batch(tiles(fx), "det_id", "size", fraction=0.3, side=8.0)


@query("k01_stand_radius", "stand:i spacing:d radius:d", f"SELECT stand, median(nn) AS spacing, least(greatest(0.3 * median(nn), 1.0), 2.0) AS radius FROM {NN} GROUP BY stand")
def _(fx):
    return K.stand_radius(tiles(fx), "det_id", fraction=0.3, side=8.0)


def table_source(fx, name: str) -> str:
    """A table's path for a stream: as a pattern it may be a single file or a folder of files."""
    return f"{fx.folder}/{name}.parque[t]"


@query("k02_streaming_merge", "det_id:i stand:i tile_seq:i radius:d")
def _(fx):
    raw = fx.spark.readStream.schema(fx.events.schema).parquet(table_source(fx, "events"))
    t = fx.spark.sql(VIEWS["fx_tile_events"], events=raw).withColumnRenamed("event_id", "det_id")
    return K.run_available(K.merge_stream(t, fraction=0.3), "kept")


@query("k03_interior_detections", "stand:i tile_seq:i n:i", """
SELECT e.stand, e.tile_seq, count(*) AS n FROM fx_tile_events e JOIN (SELECT stand, tile_seq, avg(x) AS cx, avg(y) AS cy FROM fx_tile_events GROUP BY 1, 2) c USING (stand, tile_seq)
WHERE abs(x - cx) <= 30 AND abs(y - cy) <= 30 GROUP BY 1, 2""")
def _(fx):
    c = tiles(fx).groupBy("stand", "tile_seq").agg(F.avg("x").alias("tcx"), F.avg("y").alias("tcy"))
    return K.interior(tiles(fx), c, 30.0).groupBy("stand", "tile_seq").agg(F.count(F.lit(1)).alias("n"))


@query("k04_incremental_distillation", DISTIL_COLS, DISTIL)
def _(fx):
    raw = fx.spark.readStream.schema(fx.lineitem.schema).parquet(table_source(fx, "lineitem"))
    def view(name, **src):
        return fx.spark.sql(VIEWS[name], **src)
    s = view("fx_labelled", fx_stem1=view("fx_stem1", fx_stem0=view("fx_stem0", lineitem=raw)))
    return K.distil_stream(s, "distilled")


# ---- merge radius sweeps ------------------------------------------------------------------------

# The swept merge radii in metres, and those of the sensitivity table.
RADII = (1.1, 1.3, 1.5, 1.7, 1.9, 2.1, 2.3)
SENSITIVITY = (1.0, 1.2, 1.5, 1.6, 1.8, 2.0, 2.5)


def merged_by_radius(fx, radii=RADII):
    d = T.with_params(fx.fx_detections, [{"radius": r} for r in radii])
    kept = nms(d, "det_id", "n_pts", "radius", ["stand", "radius"])
    return cut(d.join(kept, ["stand", "radius", "det_id"], "left_semi"))


def refs_by(fx, name, values):
    r = fx.fx_trees.select("stand", F.col("tree_id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return T.with_params(r, [{name: v} for v in values])


def sweep(fx):
    """Matched counts per (stand, merge radius) at a 2 m cap, with F1."""
    kept = merged_by_radius(fx).withColumnRenamed("det_id", "did")
    refs = refs_by(fx, "radius", RADII)
    c = M.match_counts(refs, kept, M.match(refs, kept, 2.0, ["stand", "radius"]), ["stand", "radius"])
    return c.withColumn("f1", X.precision_recall_f1("tp", "n_pred", "n_ref")[2])


SWEEP = "stand:i radius:d n_ref:i n_pred:i tp:i f1:d"


@query("f03_sweep_choice", "radius:d f1:d")
def _(fx):
    g = sweep(fx).groupBy("radius").agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("np"), F.sum("n_ref").alias("nr"))
    return g.withColumn("f1", X.precision_recall_f1("tp", "np", "nr")[2]).orderBy(F.col("f1").desc(), "radius").limit(1)


@query("i37_chosen_elsewhere", "stand:i chosen:d f1:d best_f1:d")
def _(fx):
    """The radius chosen on all other stands together, measured on each stand."""
    s = cut(sweep(fx))
    tot = s.groupBy("radius").agg(*[F.sum(c).alias(f"t_{c}") for c in ("tp", "n_pred", "n_ref")])
    rest = s.join(tot, "radius").withColumn("other", X.precision_recall_f1(F.col("t_tp") - F.col("tp"), F.col("t_n_pred") - F.col("n_pred"), F.col("t_n_ref") - F.col("n_ref"))[2])
    return rest.groupBy("stand").agg(F.max_by("radius", F.struct("other", -F.col("radius"))).alias("chosen"), F.max_by("f1", F.struct("other", -F.col("radius"))).alias("f1"), F.max("f1").alias("best_f1"))


@query("i45_radius_sensitivity", "radius:d n:i pairs:i")
def _(fx):
    kept = merged_by_radius(fx, SENSITIVITY)
    p = S.close_pairs(kept, "det_id", 1.6, ["stand", "radius"]).groupBy("radius").agg(F.count(F.lit(1)).alias("pairs"))
    return kept.groupBy("radius").agg(F.count(F.lit(1)).alias("n")).join(p, "radius", "left").na.fill(0, ["pairs"])


@query("i46_wall_to_wall_sweep", "radius:d f1:d census_ratio:d")
def _(fx):
    s = sweep(fx).groupBy("radius").agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("np"), F.sum("n_ref").alias("nr"))
    return s.select("radius", X.precision_recall_f1("tp", "np", "nr")[2].alias("f1"), (F.col("np") / F.col("nr")).alias("census_ratio"))


@query("g04_view_subsets", "mask:i n_views:i n:i tp:i p:d r:d f1:d")
def _(fx):
    """All non-empty subsets of the views (511 of nine), merged and scored together; a mask's bit v stands for view v."""
    kept, views = V.suppress_subsets(fx.fx_detections, "det_id", "n_pts", "view_id", 1.5)
    refs = fx.fx_trees.select("stand", F.col("tree_id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    tp = V.matched_by_subset(refs, kept.withColumnRenamed("det_id", "did"), views, 1.5)
    nr = refs.agg(F.count(F.lit(1))).scalar()
    p, r, f1 = X.precision_recall_f1("tp", "n", "nr")
    g = V.kept_counts(kept, views).withColumnRenamed("n_pred", "n").join(tp, "mask", "left").na.fill(0, ["tp"]).withColumn("nr", nr)
    return g.select("mask", F.bit_count(F.col("mask")).alias("n_views"), "n", "tp", p.alias("p"), r.alias("r"), f1.alias("f1"))


@query("g04_single_views", "view_id:i n:i", """
WITH RECURSIVE d AS (SELECT stand, view_id, det_id, x, y, row_number() OVER (PARTITION BY stand, view_id ORDER BY n_pts DESC, det_id) AS o FROM fx_detections),
k AS (SELECT stand, view_id, 0 AS o, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS kept FROM d GROUP BY ALL UNION ALL
 SELECT k.stand, k.view_id, d.o, CASE WHEN len(list_filter(kept, lambda q: (q.x - d.x) * (q.x - d.x) + (q.y - d.y) * (q.y - d.y) <= CAST(1.5 AS DOUBLE) * CAST(1.5 AS DOUBLE))) = 0 THEN list_append(kept, {'x': d.x, 'y': d.y}) ELSE kept END
 FROM k JOIN d ON d.stand = k.stand AND d.view_id = k.view_id AND d.o = k.o + 1)
SELECT view_id, sum(len(kept)) AS n FROM (SELECT stand, view_id, arg_max(kept, o) AS kept FROM k GROUP BY ALL) GROUP BY view_id""")
def _(fx):
    """The subsets of one view, beside the sequential rule."""
    kept, views = V.suppress_subsets(fx.fx_detections, "det_id", "n_pts", "view_id", 1.5)
    return V.kept_counts(kept, views).where(F.bit_count(F.col("mask")) == 1).select(F.log2("mask").cast("int").alias("view_id"), F.col("n_pred").alias("n"))


# ---- matched evaluations --------------------------------------------------------------------------


def thresholded(fx, dets, caps=(1.0, 2.0)):
    """Match one detection table at several caps in one job."""
    refs = refs_by(fx, "cap", caps)
    d = T.with_params(dets, [{"cap": c} for c in caps])
    return refs, d, M.match(refs, d, max(caps), ["stand", "cap"], limit="cap")


@query("i34_matched_metrics", "cap:d n_ref:i n_pred:i tp:i p:d r:d f1:d")
def _(fx):
    kept = cut(merge(fx.fx_detections, "det_id", "n_pts", 1.5).select("stand", F.col("det_id").alias("did"), "x", "y"))
    refs, d, pairs = thresholded(fx, kept)
    g = M.match_counts(refs, d, pairs, ["stand", "cap"]).groupBy("cap").agg(*[F.sum(c).alias(c) for c in ("n_ref", "n_pred", "tp")])
    p, r, f = X.precision_recall_f1("tp", "n_pred", "n_ref")
    return g.select("*", p.alias("p"), r.alias("r"), f.alias("f1"))


# Fixed value: uniform draws behind the chance floor.
CHANCES = 15


@query("i35_chance_floor", "cap:d recall:d recall_chance:d chance_sd:d recall_margin:d precision:d precision_chance:d precision_margin:d f1:d f1_chance:d f1_margin:d")
def _(fx):
    """Detections against as many points spread evenly over each stand's stems, per cap."""
    kept = cut(merge(fx.fx_detections, "det_id", "n_pts", 1.5).select("stand", F.col("det_id").alias("did"), "x", "y"))
    box = fx.fx_trees.groupBy("stand").agg(*[f(c).alias(f"{p}{c}") for c in "xy" for p, f in (("lo_", F.min), ("hi_", F.max))])
    real = kept.withColumn("draw", F.lit(0))
    fake = kept.join(box, "stand").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(CHANCES))))
    fake = fake.withColumns({c: F.col(f"lo_{c}") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * uniform("did", "draw", i) for i, c in ((1, "x"), (2, "y"))}).select(*real.columns)
    d = T.with_params(real.unionByName(fake), [{"cap": c} for c in (1.0, 2.0)])
    refs = refs_by(fx, "cap", (1.0, 2.0)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(CHANCES))))
    c = M.match_counts(refs, d, M.match(refs, d, 2.0, ["stand", "cap", "draw"], limit="cap"), ["stand", "cap", "draw"])
    g = c.groupBy("cap", "draw").agg(*[F.sum(x).alias(x) for x in ("tp", "n_pred", "n_ref")])
    p, r, f1 = X.precision_recall_f1("tp", "n_pred", "n_ref")
    g = cut(g.select("cap", "draw", p.alias("precision"), r.alias("recall"), f1.alias("f1")))
    names = ("recall", "precision", "f1")
    own, chance = F.col("draw") == 0, F.col("draw") > 0
    out = g.groupBy("cap").agg(*[F.max(F.when(own, F.col(n))).alias(n) for n in names], *[F.avg(F.when(chance, F.col(n))).alias(f"{n}_chance") for n in names], F.stddev_pop(F.when(chance, F.col("recall"))).alias("chance_sd"))
    return out.withColumns({f"{n}_margin": F.col(n) - F.col(f"{n}_chance") for n in names})


@query("i36_confusion_rows", "subset:s tp:i fn:i fp:i dx:d dy:d")
def _(fx):
    refs, dets, pairs = view_pairs(fx)
    pairs = cut(pairs)
    near = S.grid_join(fx.fx_points.where("z between 1 and 8").select("stand", "x", "y"), fx.fx_trees.select("stand", "tree_id", F.col("x").alias("cx"), F.col("y").alias("cy")), 2.0)
    cover = cut(near.groupBy("tree_id").agg(F.count(F.lit(1)).alias("c")))  # read for the limit and for both subsets
    cut10 = exact_quantiles(cover, [], "c", {"q": 0.10}).scalar()
    good = cover.where(F.col("c") >= cut10).select(F.col("tree_id").alias("rid"))
    off = pairs.join(refs.select("rid", "view_id", "rx", "ry"), ["rid", "view_id"]).join(dets.select("did", "x", "y"), "did").withColumns({"ox": F.col("x") - F.col("rx"), "oy": F.col("y") - F.col("ry")})
    off = cut(off.select("rid", "ox", "oy"))
    n_pred = dets.agg(F.count(F.lit(1)).alias("n")).scalar()
    def row(name, r, o):
        a = o.agg(F.count(F.lit(1)).alias("tp")).withColumn("nr", r.agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn("np", n_pred)
        q = exact_quantiles(o, [], "ox", {"dx": 0.5}).withColumn("dy", exact_quantiles(o, [], "oy", {"dy": 0.5}).scalar())
        q = q.select(F.struct("dx", "dy").alias("q")).scalar()
        return a.withColumn("q", q).select(F.lit(name).alias("subset"), "tp", (F.col("nr") - F.col("tp")).alias("fn"), (F.col("np") - F.col("tp")).alias("fp"), "q.dx", "q.dy")
    return row("all", refs, off).unionByName(row("covered", refs.join(good, "rid", "left_semi"), off.join(good, "rid", "left_semi")))


@query("i38_paired_recall_bootstrap", "diff:d lo:d hi:d n:i")
def _(fx):
    _, _, pairs = view_pairs(fx)
    hit = pairs.where("view_id in (0, 1)").groupBy("rid").agg(F.count_if(F.col("view_id") == 0).alias("a"), F.count_if(F.col("view_id") == 1).alias("b"))
    o = cut(fx.fx_trees.select(F.col("tree_id").alias("rid")).join(hit, "rid", "left").na.fill(0, ["a", "b"]))
    b = cut(P.bootstrap_sums(o, "rid", 10_000, 4, ["a", "b"]).select(((F.col("b") - F.col("a")) / F.col("w")).alias("d")))  # drawn once for both limits
    q = exact_quantiles(b, [], "d", {"lo": 0.025, "hi": 0.975}).select(F.struct("lo", "hi").alias("q")).scalar()
    return o.agg(F.avg(F.col("b") - F.col("a")).alias("diff"), F.count(F.lit(1)).alias("n")).withColumn("q", q).select("diff", "q.lo", "q.hi", "n")


def counts_by(kept, fx, key):
    near = S.grid_join(kept.select("stand", key, "x", "y"), fx.fx_plots.select(*PLOTS), 12.0)
    return near.groupBy("plot", "stand", key).agg(F.count(F.lit(1)).alias("n"))


@query("i44_session_comparison", "stand:i strategy:s n:i abs_err:d wins:i")
def _(fx):
    d = fx.fx_detections.withColumn("tile_seq", F.col("view_id"))
    r = K.stand_radius(d, "det_id", fraction=0.4, side=8.0)
    plans = T.with_params(d.join(r, "stand"), [{"strategy": "global_1.5"}, {"strategy": "global_1.2"}, {"strategy": "adaptive"}])
    plans = plans.withColumn("radius", F.when(F.col("strategy") == "adaptive", F.col("radius")).when(F.col("strategy") == "global_1.2", 1.2).otherwise(1.5))
    kept = cut(plans.join(nms(plans, "det_id", "n_pts", "radius", ["stand", "strategy"]), ["stand", "strategy", "det_id"], "left_semi"))
    truth = S.grid_join(fx.fx_trees.select("stand", "x", "y"), fx.fx_plots.select(*PLOTS), 12.0).groupBy("plot").agg(F.count(F.lit(1)).alias("field"))
    e = cut(counts_by(kept, fx, "strategy").join(truth, "plot").withColumn("err", F.abs(F.col("n") - F.col("field")).cast("double")))
    best = e.groupBy("plot").agg(F.min_by("strategy", F.struct("err", "strategy")).alias("closest"))
    return e.join(best, "plot").groupBy("stand", "strategy").agg(F.sum("n").alias("n"), F.avg("err").alias("abs_err"), F.count_if(F.col("strategy") == F.col("closest")).alias("wins"))


@query("i51_view_pools", "pool:s n:i recall:d")
def _(fx):
    d = T.with_params(fx.fx_detections, [{"pool": "single", "most": 0}, {"pool": "overlap", "most": 4}, {"pool": "all", "most": 8}]).where("view_id <= most")
    kept = cut(d.join(nms(d, "det_id", "n_pts", 1.5, ["stand", "pool"]), ["stand", "pool", "det_id"], "left_semi"))
    refs = T.with_params(fx.fx_trees.select("stand", F.col("tree_id").alias("rid"), "x", "y"), [{"pool": p} for p in ("single", "overlap", "all")])
    h = A.hits(refs, kept.select("stand", "pool", F.col("det_id").alias("did"), "x", "y"), 1.5, ["stand", "pool"]).groupBy("pool").agg(F.avg(F.col("hit").cast("double")).alias("recall"))
    return kept.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).join(h, "pool")


@query("i52_macro_and_micro", "view_id:i macro_f1:d micro_f1:d tp:i")
def _(fx):
    refs, dets, pairs = view_pairs(fx)
    c = M.match_counts(refs, dets, pairs, ["stand", "view_id"]).withColumn("f1", X.precision_recall_f1("tp", "n_pred", "n_ref")[2])
    g = c.groupBy("view_id").agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("np"), F.sum("n_ref").alias("nr"))
    return g.withColumn("micro_f1", X.precision_recall_f1("tp", "np", "nr")[2])
