"""Sources and sinks."""
from pyspark.sql import functions as F

from canopyframe.operators import transforms as T
from canopyframe.operators.nms import merge
from canopyframe.operators.spatial import grid_join
from canopyframe.plans.registry import query
from canopyframe.sources import readers as R, sinks as S


@query("a01_canopy_scan", "stand:i n:i zmax:d",
       "SELECT stand, count(*) AS n, max(z) AS zmax FROM fx_points WHERE classification NOT IN (2, 18) GROUP BY stand")
def _(fx):
    return R.canopy_scan(fx.fx_points).groupBy("stand").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("zmax"))


@query("a02_panoptic_scan", "inst:i semantic:i n:i zmean:d", """
SELECT inst, coalesce(semantic, 2) AS semantic, count(*) AS n, avg(z) AS zmean
FROM fx_labelled WHERE inst >= 0 GROUP BY 1, 2""")
def _(fx):
    return (R.panoptic_scan(fx.fx_labelled).groupBy("inst", "semantic")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("zmean")))


@query("a03_scaled_volumes", "talhao:i n:i v_sum:d",
       "SELECT talhao, count(*) AS n, sum(v) AS v_sum FROM fx_volumes GROUP BY talhao")
def _(fx):
    return R.scaled_volumes(fx.fx_volumes).groupBy("talhao").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v_sum"))


NAMES = """SELECT CASE WHEN tree_id % 7 = 0 THEN 'base' || CAST(tree_id AS VARCHAR(12)) ELSE CAST(tree_id AS VARCHAR(12)) END AS name,
 x AS easting, y AS northing FROM {fx_trees}"""


@query("a04_surveyed_positions", "arv:i easting:d northing:d",
       "SELECT tree_id AS arv, x AS easting, y AS northing FROM fx_trees WHERE tree_id % 7 <> 0")
def _(fx):
    return R.surveyed_positions(fx.sql(NAMES))


@query("a05_delimited_sections", "tree_id:i h_m:d d_cm:d", "SELECT tree_id, h_m, d_cm FROM fx_sections")
def _(fx):
    path = S.scratch(fx.spark, "sections")
    (fx.fx_sections.select("tree_id", F.col("h_m").alias(" h_m "), F.col("d_cm").alias("d_cm "))
     .write.csv(path, sep=";", header=True))
    return R.read_delimited(fx.spark, path)


@query("a06_reconciled_plots", "plot_id:s hdom:d vol_ha:d", """
SELECT CAST(stand AS VARCHAR) || '_' || CAST(plot AS VARCHAR) AS plot_id, hdom, vol_ha FROM fx_panel""")
def _(fx):
    inventory = fx.sql("SELECT stand, plot, vol_ha + 0.25 AS vol_ha FROM {fx_panel}")
    return R.reconcile(fx.fx_panel, inventory, ["stand", "plot"], "vol_ha", 0.5)


@query("a07_census_counts", "plot:i n_live:i d_mean:d h_mean:d", """
SELECT plot, count(*) AS n_live, avg(d_cm) AS d_mean, avg(h_m) AS h_mean FROM fx_census
WHERE d_cm IS NOT NULL GROUP BY plot""")
def _(fx):
    counts = R.census_counts(fx.fx_census)
    R.check_counts(fx.fx_census, counts.select("plot", F.col("n_live").alias("n_arv")))
    return counts


@query("a08_name_parts", "tile:s stand:i plot:i view:i key:s", """
SELECT tile, CAST(substr(tile, 2, 4) AS INT) AS stand, CAST(split_part(tile, '_p', 2) AS INT) AS plot, 7 AS view,
 'FS_' || lpad(CAST(CAST(substr(tile, 2, 4) AS INT) AS VARCHAR), 3, '0') AS key FROM (SELECT DISTINCT tile FROM fx_labelled)""")
def _(fx):
    t = fx.fx_labelled.select("tile").distinct()
    stand, plot, view = R.tile_parts(F.concat("tile", F.lit("_v7")))
    return t.select("tile", stand.alias("stand"), plot.alias("plot"), view.alias("view"),
                    R.species_key(F.concat(F.lit("fs"), stand.cast("string"), F.lit("_scan"))).alias("key"))


@query("a09_spacing_text", "plot:i wide:d narrow:d n:i", """
SELECT plot, CASE WHEN espac LIKE '2,87%' THEN 2.87 ELSE 3.0 END AS wide,
 CASE WHEN espac LIKE '2,87%' THEN 1.88 ELSE 1.9 END AS narrow, count(*) AS n FROM fx_census GROUP BY 1, 2, 3""")
def _(fx):
    a, b = R.spacing_pair("espac")
    return fx.fx_census.select("plot", a.alias("wide"), b.alias("narrow")).groupBy("plot", "wide", "narrow").agg(
        F.count(F.lit(1)).alias("n"))


@query("a10_label_remap", "inst:i semantic:i n:i", """
WITH p AS (SELECT inst, semantic FROM fx_tree_pts WHERE pid % 5 <> 0 AND inst % 5 <> 0
           UNION ALL SELECT inst, semantic FROM fx_tree_pts WHERE pid % 40 = 1 AND inst % 5 = 0)
SELECT inst, semantic, count(*) AS n FROM p WHERE inst IN (SELECT inst FROM p GROUP BY inst HAVING count(*) >= 50)
GROUP BY 1, 2""")
def _(fx):
    src = fx.fx_tree_pts
    raw = src.where("inst % 5 <> 0").withColumn("label", F.when(F.col("pid") % 5 == 0, 0).otherwise(F.col("semantic") + 1))
    few = src.where("inst % 5 = 0").withColumn("label", F.when(F.col("pid") % 40 == 1, F.col("semantic") + 1).otherwise(0))
    return R.relabel(raw.unionByName(few)).groupBy("inst", "semantic").agg(F.count(F.lit(1)).alias("n"))


@query("a11_unit_conversion", "arv:i v:d", "SELECT arv, v * 5 / 1000 AS v FROM fx_volumes")
def _(fx):
    return R.litres_to_m3(fx.fx_volumes.withColumn("v", F.col("v") * 5), ["v"])


DISTIL = """SELECT tile, inst, min(x) AS base_x, min(y) AS base_y, avg(x) AS cent_x, avg(y) AS cent_y, max(z) AS z_max,
 count(*) AS n_pts FROM fx_labelled WHERE inst >= 0 GROUP BY tile, inst"""
DISTIL_COLS = "tile:s inst:i base_x:d base_y:d cent_x:d cent_y:d z_max:d n_pts:i"


@query("a12_distilled_instances", DISTIL_COLS, DISTIL)
def _(fx):
    return S.write_and_read(R.distil(fx.fx_labelled), "instances")


@query("a13_replay_safe_read", "n_all:i n_kept:i n_replayed:i", f"""
SELECT count(*) + sum(CASE WHEN inst % 3 = 0 THEN 1 ELSE 0 END) AS n_all, count(*) AS n_kept,
 sum(CASE WHEN inst % 3 = 0 THEN 1 ELSE 0 END) AS n_replayed FROM ({DISTIL})""")
def _(fx):
    d = R.distil(fx.fx_labelled)
    twice = S.write_and_read(d.unionByName(d.where("inst % 3 = 0")), "appended")
    kept = R.drop_replays(twice).agg(F.count(F.lit(1)).alias("n_kept"))
    return twice.agg(F.count(F.lit(1)).alias("n_all")).withColumn("n_kept", kept.scalar()).withColumn(
        "n_replayed", F.col("n_all") - F.col("n_kept"))


@query("a14_detection_extract", "stand:i n_read:i n_merged:i same:b")
def _(fx):
    cols = ["det_id", "stand", "view_id", "x", "y", "z_max", "n_pts"]
    src = fx.fx_detections.select(*cols)
    back = S.write_and_read(src, "detections")
    a, b = merge(src, "det_id", "n_pts", 1.5), merge(back, "det_id", "n_pts", 1.5)
    same = S.same_rows(a.select("det_id"), b.select("det_id"))
    n = back.groupBy("stand").agg(F.count(F.lit(1)).alias("n_read"))
    return n.join(b.groupBy("stand").agg(F.count(F.lit(1)).alias("n_merged")), "stand").withColumn("same", F.lit(same))


IN_PLOT = """SELECT p.plot, p.stand, q.* EXCLUDE (stand) FROM fx_plots p JOIN fx_points q ON p.stand = q.stand
 AND (q.x - p.cx) * (q.x - p.cx) + (q.y - p.cy) * (q.y - p.cy) <= 144"""


@query("a15_plot_point_cache", "plot:i n:i intensity:d red:d",
       f"SELECT plot, count(*) AS n, avg(intensity) AS intensity, avg(red) AS red FROM ({IN_PLOT}) GROUP BY plot")
def _(fx):
    pts = grid_join(fx.fx_points, fx.fx_plots.select("plot", "stand", "cx", "cy"), 12.0)
    cache = S.write_and_read(pts.drop("cx", "cy", "d2"), "plot_points", by=["plot"])
    return cache.groupBy("plot").agg(F.count(F.lit(1)).alias("n"), F.avg("intensity").alias("intensity"), F.avg("red").alias("red"))


@query("a16_map_polygons", "stand:i wkt:s n:i", """
WITH c AS (SELECT stand, floor(x / 20) * 20 AS x0, floor(y / 20) * 20 AS y0, count(*) AS n FROM fx_points GROUP BY 1, 2, 3)
SELECT stand, printf('POLYGON((%.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f))', x0, y0, x0 + 20, y0, x0 + 20, y0 + 20,
 x0, y0 + 20, x0, y0) AS wkt, n FROM c""")
def _(fx):
    c = (fx.fx_points.groupBy("stand", (F.floor(F.col("x") / 20) * 20).cast("double").alias("x0"),
                              (F.floor(F.col("y") / 20) * 20).cast("double").alias("y0"))
         .agg(F.count(F.lit(1)).alias("n")))
    return S.write_and_read(c.select("stand", S.square_wkt(F.col("x0"), F.col("y0"), 20.0).alias("wkt"), "n"), "map")


@query("a17_detection_export", "label:s stand:i z_max:d", """
SELECT printf('T%03d_%05d', stand, row_number() OVER (PARTITION BY stand ORDER BY det_id)) AS label, stand,
 round(z_max, 2) AS z_max FROM fx_detections""")
def _(fx):
    return S.write_and_read(S.detection_export(fx.fx_detections, "det_id").select("label", "stand", "z_max"), "export", fmt="csv")


@query("a18_latest_wins", "tile_seq:i stand:i event_id:i size:i", """
SELECT tile_seq, stand, event_id, size FROM (SELECT *, row_number() OVER (PARTITION BY stand, tile_seq ORDER BY event_id DESC) AS r
 FROM fx_tile_events) WHERE r = 1""")
def _(fx):
    return R.latest(fx.fx_tile_events.withColumn("load", F.col("event_id")), ["stand", "tile_seq"], "load")
