"""Assignments of returns, instances and controls to stems, plots and tiles."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from canopyframe.functions.scalars import circle_overlap, hyp
from canopyframe.operators.ranks import MAX_BUCKETS, _slices, exact_quantiles
from canopyframe.operators.spatial import cell, grid_join, nearest_within, offsets, spread
from canopyframe.session import cut


def in_zones(points: DataFrame, zones: DataFrame, radius: float, keys: Sequence[str] = ("stand",)) -> DataFrame:
    """Points in circles around zone centres ``cx, cy``; a point may fall in several."""
    return grid_join(points, zones, radius, keys)


def in_tiles(points: DataFrame, side: float, stride: float, keys: Sequence[str] = ("stand",)) -> DataFrame:
    """Every regular overlapping tile a point lies in, from arithmetic on its coordinates.

    Tile (i, j) covers ``[i * stride, i * stride + side)`` on both axes; no join is needed.
    """
    def span(c: str):
        last = F.floor(F.col(c) / stride).cast("bigint")
        first = F.greatest(F.lit(0), F.floor((F.col(c) - side) / stride).cast("bigint") + 1)
        return F.sequence(first, F.greatest(first, last))
    return points.withColumn("ti", F.explode(span("x"))).withColumn("tj", F.explode(span("y")))


def tile_counts(points: DataFrame, stride: float, least: int, keys: Sequence[str] = ("stand",)) -> DataFrame:
    """3 x 3 sums of stride-cell counts, tiles under ``least`` returns dropped."""
    ks = list(keys)
    cells = points.groupBy(*ks, cell("x", stride).alias("gx0"), cell("y", stride).alias("gy0")).agg(F.count(F.lit(1)).alias("c"))
    wide = spread(cells, F.col("gx0"), F.col("gy0"), 1)
    return (wide.groupBy(*ks, F.col("gx").alias("ti"), F.col("gy").alias("tj")).agg(F.sum("c").alias("n"))
            .where(F.col("n") >= least))


def voronoi(points: DataFrame, stems: DataFrame, radius: float = 2.5, keys: Sequence[str] = ("stand",),
            tid: str = "stem") -> DataFrame:
    """Each point with its nearest stem inside ``radius`` (points without one are left out).

    ``points`` must carry a unique ``row_id``.
    """
    best = nearest_within(points, stems, radius, ["row_id"], tid, keys)
    return points.join(best, [*keys, "row_id"])


def guided(points: DataFrame, stems: DataFrame, radius: float = 3.0, use_envelope: bool = False,
           keys: Sequence[str] = ("stand",), z_range: tuple[int, int] = (2, 45)) -> DataFrame:
    """Nearest leaning axis at the point's height (or distance over envelope radius).

    ``stems``: ``stem, cx, cy, ax, ay`` (lean per metre) and ``env``.  The axis is placed at the middle
    of each 1 m band, so stems x bands is a small table and the join is on (band, cell).
    """
    ks = list(keys)
    axis = stems.withColumn("band", F.explode(F.sequence(F.lit(z_range[0]).cast("bigint"), F.lit(z_range[1]).cast("bigint"))))
    mid = F.col("band") + 0.5
    axis = axis.select(*ks, "band", "stem", "env", (F.col("cx") + F.col("ax") * mid).alias("px"),
                       (F.col("cy") + F.col("ay") * mid).alias("py"))
    p = points.where((F.col("z") >= z_range[0]) & (F.col("z") < z_range[1] + 1)).withColumn("band", F.floor("z").cast("bigint"))
    pairs = grid_join(p, axis, radius, [*ks, "band"], ("x", "y"), ("px", "py"))
    d = F.sqrt("d2")
    score = d / F.greatest(F.col("env"), F.lit(0.15)) if use_envelope else d
    best = pairs.groupBy(*ks, "row_id").agg(F.min(F.struct(score.alias("s"), F.col("stem"))).alias("m"))
    return points.join(best.select(*ks, "row_id", F.col("m.stem").alias("stem"), F.col("m.s").alias("score")), [*ks, "row_id"])


def hits(refs: DataFrame, dets: DataFrame, radius: float = 1.5, keys: Sequence[str] = ("stand",),
         rid: str = "rid", did: str = "did") -> DataFrame:
    """Every reference with its nearest detection inside ``radius`` (null when none) and ``hit``."""
    r = refs.select(*keys, rid, "x", "y")
    best = nearest_within(r, dets.select(*keys, did, F.col("x").alias("cx"), F.col("y").alias("cy")), radius, [rid], did, keys)
    return r.join(best, [*keys, rid], "left").withColumn("hit", F.col(did).isNotNull())


def instance_vote(points: DataFrame, stems: DataFrame, radius: float = 1.2, z_lo: float = 2.0, z_hi: float = 12.0,
                  min_pts: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent instance around each stem's column, -1 when none; ties go to the smaller id.

    Stems that stand on the same spot have the same votes, so returns are counted once a spot and not once a stem.
    """
    ks = list(keys)
    p, s = (points, stems) if ks else (points.withColumn("__k", F.lit(0)), stems.withColumn("__k", F.lit(0)))
    ks = ks or ["__k"]
    # a stem that is listed more than once has the votes of all its spots
    places = cut(s.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct(*ks, "cx", "cy"))).alias("at")))
    spots = places.select("at").distinct().select("at", F.explode("at").alias("__s")).select("at", "__s.*")
    near = grid_join(cut(p.select(*ks, "inst", "x", "y", "z")), spots, radius, ks)
    band = F.col("z").between(z_lo, z_hi)
    votes = cut(near.groupBy("at", "inst").agg(F.count(F.lit(1)).alias("all"), F.count_if(band).alias("band")))
    tot = votes.groupBy("at").agg(F.sum("band").alias("__b"))
    v = votes.join(tot, "at").withColumn("v", F.when(F.col("__b") >= min_pts, F.col("band")).otherwise(F.col("all")))
    best = v.where("inst >= 0 and v > 0").groupBy("at").agg(F.max(F.struct("v", (-F.col("inst")).alias("n"))).alias("m"))
    return (stems.select("stem").join(places.join(best, "at").select("stem", "m"), "stem", "left")
            .select("stem", F.coalesce(-F.col("m.n"), F.lit(-1)).alias("inst")))


def shortlist(points: DataFrame, stems: DataFrame, radius: float, keys: Sequence[str]) -> DataFrame:
    """``stem, inst, votes, size, zmax, dist``: instances with returns around each stem, their size, height and distance from it.

    Returns are counted once for all stems of a spot.
    """
    spot = [*keys, "cx", "cy"]
    near = grid_join(points.select(*keys, "inst", "x", "y"), stems.select(*spot).distinct(), radius, keys)
    v = near.groupBy(*spot, "inst").agg(F.count(F.lit(1)).alias("__v"))
    i = points.groupBy("inst").agg(F.count(F.lit(1)).alias("size"), F.max("z").alias("zmax"), F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    v = cut(v.join(i, "inst").withColumn("dist", hyp(F.col("__mx") - F.col("cx"), F.col("__my") - F.col("cy"))))
    # stems are few beside what each is paired with: a fixed number of parts, which Spark doesn't put together again
    parts = int(stems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = stems.groupBy("stem", *spot).agg(F.count(F.lit(1)).alias("__times")).repartition(parts, "stem")
    return s.join(v, spot).select("stem", "inst", (F.col("__v") * F.col("__times")).alias("votes"), "size", "zmax", "dist")


def interpolate(rows: DataFrame, controls: DataFrame, key: str, at: str = "t", value: str = "v", least: int = 3) -> DataFrame:
    """Linear interpolation of each key's control points at ``rows[at]``: clamped, ``outside`` flagged.

    Keys with fewer than ``least`` controls are dropped.  The two as-of lookups run inside slices of
    the ordered values; what a slice cannot see comes from per-slice summaries.
    """
    enough = controls.groupBy(key).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") >= least).select(key)
    extra = [c for c in rows.columns if c not in (key, at)]
    none = F.lit(None)
    c = controls.join(enough, key, "left_semi").select(
        key, F.col(at).alias("__t"), F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("__p"),
        F.lit(None).cast(rows.select(F.struct(*extra) if extra else F.struct(F.lit(1))).schema[0].dataType).alias("__r"))
    r = rows.join(enough, key, "left_semi").select(
        key, F.col(at).alias("__t"), none.cast(c.schema["__p"].dataType).alias("__p"),
        (F.struct(*extra) if extra else F.struct(F.lit(1))).alias("__r"))
    binned, below, ks = _slices(c.unionByName(r), [key], "__t", None)
    ends = binned.groupBy(key, "__b").agg(F.max("__p").alias("__last"), F.min("__p").alias("__first"))
    over = W.partitionBy(key).orderBy("__b")
    ends = ends.select(key, "__b", F.max("__last").over(over.rowsBetween(W.unboundedPreceding, -1)).alias("__before"),
                       F.min("__first").over(over.rowsBetween(1, W.unboundedFollowing)).alias("__after"))
    inner = W.partitionBy(key, "__b").orderBy("__t")
    j = (binned.join(ends, [key, "__b"])
         .withColumn("lo", F.coalesce(F.max("__p").over(inner.rangeBetween(W.unboundedPreceding, 0)), "__before"))
         .withColumn("hi", F.coalesce(F.min("__p").over(inner.rangeBetween(0, W.unboundedFollowing)), "__after"))
         .where(F.col("__p").isNull()))
    t = F.col("__t")
    w = (t - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t"))
    mid = F.when(F.col("hi.t") > F.col("lo.t"), F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * w).otherwise(F.col("lo.v"))
    v = F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull(), F.col("lo.v")).otherwise(mid)
    return j.select(key, t.alias(at), *[F.col(f"__r.{c}").alias(c) for c in extra], v.alias("expected"),
                    (F.col("lo").isNull() | F.col("hi").isNull()).alias("outside"))


def disc_sums(positions: DataFrame, cells: DataFrame, radius: float, res: float, keys: Sequence[str] = ("stand",),
              pid: str = "pid", value: str = "v") -> DataFrame:
    """Sum of raster cells whose centre lies within ``radius`` of each position (zero when empty)."""
    ks = list(keys)
    c = cells.select(*ks, ((F.col("ix") + 0.5) * res).alias("__x"), ((F.col("iy") + 0.5) * res).alias("__y"), F.col(value).alias("__v"))
    near = grid_join(c, positions.select(*ks, pid, "x", "y"), radius, ks, ("__x", "__y"), ("x", "y"))
    s = near.groupBy(*ks, pid).agg(F.sum("__v").alias("total"))
    return positions.select(*ks, pid).join(s, [*ks, pid], "left").na.fill(0, ["total"])


def crown_overlap(plots: DataFrame, trees: DataFrame, reach: float, keys: Sequence[str] = ("stand",)) -> DataFrame:
    """Discrete and crown-weighted counts and basal areas per hectare of circular plots.

    ``plots``: ``plot, cx, cy, rp``; ``trees``: ``x, y, rc, basal``; ``reach`` bounds ``rp + rc``.
    """
    ks = list(keys)
    near = grid_join(trees, plots, reach, ks, limit=F.col("rp") + F.col("rc"))
    d = F.sqrt("d2")
    w = circle_overlap(d, "rc", "rp") / (F.pi() * F.col("rc") * F.col("rc"))
    ins = F.when(d <= F.col("rp"), 1.0).otherwise(0.0)
    ha = F.pi() * F.col("rp") * F.col("rp") / 10000.0
    got = near.groupBy(*ks, "plot").agg(F.sum(ins).alias("a"), F.sum(w).alias("b"), F.sum(ins * F.col("basal")).alias("c"),
                                        F.sum(w * F.col("basal")).alias("e"))
    j = plots.join(got, [*ks, "plot"], "left").na.fill(0.0, ["a", "b", "c", "e"])
    return j.select(*plots.columns, (F.col("a") / ha).alias("n_disc"), (F.col("b") / ha).alias("n_cont"),
                    (F.col("c") / ha).alias("g_disc"), (F.col("e") / ha).alias("g_cont"))


def stem_base(points: DataFrame, keys: Sequence[str], share: float = 0.10) -> DataFrame:
    """Mean position of the lowest ``share`` of each instance's returns, with its size."""
    ks = list(keys)
    q = exact_quantiles(points, ks, "z", {"__q": share})
    low = points.join(q, ks).where(F.col("z") <= F.col("__q")).groupBy(*ks).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return low.join(points.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_pts")), ks)


def claim_stems(bases: DataFrame, stems: DataFrame, radius: float = 2.0, keys: Sequence[str] = ("stand",),
                iid: str = "inst") -> DataFrame:
    """Each stem gets the largest instance whose base is nearest to it within ``radius``."""
    ks = list(keys)
    near = nearest_within(bases, stems, radius, [iid], "stem", ks)
    j = near.join(bases.select(*ks, iid, "n_pts"), [*ks, iid])
    best = j.groupBy(*ks, "stem").agg(F.max(F.struct("n_pts", (-F.col(iid)).alias("n"))).alias("m"))
    return best.select(*ks, "stem", (-F.col("m.n")).alias(iid), F.col("m.n_pts").alias("n_pts"))


def outside_all(points: DataFrame, centres: DataFrame, radius: float, keys: Sequence[str] = ("stand",),
                pid: str = "pid") -> DataFrame:
    """Points farther than ``radius`` from every centre."""
    near = grid_join(points.select(*keys, pid, "x", "y"), centres, radius, keys).select(*keys, pid).distinct()
    return points.join(near, [*keys, pid], "left_anti")
