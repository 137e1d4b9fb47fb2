"""Height, structure, colour and return metrics per plot, cell or crown."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from canopyframe.operators.ranks import exact_quantiles, sorted_index, top_fraction
from canopyframe.session import cut

EXTRA_PERCENTILES = (1, 5, 10, 15, 20, 30, 35, 40, 45, 55, 60, 65, 70, 80, 85, 99)  # fixed values


def with_means(df: DataFrame, keys: Sequence[str], **cols: str) -> DataFrame:
    m = df.groupBy(*keys).agg(*[F.avg(c).alias(n) for n, c in cols.items()])
    return df.join(m, list(keys))


def height_metrics(points: DataFrame, keys: Sequence[str], z: str = "z") -> DataFrame:
    """zmax, zmean, zsd (n-1), zq50, zq90, share above the mean; null below two returns."""
    ks = list(keys)
    points = cut(points.select(*ks, z))  # read three times below; its source may be a join
    base = points.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_pts"), F.max(z).alias("zmax"), F.avg(z).alias("zmean"), F.stddev_samp(z).alias("zsd"))
    q = exact_quantiles(points, ks, z, {"zq50": 0.5, "zq90": 0.9})
    above = (points.join(base.select(*ks, "zmean"), ks).groupBy(*ks)
             .agg((100.0 * F.avg((F.col(z) > F.col("zmean")).cast("double"))).alias("pzabovezmean")))
    j = base.join(q, ks).join(above, ks)
    ok = F.col("n_pts") >= 2
    names = ["zmax", "zmean", "zsd", "zq50", "zq90", "pzabovezmean"]
    return j.select(*ks, "n_pts", *[F.when(ok, F.col(c)).alias(c) for c in names])


def cell_metrics(points: DataFrame, side: float, keys: Sequence[str] = ("stand",), zmin: float = 2.0, zmax: float = 45.0,
                 least: int = 20) -> DataFrame:
    """Height metrics on a grid over the key's own extent; thin cells dropped."""
    ks = list(keys)
    p = points.where(F.col("z").between(zmin, zmax))
    org = p.groupBy(*ks).agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    p = (p.join(org, ks).withColumn("ix", F.floor((F.col("x") - F.col("__x")) / side).cast("bigint"))
         .withColumn("iy", F.floor((F.col("y") - F.col("__y")) / side).cast("bigint")))
    m = height_metrics(p.select(*ks, "ix", "iy", "z"), [*ks, "ix", "iy"]).where(F.col("n_pts") >= least)
    return (m.join(org, ks).withColumn("x0", F.col("__x") + F.col("ix") * side)
            .withColumn("y0", F.col("__y") + F.col("iy") * side).drop("__x", "__y"))


def split_finite(cells: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all features present, and a one-row count of the others."""
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    return cells.where(~bad), cells.agg(F.count_if(bad).alias("skipped"))


def _entropy(points: DataFrame, keys: list[str], z: str, bins: Column, lo: str, hi: str, n: str, name: str) -> DataFrame:
    b = F.least(bins - 1, F.floor((F.col(z) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins))
    h = points.where(F.col(hi) > F.col(lo)).groupBy(*keys, n, b.alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    p = F.col("__c") / F.col(n)
    return h.groupBy(*keys).agg((-F.sum(p * F.log(p))).alias(name))


def height_distribution(points: DataFrame, keys: Sequence[str], z: str = "z") -> DataFrame:
    """The full height-distribution suite; keys with fewer than four returns are dropped."""
    ks = list(keys)
    points = cut(points.select(*ks, z))
    base = points.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.min(z).alias("lo"), F.max(z).alias("hi"), F.avg(z).alias("mean")).where("n >= 4")
    probs = {f"zq{p}": p / 100 for p in EXTRA_PERCENTILES} | {"__q25": 0.25, "__q50": 0.5, "__q75": 0.75}
    q = exact_quantiles(points, ks, z, probs)
    p = points.select(*ks, F.col(z)).join(base, ks)
    ranked = sorted_index(p, ks, z, "i")
    i, n, v = F.col("i").cast("double"), F.col("n").cast("double"), F.col(z)
    edge = [F.col("lo") + (F.col("hi") - F.col("lo")) * k / 10.0 for k in range(1, 10)]
    w1, w2, w3 = i / (n - 1), i * (i - 1) / ((n - 1) * (n - 2)), i * (i - 1) * (i - 2) / ((n - 1) * (n - 2) * (n - 3))
    agg = ranked.groupBy(*ks).agg(
        *[(100.0 * F.avg((v <= e).cast("double"))).alias(f"zpcum{k}") for k, e in enumerate(edge, 1)],
        F.avg(v).alias("__b0"), (F.sum(w1 * v) / F.max(n)).alias("__b1"), (F.sum(w2 * v) / F.max(n)).alias("__b2"), (F.sum(w3 * v) / F.max(n)).alias("__b3"),
        F.avg(F.abs(v - F.col("mean"))).alias("zMADmean"), (100.0 * F.avg((v > F.col("mean")).cast("double"))).alias("pzabovemean"),
        (100.0 * F.avg((v > 2).cast("double"))).alias("pzabove2"), (100.0 * F.avg((v > 5).cast("double"))).alias("pzabove5"))
    mad = points.select(*ks, F.col(z)).join(q.select(*ks, "__q50"), ks).withColumn("__a", F.abs(F.col(z) - F.col("__q50")))
    mad = exact_quantiles(mad, ks, "__a", {"zMADmedian": 0.5})
    vci = _entropy(p, ks, z, F.lit(10), "lo", "hi", "n", "__vci")
    ent = _entropy(p, ks, z, F.greatest(F.lit(1), F.floor(F.sqrt(F.col("n")))), "lo", "hi", "n", "__ent")
    j = base.join(q, ks).join(agg, ks).join(mad, ks).join(vci, ks, "left").join(ent, ks, "left")
    b0, b1, b2, b3 = (F.col(f"__b{r}") for r in range(4))
    l2, l3, l4 = 2 * b1 - b0, 6 * b2 - 6 * b1 + b0, 20 * b3 - 30 * b2 + 12 * b1 - b0
    big = F.abs(l2) > 1e-10
    return j.select(
        *ks, *[F.col(f"zpcum{k}") for k in range(1, 10)], b0.alias("L1"), l2.alias("L2"), l3.alias("L3"), l4.alias("L4"),
        F.when(big, l3 / l2).otherwise(0.0).alias("Lskew"), F.when(big, l4 / l2).otherwise(0.0).alias("Lkurt"),
        F.when(F.abs(b0) > 1e-10, l2 / b0).otherwise(0.0).alias("Lcoefvar"),
        F.coalesce(F.col("__vci") / math.log(10), F.lit(0.0)).alias("VCI"),
        F.when(F.col("hi") > F.col("lo"), (F.col("mean") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("CRR"),
        (F.col("__q75") - F.col("__q25")).alias("ziqr"), "zMADmean", "zMADmedian", F.coalesce("__ent", F.lit(0.0)).alias("zentropy"),
        *[F.col(f"zq{p}") for p in EXTRA_PERCENTILES], "pzabovemean", "pzabove2", "pzabove5")


def voxel_metrics(points: DataFrame, keys: Sequence[str], side: float = 0.25) -> DataFrame:
    """Occupied-voxel metrics; null when a key has under four returns or a span below one voxel."""
    ks = list(keys)
    box = points.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n"), *[f(c).alias(f"{p}{c}") for c in "xyz" for p, f in (("__lo", F.min), ("__hi", F.max))])
    j = points.select(*ks, "x", "y", "z").join(box, ks)
    for c in "xyz":
        j = j.withColumn(f"v{c}", F.floor((F.col(c) - F.col(f"__lo{c}")) / side).cast("bigint"))
    vox = j.groupBy(*ks, "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("__c"))
    ok = (F.col("__n") >= 4)
    for c in "xyz":
        ok = ok & (F.col(f"__hi{c}") - F.col(f"__lo{c}") >= side)
    dims = {c: F.floor((F.col(f"__hi{c}") - F.col(f"__lo{c}")) / side) + 1 for c in "xyz"}
    layer = vox.groupBy(*ks, "vz").agg(F.count(F.lit(1)).alias("m"))
    # layers re-binned like a histogram of voxel base heights over their own range
    rng = layer.groupBy(*ks).agg(F.min("vz").alias("a"), F.max("vz").alias("b"), F.sum("m").alias("t"),
                                 (F.sum(F.col("m") * F.col("vz")) / F.sum("m")).alias("mu"))
    lb = layer.join(rng, ks).join(box.select(*ks, F.greatest(F.lit(1), F.floor((F.col("__hiz") - F.col("__loz")) / side)).alias("nb")), ks)
    hb = F.when(F.col("b") > F.col("a"), F.least(F.col("nb") - 1, F.floor((F.col("vz") - F.col("a")) / (F.col("b") - F.col("a")) * F.col("nb")))).otherwise(0)
    dev = F.col("vz") - F.col("mu")
    mom = lb.groupBy(*ks).agg((F.sum(F.col("m") * dev * dev) / F.max("t")).alias("m2"), (F.sum(F.col("m") * dev * dev * dev) / F.max("t")).alias("m3"))
    pb = lb.groupBy(*ks, hb.alias("hb")).agg((F.sum("m") / F.max("t")).alias("p"))
    ent = pb.groupBy(*ks).agg(F.when(F.count(F.lit(1)) > 1, -F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).otherwise(0.0).alias("ent"))
    cols = vox.groupBy(*ks, "vx", "vy").agg(F.sum(F.lit(1)).alias("k")).groupBy(*ks).agg(F.count(F.lit(1)).alias("ncol"), F.sum("k").alias("nv"))
    r = box.join(cols, ks).join(mom, ks).join(ent, ks)
    out = {"voxel_count": F.col("nv").cast("double"), "voxel_volume": F.col("nv") * side ** 3,
           "voxel_density": F.col("nv") / (dims["x"] * dims["y"] * dims["z"]), "voxel_h_entropy": F.col("ent"),
           "voxel_h_skewness": F.when((F.col("m2") > 0) & (F.col("nv") > 2), F.col("m3") / F.pow("m2", F.lit(1.5))).otherwise(0.0),
           "voxel_gap_fraction": 1 - F.col("ncol") / (dims["x"] * dims["y"])}
    return r.select(*ks, *[F.when(ok, v).alias(n) for n, v in out.items()])


def biomass_index(points: DataFrame, keys: Sequence[str], flight_height: float = 100.0, z0: Column | None = None) -> DataFrame:
    r = F.lit(flight_height) - (F.col("z") - (F.lit(0.0) if z0 is None else z0))
    g = points.groupBy(*keys).agg(F.count_if(r > 1.0).alias("__n"), F.sum(F.when(r > 1.0, 1.0 / (r * r))).alias("__s"))
    return g.select(*keys, F.when(F.col("__n") >= 3, F.round("__s", 6)).alias("lbi"))


def cover_metrics(points: DataFrame, keys: Sequence[str], height_break: float = 2.0, lower: float = 0.5) -> DataFrame:
    """Canopy cover, gap fraction and penetration ratio."""
    ks = list(keys)
    g = points.groupBy(*ks).agg(F.avg((F.col("z") > height_break).cast("double")).alias("cover"), F.min("z").alias("__lo"), F.max("z").alias("__hi"))
    thr = F.col("__lo") + F.lit(lower) * (F.col("__hi") - F.col("__lo"))
    p = points.join(g, ks).groupBy(*ks).agg(F.avg((F.col("z") <= thr).cast("double")).alias("__p"))
    return g.join(p, ks).select(*ks, "cover", (1 - F.col("cover")).alias("gap_fraction"),
                                F.when(F.col("__hi") > F.col("__lo"), F.col("__p")).otherwise(1.0).alias("penetration"))


def crown_block(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, height range, mean, sd (n), 99th percentile and twice the largest centroid distance."""
    ks = list(keys)
    b = points.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_points"), F.max("z").alias("H_max"), F.min("z").alias("H_min"), F.avg("z").alias("H_mean"),
                                F.stddev_pop("z").alias("H_std"), F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    d = F.sqrt((F.col("x") - F.col("__mx")) * (F.col("x") - F.col("__mx")) + (F.col("y") - F.col("__my")) * (F.col("y") - F.col("__my")))
    w = points.join(b.select(*ks, "__mx", "__my"), ks).groupBy(*ks).agg((2 * F.max(d)).alias("crown_diameter"))
    return b.join(exact_quantiles(points, ks, "z", {"z99": 0.99}), ks).join(w, ks).drop("__mx", "__my")


def shape_vector(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Six quantiles, skewness and kurtosis over the n-1 deviation, share above the mean."""
    ks = list(keys)
    m = points.groupBy(*ks).agg(F.avg("z").alias("__m"), F.coalesce(F.stddev_samp("z"), F.lit(1.0)).alias("__s"))
    m = m.withColumn("__s", F.when(F.col("__s") > 1e-6, F.col("__s")).otherwise(1.0))
    d = F.col("z") - F.col("__m")
    a = points.join(m, ks).groupBy(*ks, "__s").agg(F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"), (100.0 * F.avg((d > 0).cast("double"))).alias("pzabovezmean"))
    a = a.select(*ks, (F.col("m3") / F.pow("__s", F.lit(3))).alias("zskew"), (F.col("m4") / F.pow("__s", F.lit(4))).alias("zkurt"), "pzabovezmean")
    q = exact_quantiles(points, ks, "z", {f"zq{p}": p / 100 for p in (10, 25, 50, 75, 90, 95)})
    return q.join(a, ks)


def scaled_crown(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scale-free crown shape: relative quantiles, range, radius, log count, deviation."""
    ks = list(keys)
    b = points.groupBy(*ks).agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.count(F.lit(1)).alias("n"), F.stddev_pop("z").alias("sd"),
                                F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")))
    r = points.join(b.select(*ks, "mx", "my"), ks).groupBy(*ks).agg(F.max(d).alias("r"))
    q = exact_quantiles(points, ks, "z", {f"q{p}": p / 100 for p in (25, 50, 75, 95)})
    j = b.join(r, ks).join(q, ks)
    den = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return j.select(*ks, *[((F.col(f"q{p}") - F.col("lo")) / den).alias(f"q{p}") for p in (25, 50, 75, 95)],
                    ((F.col("hi") - F.col("lo")) / 10).alias("range10"), (F.col("r") / 5).alias("radius5"),
                    (F.log1p(F.col("n")) / 10).alias("logn10"), (F.col("sd") / 10).alias("sd10"))


def dominant_height(points: DataFrame, keys: Sequence[str], radius: float = 12.0, side: float = 4.0, share: float = 0.5,
                    zmin: float = 2.0, zmax: float = 45.0, least: int = 50) -> DataFrame:
    """Mean of the tallest ``share`` of cell maxima in the footprint; ``points`` carry ``cx, cy``."""
    ks = list(keys)
    p = points.where(F.col("z").between(zmin, zmax))
    ix = F.floor((F.col("x") - (F.col("cx") - radius)) / side)
    iy = F.floor((F.col("y") - (F.col("cy") - radius)) / side)
    cells = p.groupBy(*ks, ix.alias("ix"), iy.alias("iy")).agg(F.max("z").alias("v"), F.count(F.lit(1)).alias("c"))
    many = cells.groupBy(*ks).agg(F.sum("c").alias("n")).where(F.col("n") >= least).select(*ks)
    return top_fraction(cells.join(many, ks, "left_semi"), ks, "v", share).groupBy(*ks).agg(F.avg("v").alias("hdom"))


def return_metrics(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return structure and intensity over the 2-45 m window; needs 100 canopy returns."""
    ks = list(keys)
    dos = F.col("z").between(2.0, 45.0)
    rn, nr, it, solo = F.col("return_number"), F.col("number_of_returns"), F.col("intensity").cast("double"), F.col("classification") == 2
    def share(c):
        return F.avg(F.when(dos, c.cast("double")))
    a = points.groupBy(*ks).agg(
        F.count_if(dos).alias("n"), share(nr == 1).alias("single_pulse"), share(rn == 1).alias("first"), share(rn == nr).alias("last"),
        share((rn > 1) & (rn < nr)).alias("middle"), F.avg(F.when(dos, nr)).alias("returns_mean"), F.stddev_pop(F.when(dos, nr)).alias("returns_sd"),
        F.avg(solo.cast("double")).alias("ground_share"), F.avg(F.when(dos, it)).alias("int_mean"), F.stddev_pop(F.when(dos, it)).alias("int_sd"),
        F.count_if(solo).alias("__ns"), F.avg(F.when(solo, it)).alias("__is")).where("n >= 100")
    q = exact_quantiles(points.where(dos), ks, "intensity", {"int_q90": 0.9})
    return a.join(q, ks).select(
        "*", (F.col("last") / F.greatest("first", F.lit(1e-6))).alias("last_over_first"),
        F.when(F.col("__ns") > 50, F.col("int_mean") / F.greatest("__is", F.lit(1e-6))).alias("canopy_over_ground")).drop("__ns", "__is")


def colour_indices(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    r, g, b = (F.col(c).cast("double") for c in ("red", "green", "blue"))
    s = r + g + b
    vari = (g - r) / F.greatest(g + r - b, F.lit(1.0))
    vari = F.least(F.greatest(vari, F.lit(-2.0)), F.lit(2.0))
    exg = 2 * g / s - r / s - b / s
    return points.where(s > 0).groupBy(*keys).agg(
        F.avg(exg).alias("exg"), F.stddev_pop(exg).alias("exg_sd"), F.avg((2 * g - r - b) / F.greatest(2 * g + r + b, F.lit(1.0))).alias("gli"),
        F.avg(vari).alias("vari"), F.avg((g - r) / F.greatest(g + r, F.lit(1.0))).alias("ngrdi"), F.avg(g / s).alias("green_share"),
        F.avg(r / s).alias("red_share"), F.avg(s / 3).alias("brightness"), F.stddev_pop(s / 3).alias("brightness_sd"))


def canopy_image(points: DataFrame, keys: Sequence[str], radius: float = 12.0, size: int = 32, zmin: float = 2.0, zmax: float = 45.0) -> DataFrame:
    """Sparse image channels of a circular footprint: top height, log count, spread; ``points`` carry ``cx, cy``."""
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    p = points.where((dx * dx + dy * dy <= radius * radius) & F.col("z").between(zmin, zmax))
    def pix(d):
        return F.least(F.greatest(F.floor((d + radius) / (2 * radius) * size), F.lit(0)), F.lit(size - 1)).cast("bigint")
    g = p.groupBy(*keys, pix(dx).alias("px"), pix(dy).alias("py")).agg(
        F.least(F.max("z"), F.lit(zmax)).alias("top"), F.log1p(F.count(F.lit(1))).alias("density"), F.stddev_pop("z").alias("spread"))
    c = (size - 1) / 2.0
    return g.where((F.col("px") - c) * (F.col("px") - c) + (F.col("py") - c) * (F.col("py") - c) <= (size / 2.0) ** 2)
