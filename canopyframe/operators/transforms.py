"""Filters, thinning and coordinate transforms of point tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from canopyframe.functions.hashing import mix, normal
from canopyframe.operators.ranks import exact_quantiles, sorted_index
from canopyframe.session import cut


def with_params(df: DataFrame, rows: Sequence[Mapping[str, float]]) -> DataFrame:
    """Each row once per parameter set (an explode of literals, not a join)."""
    structs = [F.struct(*[(F.lit(v) if v is not None else F.lit(None).cast("double")).alias(k) for k, v in r.items()])
               for r in rows]
    out = df.withColumn("__p", F.explode(F.array(*structs)))
    return out.select(*df.columns, *[F.col(f"__p.{k}").alias(k) for k in rows[0]])


def in_height_window(z: str = "z", lo: float = 2.0, hi: float = 45.0) -> Column:
    return F.col(z).between(lo, hi)


def in_cylinder(x0: float, y0: float, radius: float) -> Column:
    dx, dy = F.col("x") - x0, F.col("y") - y0
    return dx * dx + dy * dy <= radius * radius


def in_square(cx: str | Column, cy: str | Column, half: float = 13.0) -> Column:
    cx = F.col(cx) if isinstance(cx, str) else cx
    cy = F.col(cy) if isinstance(cy, str) else cy
    return (F.abs(F.col("x") - cx) <= half) & (F.abs(F.col("y") - cy) <= half)


def in_angle_band(lo: Column | float, hi: Column | float, angle: str = "scan_angle") -> Column:
    a = F.abs(F.col(angle))
    return (a >= lo) & (a < hi)


def take_hashed(df: DataFrame, keys: Sequence[str], count: Column, seed: int, ident: Sequence[str],
                ties: Sequence[str] = ()) -> DataFrame:
    """Exactly ``least(count, n)`` rows per key, chosen by hash order; ``count`` may use ``n_rows``."""
    h = df.withColumn("__h", mix(*ident, seed))
    r = sorted_index(h, keys, "__h", "__i", ties).withColumnRenamed("__i_n", "n_rows")
    return r.where(F.col("__i") < count).drop("__h", "__i", "n_rows")


def degrade(points: DataFrame, conditions: Sequence[Mapping], area_m2: float, seed: int,
            keys: Sequence[str] = ("stand",), ident: Sequence[str] = ("pid",), ties: Sequence[str] = ()) -> DataFrame:
    """Angle limit first, then thinning to ``round(density * area)``; sparse clouds are never topped up."""
    d = with_params(points, conditions)
    d = d.where(F.col("angle_limit").isNull() | (F.abs(F.col("scan_angle")) <= F.col("angle_limit")))
    want = F.coalesce(F.round(F.col("density") * area_m2).cast("bigint"), F.col("n_rows"))
    return take_hashed(d, ["condition", *keys], want, seed, ident, ties)


def height_noise(points: DataFrame, sigma: float, seed: int, ident: Sequence[str]) -> DataFrame:
    return points.withColumn("z", F.col("z") + F.lit(sigma) * normal(*ident, seed))


def sample_fixed(points: DataFrame, keys: Sequence[str], n: int, seed: int, ident: Sequence[str],
                 order: str) -> DataFrame:
    """``n`` rows per key: without replacement when the key has that many, otherwise ``n`` draws.

    Adds ``draw``.  The draws of a small key pick a hashed position in its ``order``.
    """
    idx = sorted_index(points, keys, order, "__i")
    sizes = idx.select(*keys, "__i_n").distinct()
    many = take_hashed(idx.where(F.col("__i_n") >= n), keys, F.lit(n), seed, ident).withColumn("draw", F.lit(1))
    slots = (sizes.where(F.col("__i_n") < n).withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
             .withColumn("__i", mix("__slot", keys[0], seed) % F.col("__i_n")))
    picks = slots.groupBy(*keys, "__i").agg(F.count(F.lit(1)).alias("draw"))
    few = idx.join(picks, [*keys, "__i"])
    few = few.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("draw"))))
    cols = [*points.columns]
    return many.select(*cols).unionByName(few.select(*cols))


def centre_and_scale(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coordinates relative to the key's centroid divided by its largest 3-D distance from it."""
    ks = list(keys)
    mid = points.groupBy(*ks).agg(*[F.avg(c).alias(f"__m{c}") for c in "xyz"])
    moved = points.join(mid, ks).withColumns({c: F.col(c) - F.col(f"__m{c}") for c in "xyz"})
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in "yz"), F.col("x") * F.col("x")))
    top = moved.groupBy(*ks).agg(F.max(norm).alias("__r"))
    out = moved.join(top, ks)
    scale = F.when(F.col("__r") > 0, F.col("__r")).otherwise(F.lit(1.0))
    return out.withColumns({c: F.col(c) / scale for c in "xyz"}).select(*points.columns)


def stem_frame(points: DataFrame, centres: DataFrame, keys: Sequence[str], divisor: float = 10.0,
               angle: Column | None = None) -> DataFrame:
    """XY relative to the stem, z kept absolute, everything divided; optional rotation about z."""
    j = points.join(centres, list(keys))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    if angle is not None:
        dx, dy = F.cos(angle) * dx - F.sin(angle) * dy, F.sin(angle) * dx + F.cos(angle) * dy
    return j.withColumns({"x": dx / divisor, "y": dy / divisor, "z": F.col("z") / divisor}).select(*points.columns)


def split_by_height(points: DataFrame, keys: Sequence[str], fraction: float = 0.5) -> DataFrame:
    """``part``: trunk below ``fraction`` of the tree's height range, crown above."""
    rng = points.groupBy(*keys).agg(F.min("z").alias("__lo"), F.max("z").alias("__hi"))
    cutz = F.col("__lo") + F.lit(fraction) * (F.col("__hi") - F.col("__lo"))
    return (points.join(rng, list(keys))
            .withColumn("part", F.when(F.col("z") < cutz, "trunk").otherwise("crown")).drop("__lo", "__hi"))


def ground_level(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("semantic") == 0, F.col("z"))), F.min("z")).alias("z0"))


def centroid_distance(points: DataFrame, keys: Sequence[str], name: str = "rd") -> DataFrame:
    mid = points.groupBy(*keys).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    dx, dy = F.col("x") - F.col("__mx"), F.col("y") - F.col("__my")
    return points.join(mid, list(keys)).withColumn(name, F.sqrt(dx * dx + dy * dy)).drop("__mx", "__my")


def radial_filter(points: DataFrame, keys: Sequence[str], p: float = 0.8) -> DataFrame:
    # written once: means of another pass may be summed in another order, and the row at the limit would miss it
    d = cut(centroid_distance(points, keys, "__d"))
    lim = exact_quantiles(d, keys, "__d", {"__t": p})
    return d.join(lim, list(keys)).where(F.col("__d") <= F.col("__t")).drop("__d", "__t")


def envelope(train: DataFrame, features: Sequence[str]) -> DataFrame:
    return train.agg(*[F.min(c).alias(f"{c}_lo") for c in features], *[F.max(c).alias(f"{c}_hi") for c in features])


def flag_outside(rows: DataFrame, train: DataFrame, features: Sequence[str], name: str = "extrapolated") -> DataFrame:
    """True where any feature is missing or outside the training range (one-row scalar subquery)."""
    env = envelope(train, features)
    box = env.select(F.struct(*env.columns)).scalar()
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.col(c) < F.col("__e")[f"{c}_lo"]) | (F.col(c) > F.col("__e")[f"{c}_hi"])
    return rows.withColumn("__e", box).withColumn(name, bad).drop("__e")


def to_absolute(points: DataFrame, tiles: DataFrame, key: str = "tile") -> DataFrame:
    """Shift a tile's local coordinates by its own offset; two offsets (mean, corner) are compared.

    ``tiles`` holds the absolute returns.  ``shift_gap`` is the larger disagreement of the two.
    """
    def stats(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(key).agg(*[f(c).alias(f"{p}{n}{c}") for c in "xy" for n, f in (("a", F.avg), ("m", F.min))])
    s = stats(points, "l").join(stats(tiles, "g"), key)
    sx, sy = F.col("gax") - F.col("lax"), F.col("gay") - F.col("lay")
    gap = F.greatest(F.abs(sx - (F.col("gmx") - F.col("lmx"))), F.abs(sy - (F.col("gmy") - F.col("lmy"))))
    s = s.select(key, sx.alias("__sx"), sy.alias("__sy"), gap.alias("shift_gap"))
    return (points.join(s, key).withColumns({"x": F.col("x") + F.col("__sx"), "y": F.col("y") + F.col("__sy")})
            .drop("__sx", "__sy"))
