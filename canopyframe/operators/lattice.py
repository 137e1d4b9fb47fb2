"""Planting rows and lattices: periodicity, pose search, occupancy, spacing diagnostics.

Candidate poses are exploded literals; every score is one pre-aggregated sum per (key, pose).
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from canopyframe.functions.scalars import wrapped
from canopyframe.operators.ranks import exact_quantiles
from canopyframe.operators.spatial import grid_join
from canopyframe.operators.transforms import with_params
from canopyframe.session import cut


def _centre(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    m = points.groupBy(*keys).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    return points.join(m, list(keys)).withColumns({"px": F.col("x") - F.col("__mx"), "py": F.col("y") - F.col("__my")}).drop("__mx", "__my")


def rowness(points: DataFrame, keys: Sequence[str], spacing: float, degrees: Sequence[float], bins: int = 400) -> DataFrame:
    """Periodicity of the across-row coordinate at ``spacing`` for each azimuth: ``deg, score``."""
    ks = list(keys)
    p = with_params(_centre(points, ks).select(*ks, "px", "py"), [{"deg": float(d)} for d in degrees])
    t = F.radians("deg")
    p = p.withColumn("v", -F.col("px") * F.sin(t) + F.col("py") * F.cos(t))
    box = p.groupBy(*ks, "deg").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    h = p.join(box, [*ks, "deg"]).groupBy(*ks, "deg", "lo", "hi", b.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    mid = F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    w = 2 * math.pi / spacing
    s = h.groupBy(*ks, "deg").agg(F.sum(F.col("c") * F.cos(w * mid)).alias("cc"), F.sum(F.col("c") * F.sin(w * mid)).alias("ss"), F.sum("c").alias("n"))
    return s.select(*ks, "deg", (F.sqrt(F.col("cc") * F.col("cc") + F.col("ss") * F.col("ss")) / (F.col("n") + 1e-9)).alias("score"))


def best_azimuth(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Azimuth of the highest score and its contrast to the median score."""
    m = exact_quantiles(scores, keys, "score", {"med": 0.5})
    b = scores.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("deg")).alias("o"))).alias("m"))
    return b.join(m, list(keys)).select(*keys, (-F.col("m.o")).alias("deg"), F.col("m.score").alias("score"), (F.col("m.score") / (F.col("med") + 1e-9)).alias("contrast"))


def _node_gap(p: DataFrame, sx: float, sy: float) -> Column:
    t = F.col("theta")
    u = F.cos(t) * (F.col("x") - F.col("x0")) + F.sin(t) * (F.col("y") - F.col("y0"))
    v = -F.sin(t) * (F.col("x") - F.col("x0")) + F.cos(t) * (F.col("y") - F.col("y0"))
    du, dv = u - F.round(u / sx) * sx, v - F.round(v / sy) * sy
    return F.sqrt(du * du + dv * dv)


def fit_lattice(points: DataFrame, keys: Sequence[str], sx: float, sy: float, angles: int = 24, phases: int = 5) -> DataFrame:
    """Pose ``theta, x0, y0`` with the smallest mean capped distance to a node; coarse search, then one finer."""
    ks = list(keys)
    base = points.select(*ks, "x", "y")

    def best(df: DataFrame) -> DataFrame:
        c = df.groupBy(*ks, "theta", "x0", "y0").agg(F.avg(F.least(_node_gap(df, sx, sy), F.lit(0.6 * min(sx, sy)))).alias("cost"))
        return c.groupBy(*ks).agg(F.min(F.struct("cost", "theta", "x0", "y0")).alias("m")).select(*ks, "m.*")
    coarse = [{"theta": math.pi / 2 * i / angles, "x0": sx * j / phases, "y0": sy * k / phases} for i in range(angles) for j in range(phases) for k in range(phases)]
    first = cut(best(with_params(base, coarse)))
    steps = [{"dt": a * math.pi / 2 / angles / 4, "dx": b * sx / phases / 4, "dy": c * sy / phases / 4} for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3)]
    near = with_params(first.withColumnsRenamed({"theta": "t0", "x0": "a0", "y0": "b0"}).drop("cost"), steps)
    near = near.select(*ks, (F.col("t0") + F.col("dt")).alias("theta"), (F.col("a0") + F.col("dx")).alias("x0"), (F.col("b0") + F.col("dy")).alias("y0"))
    return best(base.join(near, ks))


def occupancy(points: DataFrame, pose: DataFrame, keys: Sequence[str], sx: float, sy: float) -> DataFrame:
    """Share of lattice nodes in the points' box with a point within half a spacing."""
    ks = list(keys)
    t = F.col("theta")
    q = points.join(pose, ks).select(*ks, (F.cos(t) * (F.col("x") - F.col("x0")) + F.sin(t) * (F.col("y") - F.col("y0"))).alias("u"),
                                     (-F.sin(t) * (F.col("x") - F.col("x0")) + F.cos(t) * (F.col("y") - F.col("y0"))).alias("v"))
    box = q.groupBy(*ks).agg(F.floor(F.min("u") / sx).alias("i0"), F.ceil(F.max("u") / sx).alias("i1"), F.floor(F.min("v") / sy).alias("j0"), F.ceil(F.max("v") / sy).alias("j1"))
    nodes = box.groupBy(*ks).agg(F.sum((F.col("i1") - F.col("i0") + 1) * (F.col("j1") - F.col("j0") + 1)).alias("nodes"))
    r = 0.5 * min(sx, sy)
    i, j = F.round(F.col("u") / sx), F.round(F.col("v") / sy)
    du, dv = F.col("u") - i * sx, F.col("v") - j * sy
    # half of the smaller spacing: a point can occupy only its own nearest node
    hit = q.where(du * du + dv * dv <= r * r).select(*ks, i.alias("i"), j.alias("j")).distinct().groupBy(*ks).agg(F.count(F.lit(1)).alias("hit"))
    return nodes.join(hit, ks, "left").na.fill(0, ["hit"]).withColumn("occupied", F.col("hit") / F.col("nodes"))


def lattice_residual(points: DataFrame, keys: Sequence[str], sx: float, sy: float, degrees: Sequence[float]) -> DataFrame:
    """Median wrapped residual at the circular-mean phase for each azimuth."""
    ks = [*keys, "deg"]
    p = with_params(_centre(points, keys).select(*keys, "px", "py"), [{"deg": float(d)} for d in degrees])
    t = F.radians("deg")
    p = p.withColumns({"u": F.col("px") * F.cos(t) + F.col("py") * F.sin(t), "v": -F.col("px") * F.sin(t) + F.col("py") * F.cos(t)})
    def phase(c: str, s: float) -> Column:
        a = 2 * math.pi * F.col(c) / s
        return F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))) * s / (2 * math.pi)
    ph = p.groupBy(*ks).agg(phase("u", sx).alias("pu"), phase("v", sy).alias("pv"))
    ru, rv = wrapped(F.col("u") - F.col("pu"), sx), wrapped(F.col("v") - F.col("pv"), sy)
    return exact_quantiles(p.join(ph, ks).withColumn("r", F.sqrt(ru * ru + rv * rv)), ks, "r", {"residual": 0.5})


def census_lattice(census: DataFrame, key: str, within: float, between: float, serpentine: bool = False) -> DataFrame:
    """Relative node positions of census rows (``linha``, ``arvore``), centred per plot."""
    from pyspark.sql import Window as W
    row = W.partitionBy(key, "linha")
    pos = F.row_number().over(row.orderBy("arvore")) - 1
    if serpentine:
        pos = F.when(F.col("linha") % 2 == 0, F.count(F.lit(1)).over(row) - 1 - pos).otherwise(pos)
    n = census.withColumns({"u": pos * within, "v": (F.col("linha") - 1) * between})
    m = n.groupBy(key).agg(F.avg("u").alias("__u"), F.avg("v").alias("__v"))
    return n.join(m, key).withColumns({"u": F.col("u") - F.col("__u"), "v": F.col("v") - F.col("__v")}).drop("__u", "__v")


def register(nodes: DataFrame, crowns: DataFrame, plots: DataFrame, poses: Sequence[dict], cap: float = 1.5) -> DataFrame:
    """Best pose ``theta, dx, dy`` of each plot's nodes against crowns of its stand, with the mean cost of all poses."""
    n = with_params(nodes.select("plot", "u", "v", "nid").join(plots.select("plot", "stand", "cx", "cy"), "plot"), poses)
    t = F.col("theta")
    n = n.withColumns({"qx": F.col("cx") + F.col("dx") + F.cos(t) * F.col("u") - F.sin(t) * F.col("v"), "qy": F.col("cy") + F.col("dy") + F.sin(t) * F.col("u") + F.cos(t) * F.col("v")})
    n = n.select("plot", "stand", "nid", "theta", "dx", "dy", "qx", "qy")
    near = grid_join(n, crowns.select("stand", F.col("x").alias("kx"), F.col("y").alias("ky")), cap, ["stand"], ("qx", "qy"), ("kx", "ky"))
    got = near.groupBy("plot", "nid", "theta", "dx", "dy").agg(F.sqrt(F.min("d2")).alias("d")).groupBy("plot", "theta", "dx", "dy").agg(F.sum(cap - F.col("d")).alias("gain"))
    got = cut(got)
    size = nodes.groupBy("plot").agg((F.count(F.lit(1)) * cap).alias("__all"))
    none = size.join(got.select("plot").distinct(), "plot", "left_anti").select("plot", F.lit(float(poses[0]["theta"])).alias("theta"), F.lit(float(poses[0]["dx"])).alias("dx"),
                                                                                  F.lit(float(poses[0]["dy"])).alias("dy"), F.lit(0.0).alias("gain"))
    cost = got.unionByName(none).join(size, "plot").withColumn("cost", F.col("__all") - F.col("gain"))
    return cost.groupBy("plot", "__all").agg(F.min(F.struct("cost", "theta", "dx", "dy")).alias("m"), F.sum("gain").alias("g")).select(
        "plot", "m.cost", "m.theta", "m.dx", "m.dy", (F.col("__all") - F.col("g") / len(poses)).alias("mean_cost"))
