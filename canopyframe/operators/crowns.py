"""Hulls, enclosing circles, channels and neighbourhood features of crowns."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from canopyframe.operators.metrics import height_metrics
from canopyframe.operators.polygons import by_shares, hull_edges, hull_vertices
from canopyframe.operators.ranks import exact_quantiles, sorted_index
from canopyframe.operators.spatial import grid_join, nn_distance, self_neighbours


def hull_area(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    e = hull_edges(hull_vertices(points, keys), keys)
    a = F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2
    return e.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), a.alias("__a")).select(*keys, F.when(F.col("__n") >= 3, F.col("__a")).alias("area"))


def _circle_of(p: np.ndarray) -> tuple[float, float, float] | None:
    if len(p) == 1:
        return p[0, 0], p[0, 1], 0.0
    if len(p) == 2:
        c = p.mean(axis=0)
        return c[0], c[1], float(np.hypot(*(p[0] - c)))
    m = 2.0 * (p[1:] - p[0])
    if abs(np.linalg.det(m)) < 1e-14:
        return None
    c = np.linalg.solve(m, (p[1:] ** 2).sum(axis=1) - (p[0] ** 2).sum())
    return c[0], c[1], float(np.hypot(*(p[0] - c)))


def enclosing_circle(xy: np.ndarray) -> tuple[float, float, float]:
    """Smallest circle around the points: add the farthest outsider to the support until none is left.

    The radius grows with every step, so the loop ends at the optimum.
    """
    xy = xy - (origin := xy.mean(axis=0))
    support = xy[[0]]
    circle = (support[0, 0], support[0, 1], 0.0)
    for _ in range(10 * len(xy) + 10):
        d = np.hypot(xy[:, 0] - circle[0], xy[:, 1] - circle[1])
        far = int(d.argmax())
        if d[far] <= circle[2] * (1 + 1e-12) + 1e-12:
            break
        cand = np.vstack([support, xy[far]])
        best = None
        for k in (2, 3):
            for pick in combinations(range(len(cand)), k):
                c = _circle_of(cand[list(pick)])
                if c is None:
                    continue
                if (np.hypot(cand[:, 0] - c[0], cand[:, 1] - c[1]) <= c[2] * (1 + 1e-10) + 1e-12).all() and (best is None or c[2] < best[0][2]):
                    best = (c, cand[list(pick)])
        circle, support = best
    else:
        raise ArithmeticError(f"no enclosing circle of {len(xy)} points found")
    return circle[0] + origin[0], circle[1] + origin[1], circle[2]


def enclosing_circles(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest enclosing circle per key, from the few vertices of its hull."""
    ks = list(keys)
    v = hull_vertices(points, ks)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.select(*ks).schema.fields)

    def one(k, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*k, *map(float, enclosing_circle(g[["x", "y"]].to_numpy())))], columns=[*ks, "cx", "cy", "r"])
    return v.groupBy(*ks).applyInPandas(one, fields + ", cx double, cy double, r double")


def hull3(p: np.ndarray) -> tuple[np.ndarray, float]:
    """Vertex positions and volume of the 3-D convex hull (beneath-and-beyond); volume NaN if flat."""
    p = np.asarray(p, float)
    none = np.arange(len(p)), float("nan")
    if len(p) < 4:
        return none
    scale = np.ptp(p, axis=0).max()
    eps = 1e-12 * max(scale, 1e-300)
    i0, i1 = int(p[:, 0].argmin()), int(p[:, 0].argmax())
    i1 = i1 if i1 != i0 else int(((p - p[i0]) ** 2).sum(1).argmax())
    u = p[i1] - p[i0]
    off = np.linalg.norm(np.cross(p - p[i0], u), axis=1)
    i2 = int(off.argmax())
    nrm = np.cross(u, p[i2] - p[i0])
    h = (p - p[i0]) @ nrm
    i3 = int(np.abs(h).argmax())
    if off[i2] <= eps * scale or abs(h[i3]) <= eps * scale * scale:
        return none
    mid = p[[i0, i1, i2, i3]].mean(axis=0)

    def plane(a, b, c):
        """Normals of triangles, outwards as their corners turn."""
        u, v = p[b] - p[a], p[c] - p[a]
        return np.stack([u[:, 1] * v[:, 2] - u[:, 2] * v[:, 1], u[:, 2] * v[:, 0] - u[:, 0] * v[:, 2], u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]], axis=1)
    faces = np.array(list(combinations((i0, i1, i2, i3), 3)))
    normals = plane(*faces.T)
    inward = np.einsum("ij,ij->i", normals, mid - p[faces[:, 0]]) > 0
    faces[inward] = faces[inward][:, [0, 2, 1]]
    normals[inward] *= -1
    level = np.einsum("ij,ij->i", normals, p[faces[:, 0]])
    slack = eps * np.linalg.norm(normals, axis=1)
    rest = np.arange(len(p))
    while len(rest):
        # the point farthest beyond one face comes next, those inside all faces are done with
        over = p[rest] @ normals.T - level
        out = (over > slack).any(axis=1)
        rest, over = rest[out], over[out]
        if not len(rest):
            break
        far = int((over / np.maximum(slack, 1e-300)).max(axis=1).argmax())
        i, seen = rest[far], over[far] > slack
        gone = faces[seen]
        edges = np.concatenate([gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]]])
        code = edges[:, 0] * len(p) + edges[:, 1]
        rim = edges[~np.isin(code, edges[:, 1] * len(p) + edges[:, 0])]
        new = np.column_stack([rim, np.full(len(rim), i)])
        nn = plane(*new.T)
        faces, normals = np.concatenate([faces[~seen], new]), np.concatenate([normals[~seen], nn])
        level = np.concatenate([level[~seen], np.einsum("ij,ij->i", nn, p[new[:, 0]])])
        slack = np.concatenate([slack[~seen], eps * np.linalg.norm(nn, axis=1)])
        rest = np.delete(rest, far)
    f = faces
    a, b, c = p[f[:, 0]] - mid, p[f[:, 1]] - mid, p[f[:, 2]] - mid
    return np.unique(f), float(np.abs(np.einsum("ij,ij->i", a, np.cross(b, c))).sum() / 6)


def hull_volumes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """3-D hull volume per key: of large keys from the hull vertices of their shares."""
    ks = list(keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*ks).schema.fields)

    def shrink(g: pd.DataFrame) -> pd.DataFrame:
        return g.iloc[hull3(g[["x", "y", "z"]].to_numpy())[0]]

    def volume(k, g: pd.DataFrame) -> pd.DataFrame:
        v = hull3(np.unique(g[["x", "y", "z"]].to_numpy(), axis=0))[1]
        return pd.DataFrame([(*k, None if np.isnan(v) else v)], columns=[*ks, "volume"])
    return by_shares(points, ks, ["x", "y", "z"], shrink, volume, kinds + ", volume double")


def channels(points: DataFrame, keys: Sequence[str], least: int = 40) -> DataFrame:
    """Intensity, return and colour channels per crown, with intensity of the top 20 % in height."""
    ks = list(keys)
    many = points.groupBy(*ks).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    p = points.join(many.select(*ks), ks, "left_semi")
    q = exact_quantiles(p, ks, "intensity", {"int_p10": 0.1, "int_p90": 0.9})
    z = exact_quantiles(p, ks, "z", {"__z80": 0.8})
    i, rn, nr = F.col("intensity").cast("double"), F.col("return_number"), F.col("number_of_returns")
    r, g, b = F.col("red"), F.col("green"), F.col("blue")
    s = r + g + b + 1e-9
    a = p.join(z, ks).groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n"), F.avg(i).alias("int_mean"), F.stddev_pop(i).alias("int_sd"), F.avg(F.when(F.col("z") > F.col("__z80"), i)).alias("int_top"),
        F.avg((rn == 1).cast("double")).alias("first"), F.avg((rn == nr).cast("double")).alias("last"), F.avg((nr == 1).cast("double")).alias("single"),
        F.avg(nr).alias("returns_mean"), F.avg((rn >= 3).cast("double")).alias("deep"), F.avg(g / s).alias("gcc"), F.avg(r / s).alias("rcc"), F.avg(2 * g - r - b).alias("exg"), F.avg(s).alias("bright"))
    return a.join(q, ks)


def crown_features(points: DataFrame, keys: Sequence[str], least: int = 40) -> DataFrame:
    """Vertical and geometric block per crown."""
    ks = list(keys)
    many = points.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_pts")).where(F.col("n_pts") >= least)
    p = points.join(many.select(*ks), ks, "left_semi")
    m = height_metrics(p, ks)
    mom = p.groupBy(*ks).agg(F.avg("z").alias("__m"), F.stddev_pop("z").alias("__s"), F.avg("x").alias("__x"), F.avg("y").alias("__y"))
    d = F.col("z") - F.col("__m")
    pd_ = p.join(mom, ks).withColumn("__d", F.sqrt((F.col("x") - F.col("__x")) * (F.col("x") - F.col("__x")) + (F.col("y") - F.col("__y")) * (F.col("y") - F.col("__y"))))
    sk = pd_.groupBy(*ks, "__s").agg(F.avg(d * d * d).alias("__m3")).select(*ks, (F.col("__m3") / (F.pow("__s", F.lit(3)) + 1e-9)).alias("zskew"))
    zq = exact_quantiles(p, ks, "z", {"zq5": 0.05, "zq10": 0.10, "zq25": 0.25, "zq75": 0.75, "zq95": 0.95, "zq99": 0.99})
    rq = exact_quantiles(pd_, ks, "__d", {"radius_med": 0.5, "radius_p90": 0.9})
    j = m.join(sk, ks).join(zq, ks).join(rq, ks).join(hull_area(p, ks), ks)
    depth = F.col("zmax") - F.col("zq5")
    return j.withColumns({"log_n": F.log("n_pts"), "depth": depth, "crown_vol": F.col("area") * depth,
                          "crown_dens": F.col("n_pts") / F.greatest("area", F.lit(1e-6)), "slender": depth / F.greatest("radius_p90", F.lit(1e-6))}).drop("zq5")


def competition(trees: DataFrame, pid: str, height: str, area: str, k: int = 6, radius: float = 5.0, side: float = 6.0,
                keys: Sequence[str] = ("stand",)) -> DataFrame:
    """Neighbour distance, relative size, neighbours in ``radius`` and the size-over-distance index."""
    ks = list(keys)
    size = trees.select(*ks, F.col(pid).alias("nb"), F.col(height).alias("__nh"), F.col(area).alias("__na"))
    own = trees.select(*ks, pid, F.col(height).alias("__h"), F.col(area).alias("__a"))
    nb = self_neighbours(trees, pid, k, side, ks).join(size, [*ks, "nb"]).join(own, [*ks, pid])
    near = nb.groupBy(*ks, pid).agg(F.min(F.sqrt("d2")).alias("d_nn1"), F.avg(F.sqrt("d2")).alias("d_nn_mean"), (F.first("__h") - F.avg("__nh")).alias("h_rel"),
                                    (F.first("__a") / F.greatest(F.avg("__na"), F.lit(1e-6))).alias("area_rel"))
    other = trees.select(*ks, F.col(pid).alias("nb"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col(area).alias("__na"))
    mine = trees.select(*ks, pid, F.col("x").alias("cx"), F.col("y").alias("cy"), F.col(area).alias("__a"))
    ring = grid_join(other, mine, radius, ks, ("nx", "ny")).where(F.col("nb") != F.col(pid))
    ring = ring.groupBy(*ks, pid).agg(F.count(F.lit(1)).alias("n_near"), F.sum(F.col("__na") / F.greatest("__a", F.lit(1e-6)) / F.greatest(F.sqrt("d2"), F.lit(0.3))).alias("hegyi"))
    return near.join(ring, [*ks, pid], "left").na.fill(0, ["n_near"]).na.fill(0.0, ["hegyi"])


def neighbour_blocks(trees: DataFrame, pid: str, values: Sequence[str], k: int = 6, side: float = 6.0, keys: Sequence[str] = ("stand",)) -> DataFrame:
    """Aggregated and flattened features of the ``k`` nearest neighbours."""
    ks = list(keys)
    size = trees.select(*ks, F.col(pid).alias("nb"), F.col("x").alias("__nx"), F.col("y").alias("__ny"), *[F.col(v).alias(f"__n_{v}") for v in values])
    nb = self_neighbours(trees, pid, k, side, ks).join(size, [*ks, "nb"]).join(trees.select(*ks, pid, "x", "y", *values), [*ks, pid])
    d = F.sqrt("d2")
    aggs = [F.min(d).alias("d_nn1"), F.avg(d).alias("d_mean"), F.stddev_pop(d).alias("d_sd")]
    for v in values:
        n, delta = F.col(f"__n_{v}"), F.col(f"__n_{v}") - F.col(v)
        aggs += [F.avg(n).alias(f"nb_mean_{v}"), F.max(n).alias(f"nb_max_{v}"), F.stddev_pop(n).alias(f"nb_sd_{v}"), F.avg(delta).alias(f"dif_mean_{v}"),
                 F.max(delta).alias(f"dif_max_{v}"), F.count_if(delta > 0).alias(f"n_larger_{v}")]
    for i in range(1, k + 1):
        at = F.col("rank") == i
        aggs += [F.max(F.when(at, d)).alias(f"v{i}_d"), F.max(F.when(at, F.col("__nx") - F.col("x"))).alias(f"v{i}_dx"), F.max(F.when(at, F.col("__ny") - F.col("y"))).alias(f"v{i}_dy")]
        aggs += [F.max(F.when(at, F.col(f"__n_{v}") - F.col(v))).alias(f"v{i}_dif_{v}") for v in values]
    return nb.groupBy(*ks, pid).agg(*aggs)


def relative_to_neighbours(trees: DataFrame, pid: str, values: Sequence[str], k: int = 6, side: float = 6.0, keys: Sequence[str] = ("stand",)) -> DataFrame:
    ks = list(keys)
    n = trees.select(*ks, F.col(pid).alias("nb"), *[F.col(v).alias(f"__n_{v}") for v in values])
    m = self_neighbours(trees, pid, k, side, ks).join(n, [*ks, "nb"]).groupBy(*ks, pid).agg(*[F.avg(f"__n_{v}").alias(f"__m_{v}") for v in values])
    return trees.join(m, [*ks, pid]).select(*ks, pid, *[(F.col(v) - F.col(f"__m_{v}")).alias(f"{v}_rel") for v in values])


def disposition(crowns: DataFrame, pid: str, keys: Sequence[str], plot_area_m2: float, side: float = 4.0) -> DataFrame:
    """Stand-level crown disposition of ``x, y, area, h``: count, mean, CV, Gini, packing, spacing."""
    ks = list(keys)
    r = sorted_index(crowns, ks, "area", "i", [pid])
    n = F.col("i_n")
    gini = F.sum((2 * (F.col("i") + 1) - n - 1) * F.col("area")) / (F.max(n) * F.sum("area"))
    ha = plot_area_m2 / 10000
    g = r.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / ha).alias("n_ha"), F.avg("area").alias("area_mean"), (F.stddev_pop("area") / F.avg("area")).alias("area_cv"),
                           gini.alias("area_gini"), (F.sum("area") / plot_area_m2).alias("packing"), F.avg("h").alias("h_mean"), F.max("h").alias("h_max")).where("n >= 2")
    nn = nn_distance(crowns.select(*ks, pid, "x", "y"), pid, side, ks).groupBy(*ks).agg(F.avg("nn").alias("nn_spacing"))
    return g.join(nn, ks)


def instance_position(points: DataFrame, keys: Sequence[str], base: bool, band: float = 3.0, least: int = 20) -> DataFrame:
    """Crown centroid, or the mean of non-ground returns within ``band`` of the lowest (if enough)."""
    ks = list(keys)
    solid = F.col("semantic") != 0
    s = points.groupBy(*ks).agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"), F.count_if(solid).alias("__n"), F.min(F.when(solid, F.col("z"))).alias("__z"))
    if not base:
        return s.select(*ks, F.col("__cx").alias("x"), F.col("__cy").alias("y"))
    low = solid & (F.col("z") <= F.col("__z") + band)
    b = points.join(s, ks).groupBy(*ks, "__cx", "__cy", "__n").agg(F.count_if(low).alias("__m"), F.avg(F.when(low, F.col("x"))).alias("__bx"), F.avg(F.when(low, F.col("y"))).alias("__by"))
    ok = (F.col("__n") >= least) & (F.col("__m") >= least)
    return b.select(*ks, F.when(ok, F.col("__bx")).otherwise(F.col("__cx")).alias("x"), F.when(ok, F.col("__by")).otherwise(F.col("__cy")).alias("y"))
