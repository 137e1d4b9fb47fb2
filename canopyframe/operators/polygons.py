"""Planar polygon tests against edge tables ``(stand, ring, seq, x1, y1, x2, y2)``."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from canopyframe.session import cut

SHARE_ROWS = 20000


def inside(points: DataFrame, edges: DataFrame, keys: Sequence[str] = ("stand",), band: float = 2.0) -> DataFrame:
    """``points`` + ``inside`` by the even-odd rule.

    Edges are cut into horizontal bands, so a point meets only the edges crossing its own band; the
    crossings are counted before anything wide is built.
    """
    ks = list(keys)
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = (edges.where("y1 <> y2")
         .withColumn("__b", F.explode(F.sequence(F.floor(lo / band), F.floor(hi / band)))))
    e = e.select(*ks, "__b", "x1", "y1", "x2", "y2")
    p = points.withColumn("__b", F.floor(F.col("y") / band))
    per_band = e.groupBy(*ks, "__b").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("__es"))
    j = p.join(per_band, [*ks, "__b"], "left")
    n = F.size(F.filter("__es", lambda s: ((s.y1 > F.col("y")) != (s.y2 > F.col("y"))) & (
        F.col("x") < (s.x2 - s.x1) * (F.col("y") - s.y1) / (s.y2 - s.y1) + s.x1)))
    return j.withColumn("inside", F.coalesce(n % 2 == 1, F.lit(False))).select(*points.columns, "inside")


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    vx, vy = x2 - x1, y2 - y1
    len2 = vx * vx + vy * vy
    t = F.when(len2 > 0, ((px - x1) * vx + (py - y1) * vy) / len2).otherwise(F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    dx, dy = px - (x1 + t * vx), py - (y1 + t * vy)
    return F.sqrt(dx * dx + dy * dy)


def outlines(edges: DataFrame, keys: Sequence[str] = ("stand",)) -> DataFrame:
    """One row per polygon with its edges as an array (an outline is a mapped, bounded object)."""
    return edges.groupBy(*keys).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("__es"))


def boundary_distance(points: DataFrame, edges: DataFrame, keys: Sequence[str] = ("stand",)) -> DataFrame:
    """``points`` + ``edge_m``: distance to the polygon boundary, computed without a pair table."""
    j = points.join(outlines(edges, keys), list(keys))
    d = F.array_min(F.transform("__es", lambda s: segment_distance(F.col("x"), F.col("y"), s.x1, s.y1, s.x2, s.y2)))
    return j.withColumn("edge_m", d).drop("__es")


def area_and_perimeter(edges: DataFrame, keys: Sequence[str] = ("stand",)) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return edges.groupBy(*keys).agg(
        (F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("area_m2"),
        F.sum(F.sqrt(dx * dx + dy * dy)).alias("perimeter_m"))


def squares_touching(squares: DataFrame, edges: DataFrame, half: float, keys: Sequence[str] = ("stand",)) -> DataFrame:
    """Squares (centre ``x, y``) that share any point with the polygon.

    True when the centre is inside or some edge meets the square (clipping the edge to it).
    """
    def meets(s: Column) -> Column:
        def span(c, a, b):
            d = b - a
            lo, hi = c - half - a, c + half - a
            t0 = F.when(d != 0, F.least(lo / d, hi / d)).when((lo <= 0) & (hi >= 0), F.lit(-1e18)).otherwise(F.lit(1e18))
            t1 = F.when(d != 0, F.greatest(lo / d, hi / d)).when((lo <= 0) & (hi >= 0), F.lit(1e18)).otherwise(F.lit(-1e18))
            return t0, t1
        ax, bx = span(F.col("x"), s.x1, s.x2)
        ay, by = span(F.col("y"), s.y1, s.y2)
        return F.greatest(ax, ay, F.lit(0.0)) <= F.least(bx, by, F.lit(1.0))
    j = inside(squares, edges, keys).join(outlines(edges, keys), list(keys))
    return j.where(F.col("inside") | F.exists("__es", meets)).drop("__es", "inside")


def _chain(xy: np.ndarray) -> np.ndarray:
    """Convex hull vertices counter-clockwise; fewer than three when degenerate."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) >= 2 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                     - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]
    return np.array(half(pts) + half(pts[::-1]))


def by_shares(points: DataFrame, keys: Sequence[str], coords: Sequence[str], shrink: Callable, final: Callable, shape: str) -> DataFrame:
    """``final`` of each key's rows, which ``shrink`` has reduced share by share where a key has more than ``SHARE_ROWS`` of them.

    A key of ordinary size goes to ``final`` as it is; batches hold rows of many keys, so there is nothing to reduce in them.
    """
    ks = list(keys)
    src = points.select(*ks, *[F.col(c).cast("double") for c in coords])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields)
    shares = src.groupBy(*ks).agg(F.ceil(F.count(F.lit(1)) / SHARE_ROWS).alias("__shares"))
    large = cut(shares.where("__shares > 1"))
    if large.isEmpty():
        return src.groupBy(*ks).applyInPandas(final, shape)

    def reduced(k, g: pd.DataFrame) -> pd.DataFrame:
        return shrink(g)[[*ks, *coords]]
    parts = src.join(large, ks).withColumn("__share", F.pmod(F.xxhash64(*coords), "__shares")).drop("__shares")
    rest = parts.groupBy(*ks, "__share").applyInPandas(reduced, fields)
    return src.join(large, ks, "left_anti").unionByName(rest).groupBy(*ks).applyInPandas(final, shape)


def hull_vertices(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, x, y, seq`` of each key's convex hull.

    Shares of a large key shrink to their hulls first (a hull of hulls is the hull), so only hull vertices of it ever meet in one task.
    """
    ks = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in points.select(*ks).schema.fields}

    def hull(g: pd.DataFrame) -> pd.DataFrame:
        h = pd.DataFrame(_chain(g[["x", "y"]].to_numpy()), columns=["x", "y"])
        for name in ks:
            h[name] = g[name].iloc[0]
        return h

    def final(k, g: pd.DataFrame) -> pd.DataFrame:
        h = hull(g)
        h["seq"] = np.arange(len(h))
        return h[[*ks, "x", "y", "seq"]]
    return by_shares(points, ks, ["x", "y"], hull, final, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", x double, y double, seq int")


def hull_edges(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges between consecutive hull vertices, closing the ring."""
    ks = list(keys)
    n = vertices.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n"))
    nxt = vertices.select(*ks, F.col("seq").alias("__s"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    v = vertices.join(n, ks).withColumn("__s", ((F.col("seq") + 1) % F.col("__n")).cast("int"))
    return v.join(nxt, [*ks, "__s"]).select(*ks, F.lit(0).alias("ring"), "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def within_setback(points: DataFrame, hull: DataFrame, setback: float, keys: Sequence[str] = ("stand",)) -> DataFrame:
    """Points at least ``setback`` inside every side of a counter-clockwise convex outline."""
    def depth(s):
        vx, vy = s.x2 - s.x1, s.y2 - s.y1
        return (vx * (F.col("y") - s.y1) - vy * (F.col("x") - s.x1)) / F.sqrt(vx * vx + vy * vy)
    j = points.join(outlines(hull, keys), list(keys))
    return j.where(F.array_min(F.transform("__es", depth)) >= setback).drop("__es")
