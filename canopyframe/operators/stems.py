"""Stem slices: coverage, circle and ellipse fits, radial modes and profiles.

Fits work on sums of products per slice (one aggregate), so a slice of any size is never gathered in
one task; only the few solved numbers per slice go through a small numeric helper where no closed
column form exists.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from canopyframe.functions.hashing import mix
from canopyframe.functions.scalars import circumcircle, hyp
from canopyframe.operators import resampling
from canopyframe.operators.poses import vectors_by_key
from canopyframe.operators.ranks import _slices, exact_quantiles, sorted_index
from canopyframe.operators.transforms import centroid_distance, radial_filter
from canopyframe.session import cut


def height_bins(points: DataFrame, keys: Sequence[str], width: float = 0.5) -> DataFrame:
    """``bin`` and ``h`` above the key's lowest ground (``z0``)."""
    return points.withColumn("h", F.col("z") - F.col("z0")).withColumn("bin", F.floor(F.col("h") / width).cast("bigint"))


def density_profile(points: DataFrame, keys: Sequence[str], width: float = 0.5, least: int = 10) -> DataFrame:
    b = height_bins(points, keys, width).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("viable", F.col("n") >= least)


def angular_coverage(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """360 less the widest gap between successive directions from the slice's centroid.

    Gaps inside a range slice use a window; gaps between slices use their end values.
    """
    ks = list(keys)
    mid = points.groupBy(*ks).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    a = points.join(mid, ks).select(*ks, F.degrees(F.atan2(F.col("y") - F.col("__my"), F.col("x") - F.col("__mx"))).alias("a"))
    binned, below, _ = _slices(a, ks, "a", None)
    inner = binned.withColumn("__g", F.lead("a").over(W.partitionBy(*ks, "__b").orderBy("a")) - F.col("a"))
    per = inner.groupBy(*ks, "__b").agg(F.max("__g").alias("g"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    per = per.withColumn("across", F.lead("lo").over(W.partitionBy(*ks).orderBy("__b")) - F.col("hi"))
    g = per.groupBy(*ks).agg(F.greatest(F.max("g"), F.max("across"), 360 - (F.max("hi") - F.min("lo"))).alias("gap"))
    return g.select(*ks, (360 - F.col("gap")).alias("coverage"))


def sector_coverage(points: DataFrame, keys: Sequence[str], width: float = 15.0) -> DataFrame:
    """Occupied sectors times their width, for points relative to the origin ``u, v``."""
    s = F.floor(F.degrees(F.atan2("v", "u")) / width)
    return points.select(*keys, s.alias("s")).distinct().groupBy(*keys).agg((F.count(F.lit(1)) * width).alias("coverage"))


def circle_kasa(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Algebraic circle (least squares of x^2 + y^2) per key from centred sums; adds rms residual."""
    ks = list(keys)
    mid = points.groupBy(*ks).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    u, v = F.col("x") - F.col("__mx"), F.col("y") - F.col("__my")
    w = u * u + v * v
    s = points.join(mid, ks).groupBy(*ks, "__mx", "__my").agg(
        F.count(F.lit(1)).alias("n"), F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u * w).alias("uw"), F.sum(v * w).alias("vw"))
    det = F.nullif(F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv"), F.lit(0.0)) * 2
    a = (F.col("uw") * F.col("vv") - F.col("vw") * F.col("uv")) / det
    b = (F.col("vw") * F.col("uu") - F.col("uw") * F.col("uv")) / det
    s = s.withColumns({"__a": a, "__b": b})
    r = F.sqrt(F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b") + (F.col("uu") + F.col("vv")) / F.col("n"))
    return s.select(*ks, "n", (F.col("__mx") + F.col("__a")).alias("cx"), (F.col("__my") + F.col("__b")).alias("cy"), r.alias("r"))


def circle_residual(points: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``rmse``, the circle test statistic (n - 3 by construction) and its degrees of freedom."""
    ks = list(keys)
    e = hyp(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r")
    s = points.join(fits.drop("n"), ks).groupBy(*ks, "cx", "cy", "r").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("__s"))
    ok = (F.col("n") >= 4) & (F.col("r") > 0)
    stat = F.when(ok & (F.col("n") > 3) & (F.col("__s") > 0), F.col("__s") / (F.col("__s") / (F.col("n") - 3)))
    return s.select(*ks, "n", "cx", "cy", "r", F.when(ok, F.sqrt(F.col("__s") / F.col("n"))).alias("rmse"), F.round(stat, 2).alias("chi2"), (F.col("n") - 3).alias("dof"))


def refine_circle(points: DataFrame, fits: DataFrame, keys: Sequence[str], steps: int = 3) -> DataFrame:
    """Gauss-Newton steps on the geometric distance; each step is one aggregate of normal equations."""
    ks = list(keys)
    f = fits.select(*ks, "cx", "cy", "r")
    for _ in range(steps):
        dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
        d = F.greatest(hyp(dx, dy), F.lit(1e-12))
        u, v, e = -dx / d, -dy / d, d - F.col("r")
        s = points.join(f, ks).groupBy(*ks, "cx", "cy", "r").agg(
            F.count(F.lit(1)).alias("n"), F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u).alias("su"), F.sum(v).alias("sv"),
            F.sum(u * e).alias("ue"), F.sum(v * e).alias("ve"), F.sum(e).alias("se"))
        # eliminate the radius (its column is -1), then solve the 2 x 2 system
        n = F.col("n")
        a, b, c = F.col("uu") - F.col("su") * F.col("su") / n, F.col("uv") - F.col("su") * F.col("sv") / n, F.col("vv") - F.col("sv") * F.col("sv") / n
        p, q = -F.col("ue") + F.col("su") * F.col("se") / n, -F.col("ve") + F.col("sv") * F.col("se") / n
        det = F.nullif(a * c - b * b, F.lit(0.0))
        s = s.withColumns({"__dx": F.coalesce((p * c - q * b) / det, F.lit(0.0)), "__dy": F.coalesce((q * a - p * b) / det, F.lit(0.0))})
        dr = (F.col("se") + F.col("su") * F.col("__dx") + F.col("sv") * F.col("__dy")) / n
        f = s.select(*ks, (F.col("cx") + F.col("__dx")).alias("cx"), (F.col("cy") + F.col("__dy")).alias("cy"), (F.col("r") + dr).alias("r"))
    return f


def circle_taubin(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Taubin circle from centred moments; Newton search of the smallest root as a column fold."""
    ks = list(keys)
    mid = points.groupBy(*ks).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    u, v = F.col("x") - F.col("__mx"), F.col("y") - F.col("__my")
    z = u * u + v * v
    m = points.join(mid, ks).groupBy(*ks, "__mx", "__my").agg(
        F.count(F.lit(1)).alias("n"), F.avg(u * u).alias("xx"), F.avg(v * v).alias("yy"), F.avg(u * v).alias("xy"), F.avg(u * z).alias("xz"), F.avg(v * z).alias("yz"), F.avg(z * z).alias("zz"))
    m = m.withColumn("z", F.col("xx") + F.col("yy")).withColumn("cov", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")).withColumn("vz", F.col("zz") - F.col("z") * F.col("z"))
    m = m.withColumns({"a3": 4 * F.col("z"), "a2": -3 * F.col("z") * F.col("z") - F.col("zz"), "a1": F.col("vz") * F.col("z") + 4 * F.col("cov") * F.col("z") - F.col("xz") * F.col("xz") - F.col("yz") * F.col("yz"),
                       "a0": F.col("xz") * (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) + F.col("yz") * (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) - F.col("vz") * F.col("cov")})
    def newton(x: Column, _: Column) -> Column:
        f = F.col("a0") + x * (F.col("a1") + x * (F.col("a2") + x * F.col("a3")))
        d = F.col("a1") + x * (2 * F.col("a2") + x * 3 * F.col("a3"))
        return F.when(F.abs(d) > 0, x - f / d).otherwise(x)
    m = m.withColumn("t", F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.lit(0.0), newton))
    det = F.nullif(F.col("t") * F.col("t") - F.col("t") * F.col("z") + F.col("cov"), F.lit(0.0)) * 2
    m = m.withColumns({"__a": (F.col("xz") * (F.col("yy") - F.col("t")) - F.col("yz") * F.col("xy")) / det, "__b": (F.col("yz") * (F.col("xx") - F.col("t")) - F.col("xz") * F.col("xy")) / det})
    return m.select(*ks, "n", (F.col("__mx") + F.col("__a")).alias("cx"), (F.col("__my") + F.col("__b")).alias("cy"), F.sqrt(F.col("__a") * F.col("__a") + F.col("__b") * F.col("__b") + F.col("z")).alias("r"))


SLICE_POINTS = 4096
_CANDIDATE = "draw int, cx double, cy double, r double, votes long"


def _circles(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Circles through the columns of three rows of points; NaN where they lie on a line."""
    px, py, qx, qy = x[1] - x[0], y[1] - y[0], x[2] - x[0], y[2] - y[0]
    det = 2.0 * (px * qy - py * qx)
    det = np.where(np.abs(det) >= 1e-12, det, np.nan)
    p2, q2 = px * px + py * py, qx * qx + qy * qy
    ux, uy = (qy * p2 - py * q2) / det, (px * q2 - qx * p2) / det
    return x[0] + ux, y[0] + uy, np.sqrt(ux * ux + uy * uy)


def _votes(cx: np.ndarray, cy: np.ndarray, r: np.ndarray, x: np.ndarray, y: np.ndarray, tol: float) -> np.ndarray:
    """Points within ``tol`` of each circle, some circles at a time."""
    step = max(1, (1 << 20) // max(1, len(x)))
    return np.concatenate([(np.abs(np.hypot(x - cx[i: i + step, None], y - cy[i: i + step, None]) - r[i: i + step, None]) < tol).sum(1) for i in range(0, len(cx), step)] or [np.zeros(0, dtype=np.int64)])


def _triples(n: int, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``(draw, three places)`` of all draws with different places."""
    draw = np.arange(1, draws + 1)
    at = np.stack([resampling.mix(draw, n, j, seed) % n for j in (1, 2, 3)])
    ok = (at[0] != at[1]) & (at[1] != at[2]) & (at[0] != at[2])
    return draw[ok], at[:, ok]


def best_circles(p: DataFrame, keys: Sequence[str], draws: int, tol: float, r_max: float, seed: int, slice_points: int = SLICE_POINTS) -> DataFrame:
    """``keys, votes, cx, cy, r``: the circle through three hashed points of ``p`` (keys, i, i_n, x, y) that most points lie on.

    A slice of up to ``slice_points`` points is one row, whose draws a task scores at once. Of a larger one the drawn points are joined, and its
    points are scored in chunks whose votes are added up, so no slice is held by one task.
    """
    ks = list(keys)
    kinds = dict(p.dtypes)
    key_shape = ", ".join(f"`{k}` {kinds[k]}" for k in ks)
    place = F.struct("i", "x", "y")
    packed = p.where((F.col("i_n") >= 3) & (F.col("i_n") <= slice_points)).groupBy(*ks).agg(F.array_sort(F.collect_list(place)).alias("p"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = b.column(len(ks)), []
            for s in lists:
                x, y = (s.values.field(c).to_numpy() for c in ("x", "y"))
                draw, at = _triples(len(x), draws, seed)
                cx, cy, r = _circles(x[at], y[at])
                good = np.flatnonzero(r <= r_max)
                v = _votes(cx[good], cy[good], r[good], x, y, tol)
                k = int(np.argmax(v)) if len(v) else -1  # the first of equals has the smallest draw
                out.append((int(draw[good[k]]), cx[good[k]], cy[good[k]], r[good[k]], int(v[k])) if k >= 0 and v[k] else (None,) * 5)
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[: len(ks)], *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64())))], [*ks, "draw", "cx", "cy", "r", "votes"])

    small = packed.mapInArrow(score, f"{key_shape}, {_CANDIDATE}").where("votes is not null").select(*ks, "votes", "cx", "cy", "r")
    big = p.where(F.col("i_n") > slice_points)
    n = big.groupBy(*ks).agg(F.max("i_n").alias("n")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    for j in (1, 2, 3):
        n = n.withColumn(f"i{j}", mix("draw", "n", j, seed) % F.col("n"))
    n = n.where("i1 <> i2 and i2 <> i3 and i1 <> i3")
    for j in (1, 2, 3):
        n = n.join(big.select(*ks, F.col("i").alias(f"i{j}"), F.col("x").alias(f"x{j}"), F.col("y").alias(f"y{j}")), [*ks, f"i{j}"])
    cx, cy, r = circumcircle("x1", "y1", "x2", "y2", "x3", "y3")
    circles = n.select(*ks, "draw", cx.alias("cx"), cy.alias("cy"), r.alias("r")).where(F.col("r") <= r_max).groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("draw", "cx", "cy", "r"))).alias("c"))
    chunks = big.groupBy(*ks, F.floor(F.col("i") / SLICE_POINTS).alias("chunk")).agg(F.collect_list(F.struct("x", "y")).alias("p"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = []
            for c, s in zip(b.column(len(ks)), b.column(len(ks) + 1)):
                votes.append(_votes(*(c.values.field(f).to_numpy() for f in ("cx", "cy", "r")), s.values.field("x").to_numpy(), s.values.field("y").to_numpy(), tol))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(ks)], b.column(len(ks)), pa.array(votes, pa.list_(pa.int64()))], [*ks, "c", "v"])

    circle = "array<struct<draw:int,cx:double,cy:double,r:double>>"
    scored = chunks.join(circles, ks).select(*ks, "c", "p").mapInArrow(count, f"{key_shape}, c {circle}, v array<long>")
    votes = scored.select(*ks, F.explode(F.arrays_zip("c", "v")).alias("z")).groupBy(*ks, "z.c").agg(F.sum("z.v").alias("votes")).where("votes > 0")
    large = votes.groupBy(*ks).agg(F.max(F.struct("votes", (-F.col("c.draw")).alias("o"), "c.cx", "c.cy", "c.r")).alias("m")).select(*ks, "m.votes", "m.cx", "m.cy", "m.r")
    return small.unionByName(large)


def circle_ransac(points: DataFrame, keys: Sequence[str], order: str, draws: int = 1000, tol: float = 0.02, r_max: float = 1.0,
                  share: float = 0.5, seed: int = 42, slice_points: int = SLICE_POINTS) -> DataFrame:
    """Best of ``draws`` circles through three hashed points by inlier count, refitted on its inliers.

    Falls back to all points when the best circle holds less than ``share`` of them.
    """
    ks = list(keys)
    p = cut(sorted_index(points.select(*ks, order, "x", "y"), ks, order, "i"))
    hit = F.abs(hyp(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r")) < tol
    j = p.join(cut(best_circles(p, ks, draws, tol, r_max, seed, slice_points)), ks, "left")
    ok = F.coalesce(F.col("votes") >= F.col("i_n") * share, F.lit(False))
    kept = cut(j.where(~ok | hit).select(*ks, "x", "y"))
    fit = circle_kasa(kept, ks)
    return refine_circle(kept, fit, ks).join(fit.select(*ks, F.col("n").alias("inliers")), ks)


def _conic(rows: pd.DataFrame) -> pd.DataFrame:
    """Ellipse centre and semi-axes from the 15 sums of products of (x^2, xy, y^2, x, y, 1)."""
    out = []
    idx = [(i, j) for i in range(6) for j in range(i, 6)]
    for row in rows[[f"s{i}{j}" for i, j in idx]].to_numpy(float):
        s = np.zeros((6, 6))
        for (i, j), v in zip(idx, row):
            s[i, j] = s[j, i] = v
        res = (np.nan,) * 4
        try:
            t = -np.linalg.solve(s[3:, 3:], s[:3, 3:].T)
            m = s[:3, :3] + s[:3, 3:] @ t
            m = np.array([m[2] / 2, -m[1], m[0] / 2])
            _, vec = np.linalg.eig(m)
            vec = vec.real
            k = np.flatnonzero(4 * vec[0] * vec[2] - vec[1] ** 2 > 0)
            if len(k):
                a, b, c = vec[:, k[0]]
                d, e, f = t @ vec[:, k[0]]
                den = 4 * a * c - b * b
                x0, y0 = (b * e - 2 * c * d) / den, (b * d - 2 * a * e) / den
                f0 = a * x0 * x0 + b * x0 * y0 + c * y0 * y0 - f
                lam = np.linalg.eigvalsh(np.array([[a, b / 2], [b / 2, c]]) / f0)
                if (lam > 0).all():
                    res = (x0, y0, 1 / math.sqrt(lam[0]), 1 / math.sqrt(lam[1]))
        except np.linalg.LinAlgError:
            pass
        out.append(res)
    return pd.DataFrame(out, columns=["ex", "ey", "a", "b"], index=rows.index)


def ellipse(points: DataFrame, keys: Sequence[str], limit: float = 2.0) -> DataFrame:
    """Direct least-squares ellipse per key; a circle where no plausible ellipse exists."""
    ks = list(keys)
    mid = points.groupBy(*ks).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"), F.greatest(F.stddev_pop("x"), F.stddev_pop("y"), F.lit(1e-9)).alias("__sc"))
    u, v = (F.col("x") - F.col("__mx")) / F.col("__sc"), (F.col("y") - F.col("__my")) / F.col("__sc")
    q = [u * u, u * v, v * v, u, v, F.lit(1.0)]
    sums = [F.sum(q[i] * q[j]).alias(f"s{i}{j}") for i in range(6) for j in range(i, 6)]
    s = points.join(mid, ks).groupBy(*ks, "__mx", "__my", "__sc").agg(*sums, F.count(F.lit(1)).alias("n"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select(*ks, "__mx", "__my", "__sc", "n").schema.fields)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[[*ks, "__mx", "__my", "__sc", "n"]], _conic(b)], axis=1)
    e = s.mapInPandas(fit, fields + ", ex double, ey double, a double, b double").join(circle_kasa(points, ks).drop("n"), ks)
    a, b = F.col("a") * F.col("__sc"), F.col("b") * F.col("__sc")
    ok = ~F.isnan("a") & (a <= limit) & (b <= limit)
    return e.select(*ks, "n", F.when(ok, F.col("__mx") + F.col("ex") * F.col("__sc")).otherwise(F.col("cx")).alias("cx"),
                    F.when(ok, F.col("__my") + F.col("ey") * F.col("__sc")).otherwise(F.col("cy")).alias("cy"),
                    F.when(ok, F.greatest(a, b)).otherwise(F.col("r")).alias("a"), F.when(ok, F.least(a, b)).otherwise(F.col("r")).alias("b"))


def _upper_gamma(dof: pd.Series) -> np.ndarray:
    """P(X > k) of a chi-squared X with k degrees of freedom, by the lower-gamma series."""
    out = []
    for k in dof:
        if not k or k != k or k < 1:
            out.append(np.nan)
            continue
        s = x = k / 2.0
        term = total = 1.0 / s
        n = s
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        out.append(1.0 - total * math.exp(-x + s * math.log(x) - math.lgamma(s)))
    return np.array(out)


def measure_slices(points: DataFrame, keys: Sequence[str], order: str, least: int = 10, coverage: float = 180.0, round_gap: float = 0.06,
                   d_max: float = 2.0, draws: int = 1000) -> DataFrame:
    """One measured diameter per slice passing the gates; round slices by circle, others by ellipse."""
    ks = list(keys)
    many = points.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(*ks)
    cov = angular_coverage(points.join(many, ks, "left_semi"), ks).where(F.col("coverage") >= coverage)
    cov = cut(cov)
    p = cut(points.join(cov, ks))
    gap = centroid_distance(p, ks, "__rd").groupBy(*ks).agg((F.max("__rd") - F.min("__rd")).alias("__gap"))
    circ = p.join(gap.where(F.col("__gap") <= round_gap).select(*ks), ks, "left_semi")
    ell = radial_filter(p.join(gap.where(F.col("__gap") > round_gap).select(*ks), ks, "left_semi"), ks)
    ell = cut(ell)
    ell = ell.join(ell.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(*ks), ks, "left_semi")
    a = circle_ransac(circ, ks, order, draws).select(*ks, "cx", "cy", "r", F.lit("circle").alias("fit"))
    b = ellipse(ell, ks).select(*ks, "cx", "cy", ((F.col("a") + F.col("b")) / 2).alias("r"), F.lit("ellipse").alias("fit"))
    fits = cut(a.unionByName(b).where(2 * F.col("r") <= d_max))
    used = circ.select(*ks, "x", "y").unionByName(ell.select(*ks, "x", "y"))
    res = circle_residual(used, fits.drop("fit"), ks)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in res.schema.fields)

    def pvalue(batches):
        for d in batches:
            yield d.assign(chi2_p=np.round(_upper_gamma(d["dof"]), 4))
    res = res.mapInPandas(pvalue, fields + ", chi2_p double")
    return (res.join(fits.select(*ks, "fit"), ks).join(cov, ks)
            .select(*ks, "fit", F.round(200 * F.col("r"), 1).alias("d_cm"), F.round(100 * F.col("rmse"), 2).alias("residual_cm"), F.col("n").alias("n_points"),
                    F.round("coverage", 1).alias("coverage"), "chi2_p", (F.col("chi2_p") > 0.05).alias("chi2_pass")))


def slice_candidates(points: DataFrame, keys: Sequence[str], widths: Sequence[float] = (0.5, 1.0), step: float = 0.5) -> DataFrame:
    """Points once per (bin, width) slice they fall in; wider slices extend evenly beyond their bin."""
    h = F.col("h")
    rows = []
    for w in widths:
        reach = int(math.ceil((w - step) / 2 / step))
        for k in range(-reach, reach + 1):
            rows.append(F.struct(F.lit(w).alias("width"), F.lit(k).alias("k")))
    p = points.withColumn("__c", F.explode(F.array(*rows))).withColumn("slice", (F.floor(h / step) + F.col("__c.k")).cast("bigint")).withColumn("width", F.col("__c.width"))
    pad = (F.col("width") - step) / 2
    ok = (F.col("slice") >= 0) & (h >= F.col("slice") * step - pad) & (h < (F.col("slice") + 1) * step + pad)
    return p.where(ok).drop("__c")


def section_points(points: DataFrame, tops: DataFrame, keys: Sequence[str], tol: float = 0.25) -> DataFrame:
    """Points within ``tol`` of each standard section height below the tree top."""
    ks = list(keys)
    fixed = F.array(*[F.lit(v) for v in (0.0, 0.1, 0.3, 0.7, 1.3)])  # fixed values, metres
    metres = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.ceil("total_h").cast("int"))), lambda i: i.cast("double"))
    s = tops.withColumn("section", F.explode(F.concat(fixed, metres))).where(F.col("section") < F.col("total_h"))
    # each height meets only the sections of its own metre and the two beside it
    s = s.withColumn("__m", F.explode(F.array(F.floor("section") - 1, F.floor("section"), F.floor("section") + 1)))
    p = points.withColumn("__m", F.floor("h"))
    return p.join(s.select(*ks, "section", "__m"), [*ks, "__m"]).where((F.col("h") >= F.col("section") - tol) & (F.col("h") < F.col("section") + tol)).drop("__m")


def radial_mode(points: DataFrame, keys: Sequence[str], width: float = 0.005, r_min: float = 0.03, r_max: float = 0.22) -> DataFrame:
    """Ring with the most points per area around the origin of ``u, v``: radius and inlier count."""
    ks = list(keys)
    d = hyp("u", "v")
    ring = points.where((d >= r_min) & (d < r_max)).withColumn("ring", F.floor(d / width))
    c = ring.groupBy(*ks, "ring").agg(F.count(F.lit(1)).alias("c"))
    # compared before they are scaled: one rounding keeps equal shares equal
    share = F.col("c") / (2 * F.col("ring") + 1)
    m = c.groupBy(*ks).agg(F.max(F.struct(share.alias("d"), (-F.col("ring")).alias("o"))).alias("m"))
    return m.select(*ks, ((0.5 - F.col("m.o")) * width).alias("r"), (F.col("m.d") / (F.pi() * width * width)).alias("density"))


def mode_radius(points: DataFrame, keys: Sequence[str], rounds: int = 4, tol: float = 0.015, least: int = 80, **kw) -> DataFrame:
    """Radial mode with the centre refined on the ring's points (radius held), ``rounds`` times."""
    ks = list(keys)
    centre = points.select(*ks).distinct().withColumns({"cu": F.lit(0.0), "cv": F.lit(0.0)})
    base = points.select(*ks, F.col("u").alias("__u"), F.col("v").alias("__v"))
    for _ in range(rounds):
        p = base.join(centre, ks).withColumns({"u": F.col("__u") - F.col("cu"), "v": F.col("__v") - F.col("cv")})
        r = radial_mode(p, ks, **kw).select(*ks, "r")
        d = F.greatest(hyp("u", "v"), F.lit(1e-12))
        on = p.join(r, ks).where(F.abs(d - F.col("r")) < tol)
        a, b, e = F.col("u") / d, F.col("v") / d, d - F.col("r")
        s = on.groupBy(*ks, "r", "cu", "cv").agg(F.count(F.lit(1)).alias("inliers"), F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.sum(a * e).alias("ae"), F.sum(b * e).alias("be"))
        det = F.nullif(F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"), F.lit(0.0))
        s = s.where(F.col("inliers") >= least)
        centre = s.select(*ks, (F.col("cu") + F.coalesce((F.col("ae") * F.col("bb") - F.col("be") * F.col("ab")) / det, F.lit(0.0))).alias("cu"),
                          (F.col("cv") + F.coalesce((F.col("be") * F.col("aa") - F.col("ae") * F.col("ab")) / det, F.lit(0.0))).alias("cv"), "r", "inliers")
        centre = cut(centre)
        if _ < rounds - 1:
            centre = centre.select(*ks, "cu", "cv")
    return centre


def principal_axis(points: DataFrame, keys: Sequence[str], lean: float = 25.0, rounds: int = 60) -> DataFrame:
    """Unit direction of largest spread per key by power iteration on six covariances; vertical if too inclined."""
    ks = list(keys)
    c = points.groupBy(*ks).agg(*[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])
    def step(v: Column, _: Column) -> Column:
        x = F.col("xx") * v.x + F.col("xy") * v.y + F.col("xz") * v.z
        y = F.col("xy") * v.x + F.col("yy") * v.y + F.col("yz") * v.z
        z = F.col("xz") * v.x + F.col("yz") * v.y + F.col("zz") * v.z
        n = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-300))
        return F.struct((x / n).alias("x"), (y / n).alias("y"), (z / n).alias("z"))
    start = F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(1.0).alias("z"))
    a = c.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    ok = F.abs(F.col("a.z")) > math.cos(math.radians(lean))
    s = F.signum(F.col("a.z"))
    return a.select(*ks, F.when(ok, s * F.col("a.x")).otherwise(0.0).alias("dx"), F.when(ok, s * F.col("a.y")).otherwise(0.0).alias("dy"), F.when(ok, s * F.col("a.z")).otherwise(1.0).alias("dz"))


def slice_agreement(points: DataFrame, keys: Sequence[str], slices: int = 6, least: int = 20, mad_max: float = 0.03, **kw) -> DataFrame:
    """Median of per-slice mode radii with their spread and the reason of any rejection."""
    ks = list(keys)
    box = points.groupBy(*ks).agg(F.min("h").alias("__lo"), F.max("h").alias("__hi"))
    p = points.join(box, ks).withColumn("slice", F.floor(F.try_divide(F.col("h") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * slices)).where(F.col("slice") < slices)
    n = p.groupBy(*ks, "slice").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    r = cut(radial_mode(p.join(n.select(*ks, "slice"), [*ks, "slice"], "left_semi"), [*ks, "slice"], **kw))
    med = exact_quantiles(r, ks, "r", {"r_med": 0.5})
    dev = r.join(med, ks).withColumn("__d", F.abs(F.col("r") - F.col("r_med")))
    out = exact_quantiles(dev, ks, "__d", {"mad": 0.5}).join(med, ks).join(r.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_slices")), ks)
    out = points.select(*ks).distinct().join(out, ks, "left")
    reason = F.when(F.coalesce("n_slices", F.lit(0)) < 2, "too few slices").when(F.col("mad") > mad_max, "slices disagree").otherwise("ok")
    return out.select(*ks, "n_slices", "r_med", "mad", reason.alias("reason"))


def kernel_profile(points: DataFrame, keys: Sequence[str], r_min: float = 0.03, r_max: float = 0.30, step: float = 0.002, h: float = 0.015) -> DataFrame:
    """Kernel density over radius divided by ring length, per key and grid radius (``u, v`` about the stem)."""
    n = int(round((r_max - r_min) / step))
    radii = r_min + np.arange(n) * step

    def part(d: pd.DataFrame) -> dict[str, np.ndarray]:
        return {"w": np.exp(-0.5 * ((d["d"].to_numpy()[:, None] - radii) / h) ** 2).sum(0)}

    r = F.lit(r_min) + F.col("i") * step
    return vectors_by_key(points.select(*keys, hyp("u", "v").alias("d")), keys, part, {"w": "sum"}).select(*keys, "i", r.alias("radius"), (F.col("w") / (2 * F.pi() * r)).alias("density"))


def profile_peak(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Radius of the highest density, null when it sits on the inner edge."""
    m = profile.groupBy(*keys).agg(F.max(F.struct("density", (-F.col("i")).alias("o"), "radius")).alias("m"))
    return m.select(*keys, F.when(F.col("m.o") < 0, F.col("m.radius")).alias("peak"), F.col("m.density").alias("density"))


def ring_profile(points: DataFrame, keys: Sequence[str], width: float, top: float, stems: str = "stem", scale: str | None = None) -> DataFrame:
    """Points per ring area and stem, by absolute radius or in units of the stem's own radius."""
    d = hyp("u", "v")
    d = d / F.col(scale) if scale else d
    n = points.groupBy(*keys).agg(F.count_distinct(stems).alias("n_stems"))
    c = points.withColumn("__d", d).where(F.col("__d") < top).groupBy(*keys, F.floor(F.col("__d") / width).alias("ring")).agg(F.count(F.lit(1)).alias("c"))
    area = F.pi() * width * width * (2 * F.col("ring") + 1)
    return c.join(n, list(keys)).select(*keys, "ring", ((F.col("ring") + 0.5) * width).alias("mid"), "c", (F.col("c") / (area * F.col("n_stems"))).alias("density"))


def ring_contrast(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Core, bark and background densities of a relative profile, their ratios and the bark share."""
    def zone(a, b):
        return F.avg(F.when((F.col("mid") >= a) & (F.col("mid") < b), F.col("density")))
    bark = F.sum(F.when((F.col("mid") >= 0.8) & (F.col("mid") < 1.2), F.col("c")).otherwise(0)) / F.sum("c")
    z = profile.groupBy(*keys).agg(zone(0.0, 0.3).alias("core"), zone(0.9, 1.1).alias("bark"), zone(2.5, 4.0).alias("background"), bark.alias("bark_share"))
    return z.withColumn("contrast", F.try_divide("bark", "core")).withColumn("bark_over_background", F.try_divide("bark", "background"))


def stem_evidence(points: DataFrame, keys: Sequence[str], radius: float = 0.6) -> DataFrame:
    """Count, distance quantiles, near shares and concentration against the uniform null."""
    ks = list(keys)
    d = points.withColumn("d", hyp("u", "v"))
    a = d.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("d").alias("d_sd"), F.avg((F.col("d") < 0.15).cast("double")).alias("near15"), F.avg((F.col("d") < 0.25).cast("double")).alias("near25"),
                           (F.avg((F.col("d") < 0.20).cast("double")) / (0.20 / radius) ** 2).alias("concentration")).where("n >= 5")
    return a.join(exact_quantiles(d, ks, "d", {"d_p10": 0.10, "d_p25": 0.25, "d_med": 0.5}), ks)


def ring_centre(points: DataFrame, keys: Sequence[str], radius: str, window: float, step: float = 0.02, tol: float = 0.02) -> DataFrame:
    """Offset with the most points within ``tol`` of the given radius (first offset on ties)."""
    ks = list(keys)
    k = int(round(window / step))
    du, dv = (np.round(x.ravel() * step, 10) for x in np.meshgrid(np.arange(-k, k + 1), np.arange(-k, k + 1), indexing="ij"))

    def part(d: pd.DataFrame) -> dict[str, np.ndarray]:
        u, v, r = (d[c].to_numpy()[:, None] for c in ("u", "v", "r"))
        return {"n": (np.abs(np.sqrt((u - du) * (u - du) + (v - dv) * (v - dv)) - r) < tol).sum(0).astype(float)}

    c = vectors_by_key(points.select(*ks, "u", "v", F.col(radius).alias("r")), ks, part, {"n": "sum"}).where("n > 0")
    m = c.groupBy(*ks).agg(F.max(F.struct("n", (-F.col("i")).alias("o"))).alias("m"))
    at = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), -F.col("m.o"))
    return m.select(*ks, at(du).alias("du"), at(dv).alias("dv"), F.col("m.n").cast("long").alias("n"))


def taper_walk(points: DataFrame, anchors: DataFrame, heights: Sequence[float], key: str = "stem", least: int = 40, inliers: int = 25,
               grow: float = 1.04, shrink: float = 0.90, misses: int = 3) -> DataFrame:
    """Radius ladder from the anchor at 1.3 m: centre by ring count, then limited radial mode.

    All stems advance together, one section height per round; a stem stops after ``misses`` in a row.
    ``points``: ``u, v, h`` about the stem; ``anchors``: the stem's ``r``.
    """
    state = anchors.select(key, F.col("r").alias("pr"), F.lit(1.3).alias("ph"), F.lit(0.0).alias("cu"), F.lit(0.0).alias("cv"), F.lit(0).alias("miss"))
    out = anchors.select(key, F.lit(1.3).alias("h_m"), "r")
    for h in heights:
        half = max(0.15, 0.10 + 0.012 * h)
        slab = points.where(F.abs(F.col("h") - h) <= half).join(state.where(F.col("miss") < misses), key)
        many = slab.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(key)
        slab = slab.join(many, key, "left_semi").withColumns({"u": F.col("u") - F.col("cu"), "v": F.col("v") - F.col("cv")})
        c = ring_centre(slab, [key], "pr", 0.12).where(F.col("n") >= inliers)
        jump = F.abs(F.lit(h) - F.col("ph"))
        s = slab.join(c.select(key, "du", "dv"), key).where(hyp("du", "dv") <= 0.10 + 0.15 * jump)
        s = s.withColumns({"u": F.col("u") - F.col("du"), "v": F.col("v") - F.col("dv")})
        d = hyp("u", "v")
        s = s.where((d >= F.greatest(F.lit(0.02), F.pow(F.lit(shrink), jump) * F.col("pr"))) & (d < F.least(F.lit(0.3), F.pow(F.lit(grow), jump) * F.col("pr")) + 0.005))
        r = radial_mode(s, [key], r_min=0.02, r_max=0.31)
        ok = s.join(r.select(key, "r"), key).where(F.abs(d - F.col("r")) < 0.02).groupBy(key, "r", "du", "dv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= inliers)
        state = cut(state.join(ok, key, "left").select(
            key, F.coalesce("r", "pr").alias("pr"), F.when(F.col("r").isNotNull(), F.lit(h)).otherwise(F.col("ph")).alias("ph"), (F.col("cu") + F.coalesce("du", F.lit(0.0))).alias("cu"),
            (F.col("cv") + F.coalesce("dv", F.lit(0.0))).alias("cv"), F.when(F.col("r").isNotNull(), 0).otherwise(F.col("miss") + 1).alias("miss")))
        out = out.unionByName(state.where(F.col("miss") == 0).select(key, F.lit(h).alias("h_m"), F.col("pr").alias("r")))
    return out


def axis_fit(sections: DataFrame, keys: Sequence[str], least: int = 4) -> DataFrame:
    """Least-squares line of ring centres ``cu, cv`` over height for stems with enough heights."""
    return sections.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_intercept("cu", "h_m").alias("a0x"), F.regr_slope("cu", "h_m").alias("a1x"),
                                       F.regr_intercept("cv", "h_m").alias("a0y"), F.regr_slope("cv", "h_m").alias("a1y")).where(F.col("n") >= least)


def envelope_radius(points: DataFrame, axes: DataFrame, key: str = "stem", least: int = 15, limit: float = 2.5) -> DataFrame:
    """90th percentile of the distance to the axis per 1 m band (``u, v, h`` about the stem base)."""
    p = points.join(axes, key).withColumn("band", F.floor("h"))
    mid = F.col("band") + 0.5
    d = hyp(F.col("u") - F.col("a0x") - F.col("a1x") * mid, F.col("v") - F.col("a0y") - F.col("a1y") * mid)
    # written once: axes of another pass may differ in their last digits, and rows at the limit with them
    p = cut(p.select(key, "band", d.alias("d"))).where(F.col("d") <= limit)
    n = p.groupBy(key, "band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return exact_quantiles(p, [key, "band"], "d", {"r90": 0.9}).join(n, [key, "band"])
