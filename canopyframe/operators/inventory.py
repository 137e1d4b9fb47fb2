"""Section volumes, taper, stand and plot totals."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from canopyframe.functions.scalars import form_factor_volume, huber, smalian, stem_biomass
from canopyframe.operators.ranks import exact_quantiles


def consecutive(sections: DataFrame, keys: Sequence[str], h: str = "h_m", d: str = "d_cm") -> DataFrame:
    """Each section with the next one of its tree (a stem has a few dozen sections at most)."""
    w = W.partitionBy(*keys).orderBy(h)
    return sections.withColumn("h2", F.lead(h).over(w)).withColumn("d2", F.lead(d).over(w))


def section_volumes(sections: DataFrame, keys: Sequence[str], h: str = "h_m", d: str = "d_cm") -> DataFrame:
    """Smalian and Huber totals; null below two sections."""
    s = consecutive(sections, keys, h, d)
    length = F.col("h2") - F.col(h)
    ok = length > 0
    return s.groupBy(*keys).agg(
        F.sum(F.when(ok, smalian(d, "d2", length))).alias("smalian_m3"), F.sum(F.when(ok, huber((F.col(d) + F.col("d2")) / 2, length))).alias("huber_m3"),
        F.count_if(ok).alias("n_sections"))


def reference_volumes(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tree volume from two crossed diameters ``d1, d2`` per section (pairs with a gap are skipped)."""
    s = consecutive(sections.withColumn("__d", (F.col("d1") + F.col("d2")) / 2).drop("d2"), keys, "h_m", "__d")
    length = F.col("h2") - F.col("h_m")
    return s.groupBy(*keys).agg(F.coalesce(F.round(F.sum(F.when(length > 0, smalian("__d", "d2", length))), 6), F.lit(0.0)).alias("volume_m3"), F.count(F.lit(1)).alias("n_sections"))


def diameter_at(sections: DataFrame, keys: Sequence[str], at: float, name: str) -> DataFrame:
    """Diameter at a height by linear interpolation, clamped to the measured range."""
    s = consecutive(sections, keys)
    t = F.lit(at)
    w = (t - F.col("h_m")) / (F.col("h2") - F.col("h_m"))
    mid = F.when((F.col("h_m") <= t) & (t < F.col("h2")), F.col("d_cm") + (F.col("d2") - F.col("d_cm")) * w)
    return s.groupBy(*keys).agg(F.coalesce(F.max(mid), F.when(F.min("h_m") > t, F.min_by("d_cm", "h_m")).otherwise(F.max_by("d_cm", "h_m"))).alias(name))


def relative_taper(sections: DataFrame, heights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``q = d / d(1.3)`` against ``hrel = h / H`` for trees taller than 2 m."""
    d13 = diameter_at(sections, keys, 1.3, "d13").where("d13 > 0")
    return (sections.join(d13, list(keys)).join(heights.where("total_h > 2"), list(keys))
            .withColumn("hrel", F.col("h_m") / F.col("total_h")).withColumn("q", F.col("d_cm") / F.col("d13")))


def taper_curve(rel: DataFrame, bins: int = 25) -> DataFrame:
    """Median relative diameter per height band, closed at (1, 0)."""
    b = F.least(F.greatest(F.floor(F.col("hrel") * bins), F.lit(0)), F.lit(bins - 1))
    q = exact_quantiles(rel.withColumn("bin", b), ["bin"], "q", {"q": 0.5})
    end = rel.sparkSession.range(1).select(F.lit(1.0).alias("hrel"), F.lit(0.0).alias("q"))
    return q.select(((F.col("bin") + 0.5) / bins).alias("hrel"), "q").unionByName(end)


def _curve_value(points: Column, x: Column) -> Column:
    """Value of a sorted array of (hrel, q) at ``x``, clamped."""
    lo = F.try_element_at(F.filter(points, lambda p: p.hrel <= x), F.lit(-1))
    hi = F.try_element_at(F.filter(points, lambda p: p.hrel > x), F.lit(1))
    mid = lo.q + (hi.q - lo.q) * (x - lo.hrel) / (hi.hrel - lo.hrel)
    return F.when(lo.isNull(), hi.q).when(hi.isNull(), lo.q).otherwise(mid)


def dense_curve(curve: DataFrame, bins: int) -> DataFrame:
    """One row ``knots``: the curve at every band centre, gaps interpolated, for constant-time lookup."""
    pts = curve.agg(F.sort_array(F.collect_list(F.struct("hrel", "q"))).alias("p"))
    return pts.select(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: _curve_value(F.col("p"), (j + 0.5) / bins)).alias("knots"))


def _lookup(knots: np.ndarray, x: np.ndarray) -> np.ndarray:
    bins = len(knots)
    at = x * bins - 0.5
    j = np.clip(np.floor(at).astype(np.int64), -1, bins - 1)
    lo, hi = knots[np.maximum(j, 0)], knots[np.minimum(j + 1, bins - 1)]
    last = np.fmax(knots[bins - 1] * (1 - x) / (0.5 / bins), 0.0)
    return np.where(j < 0, knots[0], np.where(j >= bins - 1, last, lo + (hi - lo) * (at - j)))


def _above(c: np.ndarray, step: float):
    """Volume of the form above the last section, stems of a batch step by step together."""

    @F.pandas_udf("double")
    def above(dn: pd.Series, hn: pd.Series, total: pd.Series) -> pd.Series:
        dn, hn, total = (v.to_numpy(dtype=float) for v in (dn, hn, total))
        q0, n = _lookup(c, hn / total), np.fmax(0, np.ceil((total - hn) / step) - 1)
        out = np.zeros(len(dn))
        on = np.flatnonzero((total > hn + step) & (n > 0) & (q0 > 0))

        def area(rows: np.ndarray, i: int) -> np.ndarray:
            r = dn[rows] / 200 * _lookup(c, (hn[rows] + i * step) / total[rows]) / q0[rows]
            return np.pi * r * r
        i, below = 0, area(on, 0)
        while len(on):
            above = area(on, i + 1)
            out[on] += (below + above) / 2 * step
            i += 1
            more = n[on] > i
            on, below = on[more], above[more]
        return pd.Series(out)
    return above


def stem_volume(sections: DataFrame, heights: DataFrame, curve: DataFrame, keys: Sequence[str], step: float = 0.25, bins: int = 25) -> DataFrame:
    """Measured sections (Smalian) + stump cylinder + form above the last section up to ``total_h``."""
    m = section_volumes(sections, keys)
    ends = sections.groupBy(*keys).agg(F.min_by("d_cm", "h_m").alias("d0"), F.min("h_m").alias("h0"), F.max_by("d_cm", "h_m").alias("dn"), F.max("h_m").alias("hn"))
    knots = np.array(dense_curve(curve, bins).first().knots, dtype=float)  # one number a band
    t = ends.join(heights, list(keys)).withColumn("above_m3", _above(knots, step)("dn", "hn", "total_h"))
    stump = F.pi() * (F.col("d0") / 200) * (F.col("d0") / 200) * F.col("h0")
    top = t.select(*keys, "above_m3", stump.alias("stump_m3"))
    return m.join(top, list(keys)).withColumn("total_m3", F.coalesce("smalian_m3", F.lit(0.0)) + F.col("stump_m3") + F.col("above_m3"))


def isotonic(sections: DataFrame, keys: Sequence[str], h: str = "h_m", r: str = "r") -> DataFrame:
    """Non-increasing fit of ``r`` over height by the min-max formula.

    value(k) = min over i <= k of max over j >= k of mean(i..j), with means from running sums; a stem has
    at most a few dozen sections, so its profile is one small array.
    """
    prof = sections.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(h, r))).alias("__a"))
    c = F.aggregate("__a", F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s[r])))
    prof = prof.withColumn("__c", c).withColumn("__n", F.size("__a"))
    def mean(i: Column, j: Column) -> Column:
        return (F.get("__c", j + 1) - F.get("__c", i)) / (j - i + 1)
    prof = prof.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    inner = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.array_max(F.transform(F.sequence(F.col("k"), F.col("__n") - 1), lambda j: mean(i, j))))
    return prof.select(*keys, F.get("__a", F.col("k"))[h].alias(h), F.array_min(inner).alias(f"{r}_iso"))


TAPER_A, TAPER_B = (0.2, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0), (0.2, 0.4, 0.6, 0.8, 1.0, 1.4, 2.0, 3.0)
TAPER_FACTORS = (0.8, 0.9, 1.0, 1.1, 1.25)


def _taper_search(keys: int, steps: int):
    """Least squares of each stem (``keys, dbh, total_h, h, d``) over the grid, then around its best pair (of equal sums the smaller pair), and the volume of that form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            h, d = t.column(keys + 2), t.column(keys + 3)
            dbh, total = (t.column(keys + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts = np.asarray(h.offsets)
            stem = np.repeat(np.arange(len(dbh)), np.diff(starts))
            z, p, size = h.flatten().to_numpy() / total[stem], 1.3 / total, d.flatten().to_numpy() / 100
            starts = starts[:-1] - starts[0]
            sse, best_a, best_b = np.full(len(dbh), np.inf), np.full(len(dbh), np.inf), np.full(len(dbh), np.inf)

            def attempt(a: np.ndarray | float, bs: list) -> None:
                """Pairs of one ``a`` (a number, or one a stem) with each of ``bs``."""
                with np.errstate(invalid="ignore", divide="ignore"):
                    ratio = np.maximum((1 - z ** (a if np.isscalar(a) else a[stem])) / (1 - p ** a)[stem], 0.0)
                    for b in bs:
                        e = dbh[stem] * ratio ** (b if np.isscalar(b) else b[stem]) - size
                        s = np.add.reduceat(e * e, starts) if len(starts) else np.zeros(0)
                        s[np.isnan(s)] = np.inf
                        less = (s < sse) | ((s == sse) & ((a < best_a) | ((a == best_a) & (b < best_b))))
                        sse[less] = s[less]
                        best_a[less] = a if np.isscalar(a) else a[less]
                        best_b[less] = b if np.isscalar(b) else b[less]
            for a in TAPER_A:
                attempt(a, list(TAPER_B))
            a0, b0 = best_a.copy(), best_b.copy()
            sse[:], best_a[:], best_b[:] = np.inf, np.inf, np.inf
            for f in TAPER_FACTORS:
                attempt(np.clip(a0 * f, 0.01, 10.0), [np.clip(b0 * g, 0.01, 10.0) for g in TAPER_FACTORS])
            def area(i: int) -> np.ndarray:
                r = np.maximum((1 - (i / (steps - 1)) ** best_a) / (1 - p ** best_a), 0.0)
                size = dbh * r ** best_b
                return np.pi / 4 * size * size
            volume, below = np.zeros(len(dbh)), area(0)
            for i in range(1, steps):
                above = area(i)
                volume, below = volume + (below + above) / 2, above
            volume = volume * total / (steps - 1)
            yield pa.RecordBatch.from_arrays([*t.columns[:keys], pa.array(best_a), pa.array(best_b), pa.array(np.where(np.isinf(sse), np.nan, sse)), pa.array(volume)],
                                             [*t.schema.names[:keys], "a", "b", "sse", "taper_m3"])
    return run


def taper_fit(sections: DataFrame, heights: DataFrame, keys: Sequence[str], steps: int = 100) -> DataFrame:
    """Two-parameter taper ``d13 * ((1 - z^a) / (1 - p^a))^b`` by grid search with one refinement, integrated."""
    ks = list(keys)
    # breast diameter = section nearest to 1.3 m
    near = sections.groupBy(*ks).agg(F.min(F.struct(F.abs(F.col("h_m") - 1.3), F.col("d_cm").alias("d"))).alias("m"), F.count(F.lit(1)).alias("n"))
    near = near.where("n >= 3").select(*ks, (F.col("m.d") / 100).alias("dbh"))
    base = sections.where("h_m is not null and d_cm is not null").join(near.where("dbh > 0"), ks).join(heights.where("total_h > 1.3"), ks)
    # a stem's few sections stay together as arrays, so every pair of parameters is tried where they are
    stems = base.groupBy(*ks).agg(F.first("dbh").alias("dbh"), F.first("total_h").alias("total_h"), F.sort_array(F.collect_list(F.struct("h_m", "d_cm"))).alias("s"))
    stems = stems.select(*ks, "dbh", F.col("total_h").cast("double").alias("total_h"), F.col("s.h_m").cast("array<double>").alias("h"), F.col("s.d_cm").cast("array<double>").alias("d"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stems.select(*ks).schema.fields)
    return stems.mapInArrow(_taper_search(len(ks), steps), kinds + ", a double, b double, sse double, taper_m3 double")


def trunk_summary(diameters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-tree summary of slice diameters ``h_m, d_cm, chi2_pass`` with tree height ``total_h``."""
    ks = list(keys)
    def near(target: Column, tol: float) -> Column:
        gap = F.abs(F.col("h_m") - target)
        m = F.min(F.struct(gap.alias("g"), F.col("h_m").alias("h"), F.col("d_cm").alias("d")))
        return F.when(m.g <= tol, m.d)
    s = diameters.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n_heights"), (F.max("h_m") - F.min("h_m")).alias("height_range"), F.max("d_cm").alias("d_max"), F.avg("d_cm").alias("d_mean"),
        near(F.lit(1.3), 0.5).alias("d_13"), near(F.col("total_h") / 3, 1.0).alias("d_third"), F.round(F.avg(F.col("chi2_pass").cast("double")), 2).alias("chi2_ratio"), F.max("total_h").alias("total_h"))
    v = section_volumes(diameters, ks).select(*ks, F.round("smalian_m3", 6).alias("smalian_m3"), F.round("huber_m3", 6).alias("huber_m3"))
    s = s.join(v, ks)
    return s.withColumn("form_m3", F.round(form_factor_volume("d_13", "total_h"), 6)).withColumn("biomass_kg", F.round(stem_biomass("d_13", "total_h"), 2)).drop("total_h")


def pivot_diameters(diameters: DataFrame, keys: Sequence[str], heights: Sequence[float]) -> DataFrame:
    """``d_at_{h}m`` columns for the given half-metre heights (the last slice of a height wins)."""
    key = F.round(F.col("h_m") * 2) / 2
    aggs = [F.max_by("d_cm", F.when(key == h, F.col("h_m"))).alias(f"d_at_{h:.1f}m".replace(".", "_")) for h in heights]
    return diameters.groupBy(*keys).agg(*aggs)


def basal_area(census: DataFrame, keys: Sequence[str], area_ha: float) -> DataFrame:
    """Basal area and count per hectare, quadratic mean diameter and the same from the identity."""
    d = F.col("d_cm")
    g = census.where("d_cm is not null").groupBy(*keys).agg((F.sum(F.pi() * d / 200 * d / 200) / area_ha).alias("g_ha"), (F.count(d) / area_ha).alias("n_ha"), F.sqrt(F.avg(d * d)).alias("dq"))
    return g.withColumn("dq_identity", F.sqrt(40000 * F.col("g_ha") / (F.pi() * F.col("n_ha"))))


def with_total(df: DataFrame, key: str, aggs: Sequence[Column]) -> DataFrame:
    """Per-key rows plus one TOTAL row (rollup)."""
    return df.rollup(key).agg(F.grouping(key).alias("is_total"), *aggs)
