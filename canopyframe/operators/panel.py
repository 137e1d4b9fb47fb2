"""Panel statistics: scores, cross-validated linear fits, intervals, resampling tests, estimation.

Linear folds come from sufficient statistics (all rows minus the held-out ones), so a leave-one-out or
leave-one-group-out run is one aggregate whatever the number of folds.  Replicates carry a key and
draw by a hash of (seed, replicate, position), so results do not depend on partitioning.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from canopyframe.functions.hashing import mix
from canopyframe.functions.scalars import Z_975
from canopyframe.operators import resampling
from canopyframe.operators.ranks import average_rank, exact_quantiles, sorted_index


def pearson(a: str, b: str) -> Column:
    """Correlation, null when a side is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def scores(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "pred") -> DataFrame:
    e = F.col(p) - F.col(y)
    rmse = F.sqrt(F.avg(e * e))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
        rmse.alias("rmse"), (100 * rmse / F.avg(y)).alias("rrmse"), F.avg(e).alias("bias"), (100 * F.avg(e) / F.avg(y)).alias("bias_pct"))


def fold_scores(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "pred") -> DataFrame:
    """Adds MAE, MAPE over non-zero targets and Pearson r."""
    e = F.abs(F.col(p) - F.col(y))
    more = df.groupBy(*keys).agg(F.avg(e).alias("mae"), (100 * F.avg(F.when(F.col(y) != 0, e / F.abs(F.col(y))))).alias("mape"), pearson(y, p).alias("r"))
    return scores(df, keys, y, p).join(more, list(keys))


# ---- linear fits from sufficient statistics -------------------------------------------------------

def _names(xs: Sequence[str]) -> list[str]:
    return ["__one", *xs]


def moments(df: DataFrame, keys: Sequence[str], xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """Sums of products ``m_i_j`` of (1, xs) and ``t_i_y`` with every y, plus ``q_y``."""
    v = {"__one": F.lit(1.0), **{x: F.col(x).cast("double") for x in xs}}
    n = _names(xs)
    aggs = [F.sum(v[a] * v[b]).alias(f"m_{i}_{j}") for i, a in enumerate(n) for j, b in enumerate(n) if i <= j]
    aggs += [F.sum(v[a] * F.col(y)).alias(f"t_{i}_{y}") for i, a in enumerate(n) for y in ys]
    aggs += [F.sum(F.col(y) * F.col(y)).alias(f"q_{y}") for y in ys]
    return df.groupBy(*keys).agg(*aggs)


def solve(df: DataFrame, k: int, t: str, out: str, m: str = "m") -> DataFrame:
    """Adds ``out_0..out_{k-1}`` solving the symmetric system ``m_i_j . out = t_i`` by elimination.

    A zero pivot (too few rows, a constant or repeated column) gives null results for that row only.
    """
    a = {(i, j): f"{m}_{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k)}
    b = {i: t.format(i) for i in range(k)}
    made: list[str] = []
    for p in range(k):
        step = {}
        for i in range(p + 1, k):
            f = F.try_divide(F.col(a[i, p]), F.col(a[p, p]))
            for j in range(p + 1, k):
                step[f"__e{out}{p}_{i}_{j}"] = F.col(a[i, j]) - f * F.col(a[p, j])
            step[f"__e{out}{p}_{i}"] = F.col(b[i]) - f * F.col(b[p])
        if step:
            df = df.withColumns(step)
            made += list(step)
        for i in range(p + 1, k):
            for j in range(p + 1, k):
                a[i, j] = f"__e{out}{p}_{i}_{j}"
            b[i] = f"__e{out}{p}_{i}"
    for i in reversed(range(k)):
        s = F.col(b[i])
        for j in range(i + 1, k):
            s = s - F.col(a[i, j]) * F.col(f"{out}_{j}")
        df = df.withColumn(f"{out}_{i}", F.try_divide(s, F.col(a[i, i])))
    return df.drop(*made)


def _centred(df: DataFrame, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """xs as deviations from their overall mean (better conditioned; slopes and predictions unchanged)."""
    mean = df.agg(F.struct(*[F.avg(x).alias(x) for x in xs])).scalar()
    d = df.withColumn("__mu", mean)
    return d.withColumns({x: F.col(x) - F.col("__mu")[x] for x in xs}).drop("__mu")


def linear_fit(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """Coefficients ``b_0..`` in original units, ``n``, ``resid_sd`` (n-1), ``r2`` per ``by``."""
    k = len(xs) + 1
    ks = list(by) or ["__all"]
    d = df if by else df.withColumn("__all", F.lit(0))
    mu = d.groupBy(*ks).agg(*[F.avg(c).alias(f"__mu_{c}") for c in [*xs, y]])
    # rows are the left side of a left join, which is never broadcast
    c = d.join(mu, ks, "left").withColumns({v: F.col(v) - F.col(f"__mu_{v}") for v in [*xs, y]})
    m = solve(moments(c, ks, xs, [y]).join(mu, ks), k, f"t_{{}}_{y}", "b")
    sse = F.col(f"q_{y}") - sum((F.col(f"b_{i}") * F.col(f"t_{i}_{y}") for i in range(1, k)), F.col("b_0") * F.col(f"t_0_{y}"))
    b0 = F.col("b_0") + F.col(f"__mu_{y}") - sum((F.col(f"b_{i + 1}") * F.col(f"__mu_{x}") for i, x in enumerate(xs)), F.lit(0.0))
    return m.select(*by, b0.alias("b_0"), *[f"b_{i}" for i in range(1, k)], F.col("m_0_0").alias("n"),
                    F.sqrt(F.try_divide(sse, F.col("m_0_0") - 1)).alias("resid_sd"), (1 - F.try_divide(sse, F.col(f"q_{y}"))).alias("r2"))


def linear_oof(df: DataFrame, row: str, xs: Sequence[str], y: str, group: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Held-out predictions ``by, row, y, pred, sd``: one row (or one whole ``group``) left out at a time."""
    k = len(xs) + 1
    d = _centred(df.select(*dict.fromkeys([*by, row, *([group] if group else []), *xs, y])), xs, by)
    ks = list(by) or ["__all"]
    d = d if by else d.withColumn("__all", F.lit(0))
    total = moments(d, ks, xs, [y])
    cols = [c for c in total.columns if c not in ks]
    total = total.withColumnsRenamed({c: f"__T{c}" for c in cols})
    own = moments(d, [*ks, group or row], xs, [y])
    fold = own.join(total, ks).withColumns({c: F.col(f"__T{c}") - F.col(c) for c in cols}).drop(*[f"__T{c}" for c in cols])
    fold = solve(fold, k, f"t_{{}}_{y}", "b")
    sse = F.col(f"q_{y}") - sum((F.col(f"b_{i}") * F.col(f"t_{i}_{y}") for i in range(1, k)), F.col("b_0") * F.col(f"t_0_{y}"))
    fold = fold.select(*ks, group or row, *[f"b_{i}" for i in range(k)], F.sqrt(F.try_divide(F.greatest(sse, F.lit(0.0)), F.col("m_0_0") - 1)).alias("sd"))
    pred = sum((F.col(f"b_{i + 1}") * F.col(x) for i, x in enumerate(xs)), F.col("b_0"))
    if by:
        fold = fold.hint("merge")  # replicates' rows look as small as the table they are made of
    return d.join(fold, [*ks, group or row]).select(*by, row, *([group] if group else []), F.col(y).alias("y"), pred.alias("pred"), "sd")


def residual_oof(df: DataFrame, row: str, base: str, extra: str, y: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Two-stage leave-one-group-out: ``y ~ base``, then its training residual ``~ extra``.

    Both fits of every fold follow from one set of group moments.
    """
    d = _centred(df.select(*dict.fromkeys([*by, row, group, base, extra, y])), [base, extra], by)
    ks = list(by) or ["__all"]
    d = d if by else d.withColumn("__all", F.lit(0))
    total = moments(d, ks, [base, extra], [y])
    cols = [c for c in total.columns if c not in ks]
    fold = (moments(d, [*ks, group], [base, extra], [y]).join(total.withColumnsRenamed({c: f"__T{c}" for c in cols}), ks)
            .withColumns({c: F.col(f"__T{c}") - F.col(c) for c in cols}))
    fold = solve(fold, 2, f"t_{{}}_{y}", "b")
    # moments of the extra covariate with the training residual y - b0 - b1 * base
    fold = fold.withColumns({
        "r_0_0": F.col("m_0_0"), "r_0_1": F.col("m_0_2"), "r_1_1": F.col("m_2_2"),
        "u_0": F.col(f"t_0_{y}") - F.col("b_0") * F.col("m_0_0") - F.col("b_1") * F.col("m_0_1"),
        "u_1": F.col(f"t_2_{y}") - F.col("b_0") * F.col("m_0_2") - F.col("b_1") * F.col("m_1_2")})
    fold = solve(fold, 2, "u_{}", "c", "r").select(*ks, group, "b_0", "b_1", "c_0", "c_1")
    if by:
        fold = fold.hint("merge")
    j = d.join(fold, [*ks, group])
    p = F.col("b_0") + F.col("b_1") * F.col(base)
    r = F.col("c_0") + F.col("c_1") * F.col(extra)
    return j.select(*by, row, group, F.col(y).alias("y"), p.alias("base_pred"), r.alias("resid_pred"), (p + r).alias("pred"), (F.col(y) - p).alias("resid_true"))


# ---- conformal intervals ------------------------------------------------------------------------

def finite_level(m: Column, alpha: float) -> Column:
    return F.least(F.ceil(F.lit(1 - alpha) * (m + 1)) / m, F.lit(1.0))


def _upper_rank(m: Column, alpha: float) -> Column:
    return F.ceil(finite_level(m, alpha) * (m - 1))


def loo_conformal(df: DataFrame, alpha: float = 0.05, keys: Sequence[str] = (), y: str = "y", p: str = "pred") -> DataFrame:
    """Half-width of each row = finite-sample quantile of the *other* absolute residuals of its key."""
    ks = list(keys) or ["__all"]
    d = df if keys else df.withColumn("__all", F.lit(0))
    r = sorted_index(d.withColumn("res", F.abs(F.col(y) - F.col(p))), ks, "res", "i")
    k = _upper_rank(F.col("i_n") - 1, alpha)
    pick = r.groupBy(*ks).agg(F.max(F.when(F.col("i") == k, F.col("res"))).alias("__a"), F.max(F.when(F.col("i") == k + 1, F.col("res"))).alias("__b"))
    half = F.when(F.col("i") <= k, F.col("__b")).otherwise(F.col("__a"))
    out = r.join(pick, ks).withColumn("half", F.when(F.col("i_n") >= 2, half).otherwise(F.lit(float("inf"))))
    return out.withColumn("lo", F.col(p) - F.col("half")).withColumn("hi", F.col(p) + F.col("half")).drop("i", "i_n", "__a", "__b", "__all")


def upper_quantile(df: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """One row ``q``: the conservative order statistic of all values."""
    r = sorted_index(df, [], value, "i")
    return r.where(F.col("i") == _upper_rank(F.col("i_n"), alpha)).select(F.col(value).alias("q"))


def mondrian_interval(df: DataFrame, group: str, alpha: float = 0.05, y: str = "y", p: str = "pred") -> DataFrame:
    """Per-group conformal; groups with fewer than two others use the global quantile."""
    g = loo_conformal(df, alpha, [group], y, p)
    n = df.groupBy(group).agg((F.count(F.lit(1)) - 1).alias("__others"))
    glob = upper_quantile(df.withColumn("res", F.abs(F.col(y) - F.col(p))), "res", alpha).scalar()
    g = g.join(n, group).withColumn("half", F.when(F.col("__others") >= 2, F.col("half")).otherwise(glob)).drop("__others")
    return g.withColumn("lo", F.col(p) - F.col("half")).withColumn("hi", F.col(p) + F.col("half"))


def weighted_interval(df: DataFrame, scale: str, alpha: float = 0.05, y: str = "y", p: str = "pred") -> DataFrame:
    s = F.greatest(F.col(scale), F.lit(1e-9))
    d = df.withColumn("__s", s).withColumn("__r", F.abs(F.col(y) - F.col(p)) / s)
    q = upper_quantile(d, "__r", alpha).scalar()
    d = d.withColumn("half", q * F.col("__s"))
    return d.withColumn("lo", F.col(p) - F.col("half")).withColumn("hi", F.col(p) + F.col("half")).drop("__s", "__r")


def interval_quality(df: DataFrame, keys: Sequence[str], alpha: float = 0.05, y: str = "y") -> DataFrame:
    v, lo, hi = F.col(y), F.col("lo"), F.col("hi")
    miss = F.when(v < lo, (lo - v) * (2 / alpha)).when(v > hi, (v - hi) * (2 / alpha)).otherwise(0.0)
    return df.groupBy(*keys).agg(F.avg(v.between(lo, hi).cast("double")).alias("coverage"), F.avg(hi - lo + miss).alias("score"))


# ---- resampling ---------------------------------------------------------------------------------

def bootstrap(df: DataFrame, order: str, reps: int, seed: int, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``reps`` resamples with replacement: ``keys, rep`` and the drawn ``values`` (n rows each)."""
    df, rows = resampling.small(df.select(*dict.fromkeys([*keys, order, *values])))
    if rows is not None:
        return resampling.bootstrap(df, rows, order, reps, seed, values, keys)
    ks = list(keys) or ["__all"]
    d = df if keys else df.withColumn("__all", F.lit(0))
    idx = sorted_index(d.select(*dict.fromkeys([*ks, order, *values])), ks, order, "i")
    slot = idx.select(*ks, F.col("i").alias("slot"), F.col("i_n").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    slot = slot.withColumn("i", mix("rep", "slot", seed) % F.col("n")).groupBy(*ks, "rep", "i").agg(F.count(F.lit(1)).alias("w"))
    return slot.join(idx.select(*ks, "i", *values).hint("merge"), [*ks, "i"]).drop("i", "__all")


def bootstrap_sums(df: DataFrame, order: str, reps: int, seed: int, values: Sequence[str]) -> DataFrame:
    """``rep, w, values``: the rows of each resample of :func:`bootstrap` and the sums of ``values`` over them, added up where it is drawn."""
    df, rows = resampling.small(df.select(*dict.fromkeys([order, *values])))
    if rows is not None:
        return resampling.bootstrap_sums(df, rows, order, reps, seed, values)
    b = bootstrap(df, order, reps, seed, values)
    return b.groupBy("rep").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(v)).alias(v) for v in values])


def weighted_scores(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "pred") -> DataFrame:
    """Scores of rows repeated ``w`` times."""
    w, e = F.col("w"), F.col(p) - F.col(y)
    n, sy, syy, se = F.sum(w), F.sum(w * F.col(y)), F.sum(w * F.col(y) * F.col(y)), F.sum(w * e * e)
    sst = syy - sy * sy / n
    return df.groupBy(*keys).agg(F.sqrt(se / n).alias("rmse"), (100 * F.sqrt(se / n) / (sy / n)).alias("rrmse"),
                                 F.when(sst > 1e-9, 1 - se / sst).alias("r2"), (F.sum(w * F.abs(e)) / n).alias("mae"))


def permuted(df: DataFrame, order: str, target: str, reps: int, seed: int, within: Sequence[str] = ()) -> DataFrame:
    """Every row once per ``rep`` with ``target`` shuffled (inside ``within`` when given).

    Rows keep their columns; the shuffled target replaces the original one.
    """
    df, rows = resampling.small(df)
    if rows is not None:
        return resampling.permuted(df, rows, order, target, reps, seed, within)
    ks = list(within) or ["__all"]
    d = df if within else df.withColumn("__all", F.lit(0))
    idx = sorted_index(d, ks, order, "i")
    many = idx.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    keyed = many.select(*ks, "rep", F.col(target).alias("__t"), F.col("i").alias("__o"), mix("rep", order, seed).alias("__h"))
    placed = sorted_index(keyed, [*ks, "rep"], "__h", "i", ["__o"]).select(*ks, "rep", "i", F.col("__t").alias(f"{target}"))
    return many.drop(target).join(placed.hint("merge"), [*ks, "rep", "i"]).drop("i", "i_n", "__all")


def add_one_p(null: DataFrame, stat: str, observed: Column) -> DataFrame:
    return null.agg(((1 + F.count_if(F.col(stat) >= observed)) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.avg(stat).alias("null_mean"), F.stddev_samp(stat).alias("null_sd"))


# ---- decomposition, estimation, calibration -------------------------------------------------------

def centred(df: DataFrame, group: str, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    ks = [*keys, group]
    m = df.groupBy(*ks).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    if keys:
        m = m.hint("merge")  # as in linear_oof
    return df.join(m, ks).withColumns({f"{c}_c": F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def safe_corr(a: str, b: str) -> Column:
    ok = (F.count(F.lit(1)) >= 3) & (F.var_pop(a) > 1e-18) & (F.var_pop(b) > 1e-18)
    return F.when(ok, pearson(a, b))


def correlation_split(df: DataFrame, group: str, y: str = "y", p: str = "pred") -> DataFrame:
    means = df.groupBy(group).agg(F.avg(y).alias(y), F.avg(p).alias(p))
    between = means.agg(safe_corr(y, p).alias("r")).scalar()
    g = means.agg(F.count(F.lit(1)).alias("g")).scalar()
    within = centred(df, group, [y, p]).agg(safe_corr(f"{y}_c", f"{p}_c")).scalar()
    return df.agg(safe_corr(y, p).alias("r_total"), F.count(F.lit(1)).alias("n")).select(
        "r_total", between.alias("r_between"), within.alias("r_within"), "n", g.alias("n_groups"), (F.col("n") - g).alias("n_within_df"))


def field_mean(df: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    se = F.sqrt(F.var_samp(y) / F.count(y))
    return df.groupBy(*keys).agg(F.avg(y).alias("mean_ha"), se.alias("se"), F.count(F.lit(1)).alias("n")) \
        .withColumn("lo", F.col("mean_ha") - Z_975 * F.col("se")).withColumn("hi", F.col("mean_ha") + Z_975 * F.col("se"))


def assisted_mean(sample: DataFrame, population: DataFrame, keys: Sequence[str], y: str = "y", p: str = "pred", cell: str = "cell_pred") -> DataFrame:
    """Population mean of the predictions plus the mean field residual (obs - pred), with its error."""
    r = F.col(y) - F.col(p)
    s = sample.groupBy(*keys).agg(F.avg(r).alias("field_correction"), F.sqrt(F.var_samp(r) / F.count(r)).alias("se"), F.count(F.lit(1)).alias("n"))
    m = population.groupBy(*keys).agg(F.avg(cell).alias("pop_mean"))
    j = s.join(m, list(keys)).withColumn("mean_ha", F.col("pop_mean") + F.col("field_correction"))
    return j.withColumn("lo", F.col("mean_ha") - Z_975 * F.col("se")).withColumn("hi", F.col("mean_ha") + Z_975 * F.col("se"))


def efficiency(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "pred") -> DataFrame:
    r = F.col(y) - F.col(p)
    ratio = F.try_divide(F.col("__vy"), F.col("__ve"))
    return df.groupBy(*keys).agg(F.var_samp(y).alias("__vy"), F.var_samp(r).alias("__ve"), F.count(F.lit(1)).alias("n"), F.avg(r).alias("residual_bias")).select(
        *keys, "n", ratio.alias("re"), (F.col("n") * (ratio - 1)).alias("equivalent_plots"),
        F.sqrt(F.col("__vy") / F.col("n")).alias("se_field"), F.sqrt(F.col("__ve") / F.col("n")).alias("se_model"),
        (100 * (1 - F.sqrt(F.try_divide(F.col("__ve"), F.col("__vy"))))).alias("se_reduction"), "residual_bias")


def density_factors(df: DataFrame, raw: str, y: str, proxy: str) -> DataFrame:
    """One row: ratio and mean-ratio factors, proxy factor ``a + b * z`` with the z-score parameters."""
    s = df.agg(F.avg(proxy).alias("mu"), F.stddev_pop(proxy).alias("sd"))
    s = s.select(F.struct("mu", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd")).alias("s")).scalar()
    x = F.when(F.col(raw) > 0, F.col(raw)).otherwise(1e-6)
    d = df.withColumn("__s", s).withColumn("__x", x).withColumn("__z", x * (F.col(proxy) - F.col("__s")["mu"]) / F.col("__s")["sd"])
    a = d.agg(F.sum("__x").alias("sx"), F.sum(y).alias("sy"), F.avg(F.col(y) / F.col("__x")).alias("mean_factor"),
              F.sum(F.col("__x") * F.col("__x")).alias("xx"), F.sum(F.col("__x") * F.col("__z")).alias("xz"), F.sum(F.col("__z") * F.col("__z")).alias("zz"),
              F.sum(F.col("__x") * F.col(y)).alias("xy"), F.sum(F.col("__z") * F.col(y)).alias("zy"), F.first(F.col("__s")["mu"]).alias("mu"), F.first(F.col("__s")["sd"]).alias("sd"))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    return a.select((F.col("sy") / F.col("sx")).alias("ratio_factor"), "mean_factor",
                    ((F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det).alias("a"), ((F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det).alias("b"), "mu", "sd")


def apply_density(df: DataFrame, factors: DataFrame, raw: str, proxy: str, clip: tuple[float, float] = (0.25, 6.0)) -> DataFrame:
    f = factors.select(F.struct(*factors.columns)).scalar()
    d = df.withColumn("__f", f)
    fac = F.col("__f")["a"] + F.col("__f")["b"] * (F.col(proxy) - F.col("__f")["mu"]) / F.col("__f")["sd"]
    fac = F.least(F.greatest(fac, F.lit(clip[0])), F.lit(clip[1]))
    return d.withColumn("global_pred", F.greatest(F.col(raw) * F.col("__f")["ratio_factor"], F.lit(0.0))) \
        .withColumn("proxy_pred", F.greatest(F.col(raw) * fac, F.lit(0.0))).drop("__f")


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    r = average_rank(average_rank(df, keys, a, "__ra"), keys, b, "__rb")
    return r.groupBy(*keys).agg(pearson("__ra", "__rb").alias("rho"))


def equal_count_edges(df: DataFrame, value: str, k: int) -> DataFrame:
    """One row ``edges``: the inner percentile edges of ``k`` equal-count blocks."""
    q = exact_quantiles(df, [], value, {f"e{i}": i / k for i in range(1, k)})
    return q.select(F.array(*[f"e{i}" for i in range(1, k)]).alias("edges"))


def blocks(df: DataFrame, value: str, k: int, name: str = "block", right: bool = False) -> DataFrame:
    """Block number by percentile edges: half-open on the right, or closed (``right``) as quantile classes."""
    e = equal_count_edges(df, value, k)
    arr = F.array_distinct(e.scalar()) if right else e.scalar()
    cmp = (lambda x: x < F.col(value)) if right else (lambda x: x <= F.col(value))
    return df.withColumn("__e", arr).withColumn(name, F.size(F.filter("__e", cmp))).drop("__e")


def welch(df: DataFrame, arm: str, value: str) -> DataFrame:
    """Difference of two arms (1 minus 0), its standard error, t and degrees of freedom."""
    g = df.groupBy(arm).agg(F.avg(value).alias("m"), (F.var_samp(value) / F.count(value)).alias("v"), F.count(value).alias("c"))
    one = g.agg(*[F.max(F.when(F.col(arm) == a, F.col(x))).alias(f"{x}{a}") for a in (0, 1) for x in ("m", "v", "c")])
    v = F.col("v0") + F.col("v1")
    dof = v * v / (F.col("v0") * F.col("v0") / (F.col("c0") - 1) + F.col("v1") * F.col("v1") / (F.col("c1") - 1))
    return one.select((F.col("m1") - F.col("m0")).alias("diff"), F.sqrt(v).alias("se"), ((F.col("m1") - F.col("m0")) / F.sqrt(v)).alias("t"), dof.alias("dof"))
