"""Ranks, indexes and exact percentiles that never sort one whole key in one task.

A key may hold a large share of all rows.  Each key's value range is therefore cut into up to
``MAX_BUCKETS`` slices; slice counts (a partial aggregate) give every slice its starting rank and
only rows of one slice meet in one window partition.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ROWS_PER_BUCKET = 4096
MAX_BUCKETS = 65536


def _slices(df: DataFrame, keys: Sequence[str], value: str, weight: str | None) -> DataFrame:
    """``df`` + ``__b`` (slice of the key's value range) + ``__below`` (weight in earlier slices) + ``__n``."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    d = df.withColumn("__k", F.lit(0)) if not keys else df
    ks = list(keys) or ["__k"]
    for k in ks:
        d = d.where(F.col(k).isNotNull())  # rows without a key have no place
    span = d.groupBy(*ks).agg(
        F.min(value).cast("double").alias("__lo"),
        F.max(value).cast("double").alias("__hi"),
        F.count(F.lit(1)).alias("__rows"),
        F.sum(w).alias("__n"),
    )
    nb = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("__rows") / ROWS_PER_BUCKET))
    pos = F.when(
        F.col("__hi") > F.col("__lo"),
        F.floor((F.col(value).cast("double") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * nb),
    ).otherwise(F.lit(0))
    # every row finds its key; left joins because only their right side can be broadcast: Spark takes rows for small by their files' size
    binned = d.join(span, ks, "left").withColumn("__b", F.least(nb - 1, pos).cast("bigint"))
    hist = binned.groupBy(*ks, "__b").agg(F.sum(w).alias("__m"))
    order = W.partitionBy(*ks).orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    below = hist.withColumn("__below", F.sum("__m").over(order) - F.col("__m"))
    return binned, below, ks


def sorted_index(df: DataFrame, keys: Sequence[str], value: str, name: str = "idx",
                 ties: Sequence[str | Column] = ()) -> DataFrame:
    """0-based position of each row in the ascending order of the numeric ``value`` inside its key."""
    binned, below, ks = _slices(df, keys, value, None)
    within = W.partitionBy(*ks, "__b").orderBy(value, *ties)
    out = binned.join(below.drop("__m"), [*ks, "__b"], "left")
    out = out.withColumn(name, F.col("__below") + F.row_number().over(within) - 1)
    return out.select(*df.columns, name, F.col("__n").alias(f"{name}_n"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One row per key with linearly interpolated percentiles named by ``probs``.

    Equal values are counted before the shuffle; only slices holding a wanted rank are sorted.
    """
    vc = (df.where(F.col(value).isNotNull())
          .groupBy(*keys, F.col(value).cast("double").alias("__v"))
          .agg(F.count(F.lit(1)).alias("__c")))
    binned, below, ks = _slices(vc, keys, "__v", "__c")
    ranks = {}
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        ranks[name] = (F.floor(pos), F.ceil(pos), pos - F.floor(pos))
    n_of_key = binned.select(*ks, "__b", "__v", "__c", "__n").join(below, [*ks, "__b"])
    wanted = None
    for lo, hi, _ in ranks.values():
        for r in (lo, hi):
            hit = (r >= F.col("__below")) & (r < F.col("__below") + F.col("__m"))
            wanted = hit if wanted is None else wanted | hit
    order = W.partitionBy(*ks, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (n_of_key.where(wanted)
              .withColumn("__end", F.col("__below") + F.sum("__c").over(order))
              .withColumn("__start", F.col("__end") - F.col("__c")))
    aggs = [F.max("__n").alias("__n")]
    for name, (lo, hi, _) in ranks.items():
        for tag, r in (("l", lo), ("h", hi)):
            inside = (r >= F.col("__start")) & (r < F.col("__end"))
            aggs.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{tag}_{name}"))
    got = placed.groupBy(*ks).agg(*aggs)
    cols = []
    for name, (_, _, frac) in ranks.items():
        lo, hi = F.col(f"__l_{name}"), F.col(f"__h_{name}")
        cols.append((lo + (hi - lo) * frac).alias(name))
    return got.select(*keys, *cols)


def top_fraction(df: DataFrame, keys: Sequence[str], value: str, frac: float) -> DataFrame:
    """Rows among the largest ``greatest(1, int(n * frac))`` of their key."""
    neg = df.withColumn("__neg", -F.col(value))
    r = sorted_index(neg, keys, "__neg", "__i")
    keep = F.greatest(F.lit(1), F.floor(F.col("__i_n") * F.lit(float(frac))))
    return r.where(F.col("__i") < keep).drop("__neg", "__i", "__i_n")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """1-based rank with ties sharing their mean rank, from value counts."""
    vc = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    binned, below, ks = _slices(vc, keys, value, "__c")
    order = W.partitionBy(*ks, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (binned.join(below, [*ks, "__b"])
              .withColumn("__end", F.col("__below") + F.sum("__c").over(order))
              .select(*keys, value, (F.col("__end") - (F.col("__c") - 1) / 2.0).alias(name)))
    return df.join(ranked, [*keys, value])
