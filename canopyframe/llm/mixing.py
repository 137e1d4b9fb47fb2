"""Mixing sources to target weights as a Pfair schedule, with DataFrame functions only.

Weights are whole numbers; their sum ``Q`` is the period. A source of weight ``q`` owes ``q`` blocks per period. Its block ``i`` may
be placed from slot ``floor(i * Q / q)`` and must be placed before slot ``ceil((i + 1) * Q / q)``. Filling slots with the released
block of the earliest deadline (ties: the larger weight, then the name) meets every deadline, since the weights add up to one; so after every slot each source is
less than one block away from its target share.

Windows repeat with the period (every deadline of a period lies in it), so the schedule of one period is the whole
schedule: block ``i`` of a source stands in slot ``floor(i / q) * Q + slot(i mod q)``. The period is computed by a fold over
``Q`` slots on one row, whose size depends on the weights alone; all documents then get their slots by a join with the ``Q`` pairs.

Ranks inside a source never sort one source in one task: documents are ordered by a hash of their id, cut into hash ranges of
about ``RANGE_ROWS`` documents, ranked inside a range and shifted by the sums of the ranges before.

Blocks hold ``block`` documents. Sources not named in the weights form one pool named ``*``; a null source belongs to it. A source whose blocks run
out leaves its later slots empty; ``in_mix`` marks slots before the first such slot, where the shares hold. Every document keeps a row.

Defined cases: no documents give no rows; a named source without documents ends the mix at its first slot; rows with equal
ids are ordered by their text; fully equal rows are interchangeable; null ids and texts count as empty; columns that bear
the names of added ones are replaced.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from canopyframe.session import cut

POOL = "*"
RANGE_ROWS = 20_000
MAX_PERIOD = 10_000
ADDED = ["mix_source", "mix_rank", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_in"]


def reduced(weights: dict[str, int]) -> dict[str, int]:
    """Weights over their greatest common divisor, with the pool."""
    if any(int(q) != q or q < 1 for q in weights.values()):
        raise ValueError("weights are whole numbers from 1")
    every = {POOL: 1, **{s: int(q) for s, q in weights.items()}}
    g = math.gcd(*every.values())
    every = {s: q // g for s, q in every.items()}
    if sum(every.values()) > MAX_PERIOD:
        raise ValueError(f"weights add up to more than {MAX_PERIOD}")
    return every


def period(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """``source, q, period, turn, slot``: earliest deadline first over one period."""
    every = reduced(weights)
    total = sum(every.values())
    order = sorted(every, key=lambda s: (-every[s], s))
    qs = F.array(*[F.lit(every[s]) for s in order])
    n, q_all = len(order), F.lit(total)

    def place(state: Column, slot: Column) -> Column:
        """Adds the source to run in ``slot``; ``done`` counts the blocks each source has had."""
        done = state["done"]
        # a released block's deadline before its index decides ties by weight and name
        bid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(
            F.when(F.floor(F.get(done, s) * q_all / F.get(qs, s)) <= slot, F.ceil((F.get(done, s) + 1) * q_all / F.get(qs, s))).otherwise(F.lit(2 * MAX_PERIOD)).alias("deadline"), s.alias("s")))
        best = F.array_min(bid)["s"]
        return F.struct(F.transform(done, lambda d, s: d + F.when(s == best, 1).otherwise(0)).alias("done"), F.concat(state["runs"], F.array(best)).alias("runs"))

    start = F.struct(F.array(*[F.lit(0)] * n).alias("done"), F.array().cast("array<int>").alias("runs"))
    runs = spark.range(1).select(F.aggregate(F.sequence(F.lit(0), q_all - 1), start, place)["runs"].alias("runs"))
    names = F.array(*[F.lit(s) for s in order])
    slots = runs.select(F.posexplode("runs").alias("slot", "s"))
    turn = F.row_number().over(Window.partitionBy("s").orderBy("slot")) - 1
    return slots.select(F.get(names, "s").alias("source"), F.get(qs, "s").alias("q"), F.lit(total).alias("period"), turn.alias("turn"), "slot")


def mix_sources(docs: DataFrame, weights: dict[str, int], block: int = 8, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``mix_source, mix_rank, mix_block, mix_slot, mix_release, mix_deadline, mix_in``."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    plan = cut(period(spark, weights))
    named = sorted(set(reduced(weights)) - {POOL})
    group = F.when(F.col(source).isin(named), F.col(source)).otherwise(F.lit(POOL)) if named else F.lit(POOL)
    name = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    value = F.conv(F.substring("__k", 1, 8), 16, 10).cast("long")
    rows = docs.select(*keep, group.alias("mix_source"), name.alias("__k"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    # ranges of about RANGE_ROWS documents: the largest source decides how finely all are cut
    counts = rows.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 1
    ranges = max(1, math.ceil(largest / RANGE_ROWS))
    rows = rows.withColumn("__r", F.floor(value * ranges / F.lit(1 << 32)).cast("int"))
    sums = rows.groupBy("mix_source", "__r").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("mix_source").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("mix_source", "__r", F.coalesce(before, F.lit(0)).alias("__b"))
    local = F.row_number().over(Window.partitionBy("mix_source", "__r").orderBy("__k", "__t")) - 1
    ranked = rows.withColumn("__l", local).join(offsets, ["mix_source", "__r"]).withColumn("mix_rank", F.col("__l") + F.col("__b"))
    blocks = ranked.withColumn("mix_block", F.floor(F.col("mix_rank") / block))
    # a source's blocks by period and turn; the mix ends where the first source has no block left
    totals = plan.select(F.col("source").alias("mix_source"), "q", "period").distinct().join(counts, "mix_source", "left")
    have = F.ceil(F.coalesce("n", F.lit(0)) / block)
    ends = (totals.select("mix_source", "q", "period", have.alias("have"))
            .join(plan.select(F.col("source").alias("mix_source"), "turn", "slot"), "mix_source").where(F.col("have") % F.col("q") == F.col("turn"))
            .agg(F.min(F.floor(F.col("have") / F.col("q")) * F.col("period") + F.col("slot")).alias("end")))
    end = ends.first()["end"]
    slots = plan.select(F.col("source").alias("mix_source"), F.col("q").alias("__q"), F.col("period").alias("__p"), F.col("turn").alias("__turn"), F.col("slot").alias("__s"))
    qs = reduced(weights)
    q = F.coalesce(*[F.when(F.col("mix_source") == s, F.lit(x)) for s, x in qs.items()])
    placed = (blocks.withColumn("__turn", (F.col("mix_block") % q).cast("int")).join(slots, ["mix_source", "__turn"])
              .withColumn("mix_slot", F.floor(F.col("mix_block") / F.col("__q")) * F.col("__p") + F.col("__s"))
              .withColumn("mix_release", F.floor(F.col("mix_block") * F.col("__p") / F.col("__q")))
              .withColumn("mix_deadline", F.ceil((F.col("mix_block") + 1) * F.col("__p") / F.col("__q")))
              .withColumn("mix_in", F.col("mix_slot") < F.lit(end)))
    return placed.select(*keep, *ADDED)
