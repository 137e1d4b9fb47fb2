"""Distance joins on a hash grid.

A plain distance predicate plans as a nested loop; the functions here give Spark an equi-join on
grid cells and keep the exact distance test as a residual condition.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from canopyframe.session import cut


def cell(c: str | Column, side: float | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / side).cast("bigint")


def offsets(k: int) -> Column:
    """All (i, j) cell steps with both components in [-k, k], as an array of structs."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                     for i in range(-k, k + 1) for j in range(-k, k + 1)])


def spread(df: DataFrame, gx: Column, gy: Column, k: int) -> DataFrame:
    """One copy of each row per cell within ``k`` steps; adds ``gx, gy``."""
    return (df.withColumn("__o", F.explode(offsets(k)))
            .withColumn("gx", (gx + F.col("__o.i")).cast("bigint"))
            .withColumn("gy", (gy + F.col("__o.j")).cast("bigint"))
            .drop("__o"))


def _dist2(a: Sequence[str], b: Sequence[str]) -> Column:
    return (F.col(a[0]) - F.col(b[0])) * (F.col(a[0]) - F.col(b[0])) + \
           (F.col(a[1]) - F.col(b[1])) * (F.col(a[1]) - F.col(b[1]))


def grid_join(points: DataFrame, zones: DataFrame, radius: float, keys: Sequence[str] = ("stand",),
              at: Sequence[str] = ("x", "y"), to: Sequence[str] = ("cx", "cy"),
              limit: Column | None = None) -> DataFrame:
    """Pairs (point, zone) no farther apart than ``radius`` (or the per-zone ``limit`` <= radius).

    ``zones`` is the side copied over neighbouring cells, so it should be the smaller one; it must
    not share column names with ``points`` except ``keys``.  Adds ``d2``.

    Both sides are dealt by cell and none is broadcast: files look small enough to broadcast while the
    copies made of their rows are many.
    """
    left = points.withColumn("gx", cell(at[0], radius)).withColumn("gy", cell(at[1], radius))
    right = spread(zones, cell(to[0], radius), cell(to[1], radius), 1).hint("merge")
    r = F.lit(float(radius)) if limit is None else limit
    out = left.join(right, [*keys, "gx", "gy"], "inner").withColumn("d2", _dist2(at, to))
    return out.where(F.col("d2") <= r * r).drop("gx", "gy")


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, pid: Sequence[str], tid: str,
                   keys: Sequence[str] = ("stand",), at: Sequence[str] = ("x", "y"),
                   to: Sequence[str] = ("cx", "cy")) -> DataFrame:
    """``pid`` + nearest target id + squared distance for points with a target inside ``radius``."""
    pairs = grid_join(points.select(*dict.fromkeys([*keys, *pid, *at])),
                      targets.select(*dict.fromkeys([*keys, tid, *to])), radius, keys, at, to)
    best = pairs.groupBy(*dict.fromkeys([*keys, *pid])).agg(F.min(F.struct("d2", tid)).alias("__m"))
    return best.select(*dict.fromkeys([*keys, *pid]), F.col(f"__m.{tid}").alias(tid), F.col("__m.d2").alias("d2"))


def start_side(points: DataFrame, keys: Sequence[str], at: Sequence[str], side: float, most: int = 128) -> float:
    """Halve ``side`` until no grid cell holds more than ``most`` distinct positions."""
    for _ in range(30):
        full = (points.groupBy(*keys, cell(at[0], side).alias("a"), cell(at[1], side).alias("b"))
                .count().agg(F.max("count")).first()[0])
        if full is None or full <= most:
            return side
        side /= 2.0
    return side


def nearest(points: DataFrame, targets: DataFrame, pid: str, tid: str, side: float,
            keys: Sequence[str] = ("stand",), at: Sequence[str] = ("x", "y"),
            to: Sequence[str] = ("cx", "cy")) -> DataFrame:
    """Nearest target of every point at any distance: search radius doubles for the unmatched rest.

    A point whose key has no target at all is left out (as in an inner join).
    """
    have = targets.select(*keys).distinct()
    first = cut(points.select(*dict.fromkeys([*keys, pid, *at])).join(have, list(keys), "left_semi"))
    left = first.count()
    rest, found = first, None
    while left:
        hit = cut(nearest_within(rest, targets, side, [pid], tid, keys, at, to))
        found = hit if found is None else found.unionByName(hit)
        left -= hit.count()
        rest = rest.join(hit.select(*keys, pid).hint("merge"), [*keys, pid], "left_anti")
        side *= 2.0
    return found if found is not None else nearest_within(first, targets, side, [pid], tid, keys, at, to)


def self_neighbours(points: DataFrame, pid: str, k: int, side: float, keys: Sequence[str] = ("stand",),
                    at: Sequence[str] = ("x", "y")) -> DataFrame:
    """The ``k`` nearest other rows of each row by ``(d2, id)``: keys, pid, nb, rank, d2.

    Rounds with doubling radius; a row is settled once ``k`` neighbours lie inside the searched
    radius or its key is exhausted.  The first radius is shrunk until cells are sparse.
    """
    from pyspark.sql import Window as W

    base = cut(points.select(*keys, pid, *at))
    side = start_side(base.select(*keys, *at).distinct(), keys, at, side)
    other = base.select(*keys, F.col(pid).alias("nb"), F.col(at[0]).alias("nx"), F.col(at[1]).alias("ny"))
    sizes = base.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("__others"))
    todo = base.join(sizes, list(keys), "left")  # joins by row id are merge joins: a few MB of file can be many rows
    done = None
    todo = todo.where(F.col("__others") > 0)
    left = todo.count()
    best = W.partitionBy(*keys, pid).orderBy("d2", "nb")
    got = F.count(F.lit(1)).over(W.partitionBy(*keys, pid))
    while True:
        pairs = grid_join(other, todo.withColumnRenamed(at[0], "cx").withColumnRenamed(at[1], "cy"),
                          side, keys, ("nx", "ny"), ("cx", "cy")).where(F.col("nb") != F.col(pid))
        top = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        full = top.withColumn("__g", got).where((F.col("__g") >= k) | (F.col("__g") >= F.col("__others")))
        hit = cut(full.select(*keys, pid, "nb", "rank", "d2"))
        done = hit if done is None else done.unionByName(hit)
        mine = hit.where("rank = 1").select(*keys, pid)
        left -= mine.count()
        if left <= 0:
            return done
        todo = todo.join(mine.hint("merge"), [*keys, pid], "left_anti")
        side *= 2.0


def nn_distance(points: DataFrame, pid: str, side: float, keys: Sequence[str] = ("stand",),
                at: Sequence[str] = ("x", "y")) -> DataFrame:
    """Distance of each row to its nearest other row of the same key.

    Rows sharing a position are answered by a count (distance zero), so copies form no pairs.
    """
    spots = points.groupBy(*keys, *at).agg(F.count(F.lit(1)).alias("__c"), F.min(pid).alias("__id"))
    single = spots.where("__c = 1").select(*keys, F.col("__id").alias(pid), F.lit(0).alias("__own"), *at)
    every = spots.select(*keys, F.col("__id").alias(pid), *at)
    near = self_neighbours(every, pid, 1, side, keys, at).select(*keys, pid, F.sqrt("d2").alias("nn"))
    lone = single.join(near.hint("merge"), [*keys, pid]).select(*keys, *at, "nn")
    copies = spots.where("__c > 1").select(*keys, *at, F.lit(0.0).alias("nn"))
    return points.join(lone.unionByName(copies).hint("merge"), [*keys, *at])


def close_pairs(points: DataFrame, pid: str, radius: float, keys: Sequence[str] = ("stand",),
                at: Sequence[str] = ("x", "y")) -> DataFrame:
    """Unordered pairs strictly closer than ``radius``: ``a < b`` and ``d2``."""
    a = points.select(*keys, F.col(pid).alias("a"), F.col(at[0]).alias("ax"), F.col(at[1]).alias("ay"))
    b = points.select(*keys, F.col(pid).alias("b"), F.col(at[0]).alias("bx"), F.col(at[1]).alias("by"))
    return (grid_join(b, a, radius, keys, ("bx", "by"), ("ax", "ay"))
            .where((F.col("a") < F.col("b")) & (F.col("d2") < radius * radius)))
