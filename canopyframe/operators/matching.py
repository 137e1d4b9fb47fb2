"""One-to-one matching of detections to references under a distance cap.

The optimum (most pairs, then least total distance) splits over the connected components of the
candidate graph.  Spark finds the candidate edges on the grid; each task then finds the components of whole keys
and solves their small sparse problems. Only keys with more than ``KEY_EDGES`` edges have their components
found by joins.
"""
from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from canopyframe.operators.components import components, labels
from canopyframe.operators.spatial import grid_join
from canopyframe.session import cut

EDGES_PER_TASK = 20000
KEY_EDGES = 1 << 18


def solve_component(left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Positions of the chosen edges: shortest augmenting paths, least-cost maximum matching."""
    lu, li = np.unique(left, return_inverse=True)
    ru, ri = np.unique(right, return_inverse=True)
    if len(lu) == 1 or len(ru) == 1:  # one pair at most: the nearest
        return np.lexsort((right, left, cost))[:1]
    adj: list[list[tuple[int, float, int]]] = [[] for _ in lu]
    for k, (i, j, c) in enumerate(zip(li, ri, cost)):
        adj[i].append((j, float(c), k))
    mate_l, mate_r = [-1] * len(lu), [-1] * len(ru)
    edge_l = [-1] * len(lu)
    pot_l, pot_r = [0.0] * len(lu), [0.0] * len(ru)
    while True:
        dist = [np.inf] * len(ru)
        via = [-1] * len(ru)
        via_edge = [-1] * len(ru)
        dl = [np.inf] * len(lu)
        heap: list[tuple[float, int, int]] = []
        for i in range(len(lu)):
            if mate_l[i] < 0:
                dl[i] = 0.0
                heapq.heappush(heap, (0.0, 0, i))
        settled = [False] * len(ru)
        end, best = -1, np.inf
        while heap:
            d, side, v = heapq.heappop(heap)
            if d >= best:
                break
            if side == 0:
                if d > dl[v]:
                    continue
                for j, c, k in adj[v]:
                    if j == mate_l[v]:
                        continue
                    nd = d + max(c + pot_l[v] - pot_r[j], 0.0)
                    if nd < dist[j]:
                        dist[j], via[j], via_edge[j] = nd, v, k
                        heapq.heappush(heap, (nd, 1, j))
            else:
                if settled[v] or d > dist[v]:
                    continue
                settled[v] = True
                if mate_r[v] < 0:
                    end, best = v, d
                    break
                i = mate_r[v]
                if d < dl[i]:
                    dl[i] = d
                    heapq.heappush(heap, (d, 0, i))
        if end < 0:
            break
        for i in range(len(lu)):
            pot_l[i] += min(dl[i], best)
        for j in range(len(ru)):
            pot_r[j] += min(dist[j], best)
        j = end
        while j >= 0:
            i, k = via[j], via_edge[j]
            prev = mate_l[i]
            mate_l[i], mate_r[j], edge_l[i] = j, i, k
            j = prev
    return np.array([k for k in edge_l if k >= 0], dtype=int)


def _solve(batch: pd.DataFrame) -> pd.DataFrame:
    if "comp" not in batch:
        node, comp = labels(batch["aid"].to_numpy(), batch["bid"].to_numpy())
        batch = batch.assign(comp=comp[np.searchsorted(node, batch["aid"].to_numpy())])
    batch = batch.sort_values(["comp", "aid", "bid"], kind="stable").reset_index(drop=True)
    comp = batch["comp"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, comp[1:] != comp[:-1], True])
    a, b, d = batch["aid"].to_numpy(), batch["bid"].to_numpy(), batch["d"].to_numpy()
    chosen = [s + solve_component(a[s:e], b[s:e], d[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
    return batch.loc[np.concatenate(chosen) if chosen else []].drop(columns=["comp", "task"])


def match(ref: DataFrame, pred: DataFrame, cap: float, keys: Sequence[str] = ("stand",),
          rid: str = "rid", did: str = "did", limit: str | None = None) -> DataFrame:
    """Chosen pairs ``keys, rid, did, d`` between ``ref(rid, rx, ry)`` and ``pred(did, x, y)``.

    ``cap`` bounds the distance; ``limit`` may name a per-row column of ``ref`` with smaller caps.
    Ids must be unique inside a key.
    """
    ks = list(keys)
    lim = F.col(limit) if limit else None
    edges = grid_join(pred.select(*ks, did, "x", "y"), ref.select(*ks, rid, "rx", "ry", *([limit] if limit else [])),
                      cap, ks, ("x", "y"), ("rx", "ry"), lim)
    edges = cut(edges.select(*ks, rid, did, F.sqrt("d2").alias("d"),
                             F.xxhash64(F.lit("r"), *ks, rid).alias("aid"), F.xxhash64(F.lit("p"), *ks, did).alias("bid")))
    tasks = max(1, edges.count() // EDGES_PER_TASK + 8)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema.fields)

    def solved(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("task", F.pmod(F.xxhash64(*by), F.lit(tasks)).cast("int")).groupBy("task").applyInPandas(_solve, shape).select(*ks, rid, did, "d")

    crowded = cut(edges.groupBy(*ks).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > KEY_EDGES).drop("__c"))
    if crowded.isEmpty():
        return solved(edges, *ks)
    large = cut(edges.join(crowded, ks, "left_semi"))
    comp = components(large, "aid", "bid")
    return (solved(edges.join(crowded, ks, "left_anti"), *ks)
            .unionByName(solved(large.join(comp.withColumnRenamed("node", "aid"), "aid"), "comp")))


def match_counts(ref: DataFrame, pred: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``tp, n_ref, n_pred, rmse`` per key, zeros kept for keys without pairs."""
    ks = list(keys)
    r = ref.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_ref"))
    p = pred.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_pred"))
    t = pairs.groupBy(*ks).agg(F.count(F.lit(1)).alias("tp"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    return r.join(p, ks, "full").join(t, ks, "left").na.fill(0, ["n_ref", "n_pred", "tp"])


def greedy_in_order(cand: DataFrame, order: str, target: str, dist: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each row of ``order`` (ascending) takes its nearest target not taken by an earlier one.

    Rounds on the candidate edges: a row is settled when its nearest free target is wanted by no
    earlier unsettled row, which reproduces the sequential rule.
    """
    ks = list(keys)
    live = cut(cand.select(*ks, order, target, dist))
    done = None
    while True:
        want = live.groupBy(*ks, order).agg(F.min(F.struct(dist, target)).alias("m")) \
            .select(*ks, order, F.col(f"m.{target}").alias(target), F.col(f"m.{dist}").alias(dist))
        first = live.groupBy(*ks, target).agg(F.min(order).alias("__first"))
        hit = cut(want.join(first, [*ks, target]).where(F.col("__first") == F.col(order)).drop("__first"))
        done = hit if done is None else done.unionByName(hit)
        live = cut(live.join(hit.select(*ks, order), [*ks, order], "left_anti")
                   .join(hit.select(*ks, target), [*ks, target], "left_anti"))
        if live.isEmpty():
            return done
