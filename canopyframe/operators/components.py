"""Connected components: one task for a small graph, alternating star contraction (joins and min-aggregates only) for a large one."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from canopyframe.session import cut, free

#: distinct edges (of two longs) that one task may hold: 16 MB
TASK_EDGES = 1 << 20


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges and the smallest node of each one's component, by least labels and shortened paths."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    low = np.arange(len(nodes))
    while True:
        was = low.copy()
        least = np.minimum(low[a], low[b])
        # a label's own label goes down with it, so whole components move at once
        for x in (low[a], low[b], a, b):
            np.minimum.at(low, x, least)
        while True:
            short = low[low]
            if (short == low).all():
                break
            low = short
        if (low == was).all():
            return nodes, nodes[low]


def _in_one_task(e: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            node, comp = labels(*(np.concatenate(x).astype(np.int64) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(comp)], ["node", "comp"])

    kind = dict(e.dtypes)["u"]
    return e.select("u", "v").coalesce(1).mapInArrow(run, "node long, comp long").select(F.col("node").cast(kind), F.col("comp").cast(kind))


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, comp`` for every node of the undirected ``edges``; ``comp`` is the smallest node id.

    Up to ``task_edges`` distinct edges between integers are joined by one task. Of more, each round joins every node's neighbours with the least of
    them: neighbours of a node meet by its id, where Spark splits the partitions of such a join that are too large.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    if dict(e.dtypes)["u"] in ("bigint", "int") and e.count() <= task_edges:
        return cut(_in_one_task(e))
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        big = big.where("u <> v")
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low2, "u")
        old, e = e, cut(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        free(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    roots = e.select(F.col("v").alias("node")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return out.unionByName(roots.select("node", F.col("node").alias("comp")))
