"""Adaptive merging of tiles: per stand in batch, and causally as tiles arrive.

A session is a stand.  The batch form is joins and aggregates; the streaming form keeps one state per
stand (its nearest-neighbour distances and the kept detections) because each tile's
decisions depend on those of the tiles before it.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from canopyframe.functions.scalars import adaptive_radius
from canopyframe.operators.nms import nms
from canopyframe.operators.ranks import exact_quantiles
from canopyframe.operators.spatial import nn_distance
from canopyframe.sources.sinks import scratch

KEPT = "det_id bigint, stand int, tile_seq int, x double, y double, radius double"
CELL = 2.0


def interior(dets: DataFrame, tiles: DataFrame, half: float) -> DataFrame:
    """Detections in the inner square of their own tile (free of clipped crowns)."""
    return dets.join(tiles, ["stand", "tile_seq"]).where((F.abs(F.col("x") - F.col("tcx")) <= half) & (F.abs(F.col("y") - F.col("tcy")) <= half)).select(*dets.columns)


def stand_radius(dets: DataFrame, pid: str, tile: Sequence[str] = ("stand", "tile_seq"), fraction: float = 0.7, lo: float = 1.0, hi: float = 2.0,
                 q: float = 0.5, side: float = 4.0) -> DataFrame:
    """``stand, spacing, radius`` from the within-tile neighbour distances of all its tiles."""
    nn = nn_distance(dets, pid, side, tile)
    s = exact_quantiles(nn, ["stand"], "nn", {"spacing": q})
    s = dets.select("stand").distinct().join(s, "stand", "left")
    return s.withColumn("radius", adaptive_radius("spacing", fraction, lo, hi))


def merge_batch(dets: DataFrame, pid: str, weight: str, spacing_from: DataFrame | None = None, **kw) -> DataFrame:
    r = stand_radius(spacing_from if spacing_from is not None else dets, pid, **kw)
    d = dets.join(r, "stand")
    return d.join(nms(d, pid, weight, "radius"), ["stand", pid], "left_semi")


def causal_spacing(dets: DataFrame, pid: str, q: float = 0.5, side: float = 4.0) -> DataFrame:
    """Spacing known after each tile: percentile over the distances of this and earlier tiles."""
    nn = nn_distance(dets, pid, side, ["stand", "tile_seq"]).select("stand", F.col("tile_seq").alias("src"), "nn")
    counts = nn.groupBy("stand", "src", F.col("nn").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    tiles = dets.select("stand", "tile_seq").distinct()
    later = counts.join(tiles, "stand").where("tile_seq >= src").withColumn("d", F.explode(F.array_repeat("d", F.col("c").cast("int"))))
    return exact_quantiles(later, ["stand", "tile_seq"], "d", {"spacing": q})


def _tile_nn(xy: np.ndarray) -> np.ndarray:
    """Nearest-neighbour distances inside one tile, in blocks to bound memory."""
    if len(xy) < 2:
        return np.empty(0)
    out = []
    for s in range(0, len(xy), 256):
        b = xy[s:s + 256]
        d = np.hypot(b[:, None, 0] - xy[None, :, 0], b[:, None, 1] - xy[None, :, 1])
        d[np.arange(len(b)), s + np.arange(len(b))] = np.inf
        out.append(d.min(axis=1))
    return np.concatenate(out)


class TileMerger(StatefulProcessor):
    """Keeps a tile's detections, largest first, when none kept so far lies within the current radius."""

    def __init__(self, fraction: float = 0.7, lo: float = 1.0, hi: float = 2.0, q: float = 50.0, default: float = 1.5):
        self.fraction, self.lo, self.hi, self.q, self.default = fraction, lo, hi, q, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        # every tile needs all distances and any kept detection may be near: one read and one write a stand and batch
        self.pool = handle.getValueState("pool", "d array<double>, c array<long>")
        self.kept = handle.getValueState("kept", "xs array<double>, ys array<double>")

    def _spacing(self, d: np.ndarray, c: np.ndarray) -> float | None:
        if not len(d):
            return None
        c = np.cumsum(c)
        pos = self.q / 100 * (c[-1] - 1)
        a, b = (d[np.searchsorted(c, np.floor(pos), side="right")], d[np.searchsorted(c, np.ceil(pos), side="right")])
        return float(a + (b - a) * (pos - np.floor(pos)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows), ignore_index=True)
        dist, count = (np.array(v) for v in (self.pool.get() if self.pool.exists() else ([], [])))
        xs, ys = (list(v) for v in (self.kept.get() if self.kept.exists() else ([], [])))
        cells: dict[tuple[int, int], list[int]] = {}
        for n, (x, y) in enumerate(zip(xs, ys)):
            cells.setdefault((int(x // CELL), int(y // CELL)), []).append(n)
        out = []
        for tile, g in data.groupby("tile_seq", sort=True):
            xy = g[["x", "y"]].to_numpy(float)
            d, c = np.unique(_tile_nn(xy), return_counts=True)
            dist, at = np.unique(np.concatenate([dist, d]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([count, c]), minlength=len(dist)).astype(np.int64)
            s = self._spacing(dist, count)
            r = self.default if s is None else float(np.clip(self.fraction * s, self.lo, self.hi))
            g = g.sort_values(["size", "det_id"], ascending=[False, True])
            for det, x, y in zip(g["det_id"].tolist(), g["x"].tolist(), g["y"].tolist()):
                i, j = int(x // CELL), int(y // CELL)
                near = [n for a in (-1, 0, 1) for b in (-1, 0, 1) for n in cells.get((i + a, j + b), ())]
                if not near or np.hypot(np.array([xs[n] for n in near]) - x, np.array([ys[n] for n in near]) - y).min() > r:
                    cells.setdefault((i, j), []).append(len(xs))
                    xs.append(x)
                    ys.append(y)
                    out.append((int(det), int(key[0]), int(tile), x, y, r))
        self.pool.update((dist.tolist(), count.tolist()))
        self.kept.update((xs, ys))
        yield pd.DataFrame(out, columns=["det_id", "stand", "tile_seq", "x", "y", "radius"])

    def close(self) -> None:
        pass


def merge_stream(tiles: DataFrame, **kw) -> DataFrame:
    """Streaming rows of kept detections; ``tiles``: ``det_id, stand, tile_seq, x, y, size`` in arrival order.

    The radius may not exceed ``CELL`` metres, the side of the cells that kept detections are looked up in.
    """
    if kw.get("hi", 2.0) > CELL:
        raise ValueError(f"hi must be at most {CELL}")
    return (tiles.select("det_id", "stand", "tile_seq", "x", "y", F.col("size").cast("double")).groupBy("stand")
            .transformWithStateInPandas(statefulProcessor=TileMerger(**kw), outputStructType=KEPT, outputMode="Append", timeMode="None"))


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available into a fresh table and read it back."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path, log = scratch(spark, label), scratch(spark, label + "-log")
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def distil_stream(points: DataFrame, label: str) -> DataFrame:
    """Distil labelled tiles batch by batch.

    Each batch keeps its own parts, so a tile may arrive in any number of files and batches; a batch that runs again replaces what it wrote.
    """
    from canopyframe.sources.readers import distil_merge, distil_parts
    spark = points.sparkSession
    path, log = scratch(spark, label), scratch(spark, label + "-log")
    shape = distil_parts(points.limit(0) if not points.isStreaming else spark.createDataFrame([], points.schema))
    shape.write.parquet(f"{path}/batch=-1")

    def save(batch: DataFrame, number: int) -> None:
        distil_parts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
    q = points.writeStream.foreachBatch(save).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    return distil_merge(spark.read.option("basePath", path).parquet(path))
