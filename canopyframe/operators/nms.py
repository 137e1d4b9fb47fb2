"""Exact greedy suppression of nearby detections in blocks with halos.

The greedy result (heaviest first, keep a detection if no kept one lies within ``r``) is the first
maximal independent set in the order ``(weight desc, id asc)``. A task runs that rule on a block of
``BLOCK`` radii with copies of the rows within ``r`` around it: a row is out if a heavier kept row is near,
kept if all heavier rows near it are out, and else waits for its neighbour blocks. A round settles whatever
a block can settle by itself, so the number of rounds follows how often chains of falling weights cross blocks, not their length.

With cells of side ``r / sqrt(2)`` any two rows of one cell suppress each other, so at most one is kept. Of a
cell with more than ``CROWD`` rows only the heaviest ``CROWD`` contest at first, and lighter rows of other cells near it
wait; the rest of the cell goes once one of its rows is kept. A block so holds a bounded number of rows even when most of a table lies on one spot.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from canopyframe.operators.spatial import spread
from canopyframe.session import cut, free

BLOCK = 32
PAIRS = 1 << 21  # near pairs held at once
TASK_ROWS = 50_000  # of the blocks settled together
CROWD = 64
SALTED = 10_000  # rows of a cell ranked by one task
WAITS, KEPT, OUT = 0, 1, 2


def _by_pairs(state: np.ndarray, own: np.ndarray, heavy: np.ndarray, light: np.ndarray) -> np.ndarray:
    """Blocks without walls from the near pairs of rows in the rule's order: whatever has no undecided heavier row near it is decided at once."""
    state, n, open_ = state.copy(), len(state), state == WAITS
    keep = open_[light] & (state[heavy] != OUT)
    heavy, light = heavy[keep], light[keep]
    while open_.any():
        out = np.zeros(n, dtype=bool)
        out[light[state[heavy] == KEPT]] = True  # kept rows are never open
        held, blocked = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        held[light[open_[heavy]]] = True
        blocked[light[(state[heavy] == WAITS) & ~open_[heavy]]] = True
        state[open_ & out] = OUT
        free_ = open_ & ~out & ~held
        state[free_ & ~blocked & own] = KEPT
        open_ &= held & ~out
        keep = open_[light] & (state[heavy] != OUT)
        heavy, light = heavy[keep], light[keep]
    return state


def settle(x: np.ndarray, y: np.ndarray, w: np.ndarray, ids: np.ndarray, r: float, state: np.ndarray, own: np.ndarray, walls: list[tuple[float, int, float, float]]) -> np.ndarray:
    """States of a block's rows (``own``) and of those around it after the sequential rule; what is around may have heavier rows near it that aren't seen
    here, so it can be found out but not kept. ``walls`` are crowded cells: weight and id of their lightest contestant, low corner."""
    order = np.lexsort((ids, -w))
    state, r2, side = state.copy(), r * r, r * 0.7071067
    grid: dict[tuple[int, int], list[int]] = {}  # kept and waiting rows by cells of side r
    taken: set[tuple[int, int]] = set()  # cells with a kept row
    cx, cy = np.floor(x / r).astype(np.int64), np.floor(y / r).astype(np.int64)
    sx, sy = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
    for i in order:
        xi, yi, now = x[i], y[i], state[i]
        if now == WAITS:
            now = KEPT
            for a in (cx[i] - 1, cx[i], cx[i] + 1):
                for b in (cy[i] - 1, cy[i], cy[i] + 1):
                    for j in grid.get((a, b), ()):
                        if (x[j] - xi) ** 2 + (y[j] - yi) ** 2 <= r2:
                            if state[j] == KEPT:
                                now = OUT
                                break
                            now = WAITS
                    if now == OUT:
                        break
                if now == OUT:
                    break
            if now == KEPT:
                for tw, tid, lx, ly in walls:
                    if (w[i], -ids[i]) < (tw, -tid) and (int(round(lx / side)), int(round(ly / side))) not in taken:
                        dx, dy = max(lx - xi, 0.0, xi - lx - side), max(ly - yi, 0.0, yi - ly - side)
                        if dx * dx + dy * dy <= r2 * 1.0001:
                            now = WAITS
                            break
            if now == KEPT and not own[i]:
                now = WAITS
            state[i] = now
        if now != OUT:
            grid.setdefault((cx[i], cy[i]), []).append(i)
            if now == KEPT:
                taken.add((sx[i], sy[i]))
    return state


def settle_blocks(g: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, ids: np.ndarray, r: np.ndarray, bx: np.ndarray, by: np.ndarray, state: np.ndarray, own: np.ndarray,
                  walls: dict[int, list[tuple[float, int, float, float]]]) -> np.ndarray:
    """:func:`settle` of many blocks (numbered ``g``) by array operations on at most ``PAIRS`` near pairs at a time; row by row only beside walls,
    where one block has more pairs, and where a place is undefined."""
    if not len(g):
        return state.copy()
    order = np.lexsort((ids, -w, g))
    g, x, y, w, ids, r, bx, by, state, own = (c[order] for c in (g, x, y, w, ids, r, bx, by, state, own))
    blocks, wide = int(g[-1]) + 1, BLOCK + 8
    ends = np.searchsorted(g, np.arange(blocks + 1))
    slow = np.zeros(blocks, dtype=bool)
    slow[list(walls)] = True
    with np.errstate(invalid="ignore"):
        cx, cy = np.floor(x / r) - bx * float(BLOCK) + 4, np.floor(y / r) - by * float(BLOCK) + 4
        odd = ~((cx >= 1) & (cx < wide - 1) & (cy >= 1) & (cy < wide - 1))
    slow[g[odd]] = True
    at = np.flatnonzero(~slow[g])
    code = (g[at] * wide + cx[at].astype(np.int64)) * wide + cy[at].astype(np.int64)
    sort = np.argsort(code, kind="stable")
    at, code = at[sort], code[sort]
    here = np.arange(len(at))
    # the rest of the own cell with the cell above, then the three cells of the next column
    spans = [(here + 1, np.searchsorted(code, code + 1, "right")), (np.searchsorted(code, code + wide - 1, "left"), np.searchsorted(code, code + wide + 1, "right"))]
    many = np.bincount(g[at], sum((hi - lo for lo, hi in spans), np.zeros(len(at))), blocks)
    slow |= many > PAIRS
    chunk = np.cumsum(np.where(slow, 0, many)) // PAIRS
    after = state.copy()
    for c in np.unique(chunk[~slow]):
        mine = np.zeros(blocks, dtype=bool)
        mine[(chunk == c) & ~slow] = True
        use, found = mine[g[at]], []
        for lo, hi in spans:
            n = (hi - lo)[use]
            first = np.repeat(here[use], n)
            found.append((at[first], at[np.arange(len(first)) - np.repeat(n.cumsum() - n, n) + np.repeat(lo[use], n)]))
        a, b = (np.concatenate(z) for z in zip(*found))
        near = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= r[a] * r[a]
        a, b = a[near], b[near]
        rows = np.flatnonzero(mine[g])
        new = np.zeros(len(g), dtype=np.int64)
        new[rows] = np.arange(len(rows))
        after[rows] = _by_pairs(state[rows], own[rows], new[np.minimum(a, b)], new[np.maximum(a, b)])
    for i in np.flatnonzero(slow):
        z = slice(ends[i], ends[i + 1])
        if z.start < z.stop:
            after[z] = settle(x[z], y[z], w[z], ids[z], float(r[z.start]), state[z], own[z], walls.get(int(i), []))
    out = np.empty_like(after)
    out[order] = after
    return out


_ROW = ["id", "w", "x", "y", "r", "state"]
_SHAPE = "id long, w double, x double, y double, r double, state int"


def _resolve(rows: DataFrame, walls: DataFrame | None, ks: list[str]) -> DataFrame:
    """``rows`` (ks and ``_ROW``) with their states, until a round settles nothing more; only rows still near a waiting one move again."""
    kinds = dict(rows.dtypes)
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in ks), _SHAPE])

    def run(t: pa.Table) -> pa.Table:
        wall = t["wall"].to_numpy(zero_copy_only=False).astype(bool)
        a, fence = t.filter(pa.array(~wall)), t.filter(pa.array(wall))
        own, state = a["own"].to_numpy(zero_copy_only=False).astype(bool), a["state"].to_numpy()
        send = own & (state == WAITS)  # kept rows of earlier rounds are not sent on again
        names, g = np.unique(a["block"].to_numpy(), return_inverse=True)
        walls: dict[int, list] = {}
        for v in fence.select(["block", "w", "id", "x", "y"]).to_pylist():
            i = int(np.searchsorted(names, v["block"]))
            if i < len(names) and names[i] == v["block"]:
                walls.setdefault(i, []).append((v["w"], v["id"], v["x"], v["y"]))
        x, y, w, ids, r, bx, by = (a[c].to_numpy() for c in ("x", "y", "w", "id", "r", "bx", "by"))
        after = settle_blocks(g, x, y, w, ids, r, bx, by, state, own, walls)
        out = a.select([*ks, *_ROW]).filter(pa.array(send))
        return out.set_column(out.schema.get_field_index("state"), "state", pa.array(after[send].astype(np.int32)))

    side = F.col("r") * BLOCK
    near = F.array_distinct(F.array(*[F.struct(F.floor((F.col("x") + i * F.col("r")) / side).alias("bx"), F.floor((F.col("y") + j * F.col("r")) / side).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    mine = F.struct(F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by"))
    fences = None if walls is None else walls.select(*ks, *_ROW, F.explode(F.array_distinct(F.array(*[
        F.struct(F.floor((F.col("x") + a) / side).alias("bx"), F.floor((F.col("y") + b) / side).alias("by")) for a in (-F.col("r"), F.lit(0.0), 2 * F.col("r")) for b in (-F.col("r"), F.lit(0.0), 2 * F.col("r"))]))).alias("b"),
        F.lit(False).alias("own"), F.lit(True).alias("wall"))
    live, settled, waiting = rows, None, None
    while True:
        spread_ = live.select(*ks, *_ROW, mine.alias("m"), F.explode(near).alias("b"))
        spread_ = spread_.select(*ks, *_ROW, "b", (F.col("b") == F.col("m")).alias("own"), F.lit(False).alias("wall"))
        if fences is not None:
            spread_ = spread_.unionByName(fences)
        tasks = live.count() // TASK_ROWS + 8
        dealt = spread_.select("*", F.col("b.bx").alias("bx"), F.col("b.by").alias("by"), F.xxhash64(*ks, "r", "b.bx", "b.by").alias("block")).drop("b")
        new = cut(dealt.groupBy(F.pmod("block", F.lit(tasks)).alias("task")).applyInArrow(run, shape))
        settled = new.where(F.col("state") != WAITS) if settled is None else settled.unionByName(new.where(F.col("state") != WAITS))
        left = new.where(F.col("state") == WAITS)
        before, waiting = waiting, left.count()
        if not waiting or waiting == before:
            return settled.unionByName(left)
        live = settled.where(F.col("state") == KEPT).unionByName(left)


def _without_near(live: DataFrame, kept: DataFrame, ks: list[str]) -> DataFrame:
    """``live`` without the rows within reach of a kept one."""
    side = F.col("r") * F.lit(0.7071067)
    cells = live.withColumns({"gx": F.floor(F.col("x") / side).cast("bigint"), "gy": F.floor(F.col("y") / side).cast("bigint")})
    reach = kept.select(*[F.col(k).alias(f"_{k}") for k in [*ks, "r", "x", "y"]])
    reach = spread(reach, F.floor(F.col("_x") / (F.col("_r") * F.lit(0.7071067))), F.floor(F.col("_y") / (F.col("_r") * F.lit(0.7071067))), 2).withColumnsRenamed({"gx": "_gx", "gy": "_gy"})
    same = (F.col("gx") == F.col("_gx")) & (F.col("gy") == F.col("_gy")) & (F.col("r") == F.col("_r"))
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    d2 = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))
    return cells.join(reach, same & (d2 <= F.col("r") * F.col("r")), "left_anti").drop("gx", "gy")


def nms(points: DataFrame, pid: str, weight: str, radius: float | str, keys: Sequence[str] = ("stand",),
        at: Sequence[str] = ("x", "y"), crowd: int = CROWD) -> DataFrame:
    """``keys, pid`` of the kept rows.  ``radius`` is a number or the name of a per-key column."""
    r: Column = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    ks, kind = list(keys), dict(points.dtypes)[pid]
    live = cut(points.select(*ks, F.col(pid).cast("long").alias("id"), F.coalesce(F.col(weight).cast("double"), F.lit(float("-inf"))).alias("w"), F.col(at[0]).cast("double").alias("x"),
                             F.col(at[1]).cast("double").alias("y"), r.cast("double").alias("r"), F.lit(WAITS).alias("state")))
    side = F.col("r") * F.lit(0.7071067)
    cell = [*ks, "r", "gx", "gy"]
    kept = None
    while True:
        celled = live.withColumns({"gx": F.floor(F.col("x") / side).cast("bigint"), "gy": F.floor(F.col("y") / side).cast("bigint")})
        crowds = cut(celled.groupBy(*cell).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowd))
        full = not crowds.isEmpty()
        contest, walls = live, None
        if full:
            marked = celled.join(crowds, cell, "left")
            # ranked among some rows of the cell first, then among the best of all parts
            heavy, salt = [F.desc("w"), F.asc("id")], F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / SALTED))
            top = marked.where("c is not null").withColumn("s", salt)
            top = top.withColumn("k", F.row_number().over(Window.partitionBy(*cell, "s").orderBy(*heavy))).where(F.col("k") <= crowd)
            top = cut(top.withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy(*heavy))).where(F.col("k") <= crowd))
            contest = marked.where("c is null").select(*ks, *_ROW).unionByName(top.select(*ks, *_ROW))
            walls = top.where(F.col("k") == crowd).select(*ks, "id", "w", (F.col("gx") * side).alias("x"), (F.col("gy") * side).alias("y"), "r", F.lit(WAITS).alias("state"))
        done = cut(_resolve(contest, walls, ks))
        new = done.where(F.col("state") == KEPT)
        kept = new if kept is None else kept.unionByName(new)
        if not full:
            return kept.select(*ks, F.col("id").cast(kind).alias(pid))
        out = done.where(F.col("state") != WAITS).select(*ks, "r", "id")
        old, live = live, cut(_without_near(live, new, ks).join(out, [*ks, "r", "id"], "left_anti"))
        free(old)
        if live.isEmpty():
            return kept.select(*ks, F.col("id").cast(kind).alias(pid))


def merge(points: DataFrame, pid: str, weight: str, radius: float | str, keys: Sequence[str] = ("stand",),
          at: Sequence[str] = ("x", "y")) -> DataFrame:
    """All columns of the rows kept by :func:`nms`."""
    return points.join(nms(points, pid, weight, radius, keys, at), [*keys, pid], "left_semi")
