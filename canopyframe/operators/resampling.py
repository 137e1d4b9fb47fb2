"""Replicates of small tables without a shuffle of replicated rows.

A field campaign's table is small and its replicates are many. Up to ``LOCAL_BYTES`` the table is broadcast and whole replicates are dealt to
tasks, so what follows by replicate is added up where the replicate was drawn and each sends one row. Draws are the same hashes of (replicate,
position, seed) as those of larger tables, whose replicates are joins (see ``panel``).
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canopyframe.functions.hashing import MODULUS
from canopyframe.session import cut

LOCAL_BYTES = 32 << 20
ROWS = 65536  # of a batch
# The weights of ``functions.hashing.mix``.
WEIGHTS = (1000003, 7919, 104729, 15485863)


def mix(*parts: np.ndarray | int) -> np.ndarray:
    """``functions.hashing.mix`` of up to four integers."""
    h = sum(np.fmod(np.asarray(p, dtype=np.int64), MODULUS) * w for p, w in zip(parts, WEIGHTS)) + 12345
    h = np.fmod(h, MODULUS)
    for _ in range(2):
        h = np.fmod(np.fmod(h * h, MODULUS) * 48271 + 11, MODULUS)
    return h


def small(df: DataFrame) -> tuple[DataFrame, pa.Table | None]:
    """``df`` written as a table, and its rows if they are few enough to broadcast."""
    d = cut(df)
    width = sum(8 if t not in ("string", "binary") else 64 for _, t in d.dtypes)
    return d, d.toArrow() if d.count() * width <= LOCAL_BYTES else None


def _groups(t: pa.Table, keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows of each combination of keys."""
    if not keys:
        yield t
        return
    codes = np.zeros(len(t), dtype=np.int64)
    for k in keys:
        c = t[k].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes * (len(c.dictionary) + 1) + c.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0, True]) if len(t) else np.array([0])
    for a, b in zip(ends[:-1], ends[1:]):
        yield t.take(pa.array(order[a:b]))


def _sorted(t: pa.Table, order: str) -> pa.Table:
    return t.sort_by([(order, "ascending")]).combine_chunks()


def _deal(spark, reps: int):
    return spark.range(0, reps, 1, max(1, min(reps, 2 * spark.sparkContext.defaultParallelism)))


def bootstrap(d: DataFrame, t: pa.Table, order: str, reps: int, seed: int, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys, rep, w, values``: rows drawn with replacement, ``w`` times each."""
    spark, names = d.sparkSession, [*keys, *values]
    shared = spark.sparkContext.broadcast([_sorted(g, order).select(names) for g in _groups(t, keys)])

    def run(batches):
        for b in batches:
            for rep in b.column(0).to_pylist():
                for g in shared.value:
                    n = len(g)
                    w = np.bincount(mix(rep, np.arange(n), seed) % n, minlength=n)
                    at = pa.array(np.flatnonzero(w))
                    cols = [g[c].combine_chunks().take(at) for c in names]
                    yield pa.RecordBatch.from_arrays([*cols[: len(keys)], pa.array(np.full(len(at), rep, dtype=np.int32)), pa.array(w[w > 0]), *cols[len(keys):]], [*keys, "rep", "w", *values])

    kinds = dict(d.dtypes)
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "rep int, w long", *(f"`{v}` {kinds[v]}" for v in values)])
    return _deal(spark, reps).mapInArrow(run, shape)


def bootstrap_sums(d: DataFrame, t: pa.Table, order: str, reps: int, seed: int, values: Sequence[str]) -> DataFrame:
    """``rep, w, values``: of each resample of ``bootstrap`` its rows and the sums of ``values`` over them."""
    spark = d.sparkSession
    shared = spark.sparkContext.broadcast([_sorted(t, order)[v].combine_chunks().to_numpy(zero_copy_only=False) for v in values])

    def run(batches):
        for b in batches:
            whole = b.column(0).to_pylist()
            got = []
            for rep in whole:
                w = np.bincount(mix(rep, np.arange(n), seed) % n, minlength=n) if n else np.zeros(0, dtype=np.int64)
                got.append([w @ v for v in shared.value])
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.int32()), pa.array([n] * len(whole), pa.int64()), *(pa.array([g[i] for g in got], kinds[i]) for i in range(len(values)))], ["rep", "w", *values])
    n, kinds = len(t), [pa.float64() if k in ("double", "float") else pa.int64() for v in values for k in [dict(d.dtypes)[v]]]
    shape = ", ".join(["rep int, w long", *(f"`{v}` {'double' if k == pa.float64() else 'long'}" for v, k in zip(values, kinds))])
    return _deal(spark, reps).mapInArrow(run, shape)


def permuted(d: DataFrame, t: pa.Table, order: str, target: str, reps: int, seed: int, within: Sequence[str]) -> DataFrame:
    """Every row once per ``rep`` with ``target`` shuffled (inside ``within`` when given)."""
    spark = d.sparkSession
    names = [c for c in d.columns if c != target]
    groups = [_sorted(g, order) for g in _groups(t, within)]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups]) * MODULUS  # hashes are below it
    shared = spark.sparkContext.broadcast((pa.concat_tables(groups).combine_chunks() if groups else t, group))

    def run(batches):
        g, group = shared.value
        n, own = len(g), [g[c].combine_chunks() for c in names]
        moved, ids = g[target].combine_chunks(), g[order].to_numpy()
        for b in batches:
            for rep in b.column(0).to_pylist():
                # all groups in one sort: their rows stand together, so each place gets a row of its own group
                to = pa.array(np.argsort(group + mix(rep, ids, seed), kind="stable"))
                whole = [*own, pa.array(np.full(n, rep, dtype=np.int32)), moved.take(to)]
                for at in range(0, n, ROWS):
                    yield pa.RecordBatch.from_arrays([c.slice(at, ROWS) for c in whole], [*names, "rep", target])

    kinds = dict(d.dtypes)
    return _deal(spark, reps).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "rep int", f"`{target}` {kinds[target]}"]))
