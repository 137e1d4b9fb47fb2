"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte pairs of the whole text (case and punctuation count) and a few counts of repetition: words equal to the one before,
repeated words and repeated lines. A document is the vector of its terms' dampened counts times inverse document frequencies over all
documents. A truncated singular value decomposition of the labelled vectors gives ``RANK`` latent axes; every document is projected on them and
normalised. Its cosines with all labelled vectors are computed exactly, in blocks of documents, and its score is the mean
label of its ``NEIGHBOURS`` nearest ones, each weighted by a power of its similarity, with the labels' mean as a weak prior.

Labels come only from rows the caller marks as learnable; at most ``FIT_ROWS`` of them are used (smallest hashed ids, near
copies once), so what is broadcast is at most ``FIT_ROWS * RANK`` numbers of 4 bytes (1 MB) and the projection (0.5 MB). Document
frequencies cover all documents; scores all whole texts.

Defined cases: null and empty texts have no terms and get the labels' mean (``PRIOR`` without labels); without learnable labels every
score is ``PRIOR``; repeated rows get equal scores; a repeated label takes the larger value; ties between
neighbours at the last place are all taken.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from canopyframe.llm.common import SPACES, Words, mix, separators, slices
from canopyframe.llm.toxicity import training_rows, with_score
from canopyframe.session import cut

FIT_ROWS = 4_000
RANK = 48
TERMS = 2_048
EXTRA = 4
NEIGHBOURS = 24
POWER = 8
PRIOR = 0.5
BLOCK = 64
LINES = separators(b"\n")
_PAIRS = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(TERMS)).astype(np.int64)


def terms(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Dampened term counts per row; a row's counts are relative to its length, so texts of any length compare."""
    n, width = len(offs) - 1, TERMS + EXTRA
    size = np.diff(offs)
    pair = _PAIRS[(data[:-1].astype(np.int64) << 8) | data[1:]] if len(data) > 1 else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), size)
    inside = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    counts = np.bincount(row[:-1][inside] * TERMS + pair[inside], minlength=n * TERMS).reshape(n, TERMS)[:, :TERMS]
    out = np.zeros((n, width), dtype=np.float32)
    out[:, :TERMS] = np.log1p(counts * (1000.0 / np.maximum(size, 1))[:, None])
    w = Words(data, offs, SPACES)
    h, words = w.hashes(), np.diff(w.bound)
    again = np.bincount(w.row[1:][(h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])], minlength=n) if len(h) else np.zeros(n)
    distinct = _distinct(h, w.row, n)
    lines = Words(data, offs, LINES)
    kinds = _distinct(lines.hashes(), lines.row, n)
    many = np.maximum(words, 1)
    out[:, TERMS] = 4 * again / many
    out[:, TERMS + 1] = 4 * np.clip(1 - distinct / many - 0.5, 0, 1)
    out[:, TERMS + 2] = 4 * (1 - kinds / np.maximum(np.diff(lines.bound), 1)) * (words > 0)
    out[:, TERMS + 3] = 4 * (1 / np.sqrt(many)) * (words > 0)
    return out


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=n)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, float]:
    """In how many documents each term occurs, and how many documents there are."""
    width = TERMS + EXTRA + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            for i, j, data, offs in _small(b.column(0)):
                total[:-1] += (terms(data, offs) > 0).sum(axis=0)
                total[-1] += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["cell", "v"])

    out = np.zeros(width)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r.cell] = r.v
    return out[:-1], out[-1]


def _small(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of at most ``BLOCK`` rows."""
    for i, _, data, offs in slices(texts):
        for a in range(0, len(offs) - 1, BLOCK):
            o = offs[a: a + BLOCK + 1]
            yield i + a, i + a + len(o) - 1, data[o[0]: o[-1]], o - o[0]


@dataclass
class Model:
    inverse: np.ndarray
    axes: np.ndarray
    known: np.ndarray
    labels: np.ndarray
    prior: float

    def place(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.inverse) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Scores of a block of term vectors."""
        cos = self.place(x) @ self.known.T
        k = min(NEIGHBOURS, cos.shape[1])
        last = np.partition(cos, cos.shape[1] - k, axis=1)[:, [cos.shape[1] - k]]
        weight = np.where(cos >= last, np.maximum(cos, 0), 0) ** POWER
        return (weight @ self.labels + 0.5 * self.prior) / (weight.sum(axis=1) + 0.5)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.full(len(offs) - 1, self.prior)
        if not len(self.known):
            return out
        for a in range(0, len(out), BLOCK):
            o = offs[a: a + BLOCK + 1]
            some = np.flatnonzero(np.diff(o) > 0)
            if len(some):
                out[a + some] = self.vote(terms(data[o[0]: o[-1]], o - o[0])[some])
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "quality", rows: int = FIT_ROWS) -> Model:
    sample = cut(training_rows(docs, labels, learn, target, rows))
    df, n = frequencies(docs)
    inverse = np.concatenate([np.log((n + 1) / (df[:TERMS] + 1)) + 0.1, np.ones(EXTRA)]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in _small(b.column(0)):
                x = terms(data, offs).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    local = sample.where("length(text) > 0").mapInArrow(run, "y int, x binary").toPandas()
    if not len(local):
        return Model(inverse, np.zeros((TERMS + EXTRA, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), PRIOR)
    y = local["y"].to_numpy(dtype=np.float32)
    x = np.frombuffer(b"".join(local["x"]), dtype=np.float32).reshape(len(y), TERMS + EXTRA) * inverse
    axes = latent_axes(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))
    model = Model(inverse, axes, np.zeros((0, axes.shape[1]), np.float32), y, float(y.mean()))
    model.known = model.place(x / inverse).astype(np.float32)
    return model


def latent_axes(x: np.ndarray, rank: int = RANK, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(rank + 8, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the similarity-weighted label of the nearest labelled documents."""
    docs = docs.drop(name)
    return with_score(docs, docs.sparkSession.sparkContext.broadcast(model), name)
