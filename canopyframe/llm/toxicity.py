"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters look at words (ASCII letters and digits and all else beyond ASCII, lower-cased):

* lexicon voters hold words: a small built-in list, and words that labelled training rows show to go with the label;
* pattern voters hold word beginnings of ``PREFIXES`` bytes found in the same way (inflections and compounds), and the
  built-in list behind digits that stand for letters;
* volume voters fire on several hits at once.

The label model never sees single labels: it takes the voters' first and second moments over all documents, and explains the
covariance of two voters by how strongly each follows the label. Pairs whose covariance the label cannot explain are correlated;
they leave the fit, which is repeated, and a voter's weight shrinks with its correlations. That gives each
voter's rates under both labels, and a posterior for any votes. The classifier, a logistic regression on counts and densities of
hits, learns posterior labels of a bounded sample, and its scale is set on the same sample's labels.

Labels come only from rows the caller marks as learnable. At most ``FIT_ROWS`` of them (those with the smallest hashed ids, without
near copies) form voters and fit the classifier. Moments cover all documents, scores all whole texts. What comes to the driver: ``VOCABULARY``
hashes, a square of the number of voters, and ``FIT_ROWS`` rows of counts.

Defined cases: null and empty texts are scored (no voter fires); without learnable labels of both kinds only built-in voters work and the
prior is ``PRIOR``; repeated rows get equal scores; a repeated label counts as toxic if one of its rows does.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from canopyframe.llm.common import PUNCTUATION, Words, as_long, mix, shingles, slices
from canopyframe.session import cut

FIT_ROWS = 20_000
VOCABULARY = 4_000
SUPPORT = 5
LIFT = 8.0
PREFIXES = (4, 5, 6, 7, 8)
BUCKETS = 8
PRIOR = 0.1
CORRELATED = 0.15
#: marks the hash of a word's beginning
_BEGINNING = 0x5851F42D4C957F2D

# Everyday insults.
SEED_WORDS = ["clown", "crap", "creep", "damn", "disgusting", "dumb", "fool", "garbage", "hate", "idiot", "imbecile", "jerk", "kill", "liar", "loser", "moron",
              "pathetic", "pig", "scum", "shut", "stupid", "sucker", "trash", "ugly", "vermin", "worthless"]
# Digits that stand for letters.
LETTER_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


def _word_hash(words: list[str], fold: dict[str, str] | None = None) -> np.ndarray:
    text = " ".join(words).encode()
    w = Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), PUNCTUATION)
    return w.hashes()


def _letters() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for a, b in LETTER_DIGITS.items():
        out[ord(a)] = ord(b)
    return out


_LETTERS = _letters()


@dataclass
class Voters:
    """Sorted keys with the voter of each; seeds and mined keys are kept apart."""

    keys: np.ndarray
    voter: np.ndarray
    seeds: np.ndarray
    coarse: np.ndarray = field(init=False)
    #: voters: buckets of mined words, of mined beginnings, of seeds; spelling; two volume voters
    count: int = 3 * BUCKETS + 3

    def __post_init__(self) -> None:
        order = np.argsort(self.keys)
        self.keys, self.voter = self.keys[order], self.voter[order]
        self.coarse = np.zeros(1 << 16, dtype=bool)
        self.coarse[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def counts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hits of each voter but the volume voters, and words, by row."""
        n, m = len(offs) - 1, self.count
        w = Words(data, offs, PUNCTUATION)
        words = np.diff(w.bound)
        out = np.zeros(n * m)
        for h, row in _keys(w):
            some = np.flatnonzero(self.coarse[(h >> np.uint64(48)).astype(np.int64)])
            h, row = h[some], row[some]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
            out += np.bincount(row[hit] * m + self.voter[at[hit]], minlength=n * m)
        # digits as letters: only words with a digit are hashed again
        digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        odd = np.flatnonzero((digit[w.end] > digit[w.start]) & (w.end - w.start < 20))
        if len(odd):
            plain = Words(_LETTERS[data], offs, PUNCTUATION)
            h = plain.hashes()[odd]
            hit = np.isin(h, self.seeds)
            out += np.bincount(w.row[odd[hit]] * m + 3 * BUCKETS, minlength=n * m)
        return out.reshape(n, m), words


def _keys(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes with rows: of whole words, then of their beginnings."""
    yield w.hashes(), w.row
    size = w.end - w.start
    for p in PREFIXES:
        long = np.flatnonzero(size > p)
        yield w.span(w.start[long], w.start[long] + p) ^ np.uint64(_BEGINNING), w.row[long]


def votes_of(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0/1 votes of all voters; the last two fire on three hits, and on one hit in fifty words."""
    v = (counts > 0).astype(float)
    total = counts[:, :-2].sum(axis=1)
    v[:, -2] = total >= 3
    v[:, -1] = total * 50 >= np.maximum(words, 1)
    return v


def inputs_of(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The classifier's inputs: log counts and votes by voter, density by kind of voter, length."""
    v = votes_of(counts, words)
    b = BUCKETS
    kinds = [counts[:, :b].sum(1), counts[:, b: 2 * b].sum(1), counts[:, 2 * b: 3 * b].sum(1)]
    dense = [np.log1p(100 * k / np.maximum(words, 1)) for k in kinds]
    return np.column_stack([np.log1p(counts[:, :-2]), v[:, -2:], *[np.log1p(k) for k in kinds], *dense, np.log1p(words) / 5, np.ones(len(words))])


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, target: str, rows: int) -> DataFrame:
    """``text, y`` of at most ``rows`` learnable labelled documents, near copies once.

    Only their ids are broadcast (``rows`` numbers); ids are chosen by hash, so the choice doesn't follow the tables' order.
    """
    chosen = (labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & learn)
              .groupBy("doc_id").agg(F.max(target).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = np.zeros(b.num_rows, dtype=np.int64)
            for i, j, data, offs in slices(b.column(0)):
                h, row = shingles(Words(data, offs, PUNCTUATION), 5)
                least = np.full(j - i, np.uint64((1 << 64) - 1))
                np.minimum.at(least, row, h)
                low[i:j] = as_long(least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(low)], names=["text", "y", "low"])

    marked = found.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "text string, y int, low long")
    return marked.groupBy("low").agg(F.min(F.struct("text", "y")).alias("x")).select("x.text", "x.y")


def mine(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that go with the label, and whether each is a whole word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.array(b.column(1).to_pylist())
            for i, j, data, offs in slices(b.column(0)):
                w = Words(data, offs, PUNCTUATION)
                for kind, (h, row) in enumerate(_keys(w)):
                    order = np.lexsort((h, row))
                    h, row = h[order], row[order]
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    key, at = np.unique(h[new], return_inverse=True)
                    pos = np.bincount(at, weights=y[i:j][row[new]], minlength=len(key)).astype(np.int64)
                    every = np.bincount(at, minlength=len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind == 0)), pa.array(as_long(key)), pa.array(pos), pa.array(every)], names=["word", "key", "pos", "n"])

    total = sample.agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    if not total.n or not total.pos or total.pos == total.n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    rate = (F.col("pos") + 0.5) / (total.pos + 1) / ((F.col("n") - F.col("pos") + 0.5) / (total.n - total.pos + 1))
    best = (sample.mapInArrow(run, "word boolean, key long, pos long, n long").groupBy("word", "key").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
            .where(F.col("pos") >= SUPPORT).withColumn("rate", rate).where(F.col("rate") >= LIFT)
            .orderBy((F.log("rate") * F.sqrt("pos")).desc(), "key").limit(VOCABULARY).select("word", "key").collect())
    return np.array([r.key for r in best], dtype=np.int64).view(np.uint64), np.array([r.word for r in best], dtype=bool)


def make_voters(keys: np.ndarray, whole: np.ndarray) -> Voters:
    seeds = _word_hash(SEED_WORDS)
    bucket = lambda h: (mix(h) % np.uint64(BUCKETS)).astype(np.int64)
    new = ~np.isin(keys, seeds)
    keys, whole = keys[new], whole[new]
    return Voters(np.concatenate([keys, seeds]), np.concatenate([bucket(keys) + np.where(whole, 0, BUCKETS), 2 * BUCKETS + bucket(seeds)]), np.sort(seeds))


def moments(docs: DataFrame, voters: Voters) -> tuple[np.ndarray, float]:
    """Mean of the outer product of votes (with a constant) over all documents, and how many there are."""
    m = voters.count + 1
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m))
        for b in batches:
            for i, j, data, offs in slices(b.column(0)):
                v = np.column_stack([votes_of(*shared.value.counts(data, offs)), np.ones(j - i)])
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m)), pa.array(total.ravel())], names=["cell", "v"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(m * m)
    for r in sums.collect():
        out[r.cell] = r.v
    n = out[-1]
    return out.reshape(m, m) / max(n, 1.0), n


@dataclass
class LabelModel:
    """Rates of each voter under label 1 and 0, its weight and its correlated partners."""

    prior: float
    high: np.ndarray
    low: np.ndarray
    weight: np.ndarray
    correlated: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.high / self.low) * self.weight
        off = np.log((1 - self.high) / (1 - self.low)) * self.weight
        z = np.log(self.prior / (1 - self.prior)) + votes @ on + (1 - votes) @ off
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(second: np.ndarray, prior: float, rounds: int = 3) -> LabelModel:
    """From mean outer products (constant last): covariance = prior * (1 - prior) * gap gap' off the diagonal, but for correlated pairs."""
    mean = second[-1, :-1]
    cov = second[:-1, :-1] - np.outer(mean, mean)
    m, k = len(mean), prior * (1 - prior)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    active = mean * (1 - mean) > 1e-9
    free = ~np.eye(m, dtype=bool) & np.outer(active, active)
    correlated = np.zeros((m, m), dtype=bool)
    # voters that share hits with all others: the volume voters never inform on independence
    gap = np.where(active, sd, 0.0)
    for _ in range(rounds):
        use = free & ~correlated
        for _ in range(200):
            below = k * (use @ (gap ** 2))
            new = np.where(below > 0, (np.where(use, cov, 0) @ gap) / np.maximum(below, 1e-12), 0)
            gap = np.clip(0.5 * gap + 0.5 * new, 0, 1)
        left = np.abs(cov - k * np.outer(gap, gap)) / np.outer(sd, sd)
        left[~free] = 0
        # no voter loses more than half of its partners
        bound = np.maximum(CORRELATED, np.median(np.where(free, left, np.nan), axis=1, keepdims=True) if m else 0)
        correlated = (left > np.nan_to_num(bound, nan=CORRELATED)) & free
        correlated &= correlated.T
    strength = np.where(correlated, np.abs(cov) / np.outer(sd, sd), 0).sum(1)
    high = np.clip(mean + (1 - prior) * gap, 1e-3, 1 - 1e-3)
    low = np.clip(mean - prior * gap, 1e-4, 1 - 1e-3)
    return LabelModel(prior, high, np.minimum(low, high), np.where(active, 1 / (1 + strength), 0), correlated)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Newton's method on soft labels."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    weights: np.ndarray
    scale: tuple[float, float]

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = inputs_of(*self.voters.counts(data, offs)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "toxic", rows: int = FIT_ROWS) -> Model:
    sample = cut(training_rows(docs, labels, learn, target, rows))
    voters = make_voters(*mine(sample))
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1)
            for i, j, data, offs in slices(b.column(0)):
                c, words = shared.value.counts(data, offs)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1]).astype(np.int32)), pa.array(c.ravel()))
                yield pa.RecordBatch.from_arrays([y.slice(i, j - i), pa.array(words), flat], names=["y", "words", "counts"])

    local = sample.mapInArrow(run, "y int, words long, counts array<double>").toPandas()
    y = local["y"].to_numpy(dtype=float)
    counts = np.vstack([*local["counts"], np.zeros(voters.count)])[:-1]
    words = local["words"].to_numpy(dtype=float)
    prior = float(np.clip(y.mean(), 0.01, 0.5)) if len(y) else PRIOR
    second, _ = moments(docs, voters)
    model = fit_label_model(second, prior)
    if not len(y):
        counts, words = np.eye(voters.count), np.full(voters.count, 50.0)
    x = inputs_of(counts, words)
    weights = logistic(x, model.posterior(votes_of(counts, words)))
    scale = (1.0, 0.0)
    if len(y) and 0 < y.mean() < 1:
        z = x @ weights
        scale = tuple(logistic(np.column_stack([z, np.ones(len(z))]), y, ridge=0.1))
    return Model(voters, model, weights, scale)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability of the label, from the whole text."""
    docs = docs.drop(name)
    return with_score(docs, docs.sparkSession.sparkContext.broadcast(model), name)


def with_score(docs: DataFrame, shared, name: str) -> DataFrame:
    """A broadcast model's ``score(data, offsets)`` as a column, slice by slice."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for i, j, data, offs in slices(text):
            out[i:j] = shared.value.score(data, offs)
        return pa.array(out)

    return docs.withColumn(name, scored(F.col("text").cast("string")))
