"""Language-model scoring: a causal self-attention model over subwords, and a smoothed word model from corpus counts.

Words are what white space separates, lower-cased (A-Z); a text ends with one end token. The word model adds up
``log10((c + 0.1) / (N + 0.1 * (V + 1)))`` over a text's words and its end, with counts from all learnable documents.

The attention model predicts subwords (a public byte-pair vocabulary, named by path) in two steps: their class from the context, then the subword within its class from
counts over all learnable documents. The most frequent subwords and the end have classes of their own, the others share classes of about equal mass, so the output
layer stays small. One layer: embeddings with positions, causal attention, a hidden layer, a softmax over classes;
trained with Adam on the windows of all learnable documents. The driver only makes a first guess, from at most ``FIT_DOCS`` documents (smallest
hashed ids). In each of ``ROUNDS`` rounds tasks start from the same weights and learn from their own windows; the mean of their weights, by windows, begins
the next round. A document belongs to one round by its hashed id, so each window is learnt from once and training grows with the input. A text of any length is cut into
windows of ``WINDOW`` positions, each starting ``STRIDE`` later, so positions after the first window are predicted from at least ``WINDOW - STRIDE`` before
them; every position is scored once, in the first window that holds it. Windows of many texts are scored together under one mask.

Scale: two passes over the texts, and one over each round's share. Counts are made by task, then by word hash. Looking up counts, words among the ``FREQUENT`` most frequent
ones come from a broadcast table of that size; the others go through a join by hash, as one row per text and distinct word.
Broadcast and driver hold the frequent words (2 MB), counts by subword, ``FIT_DOCS`` texts and one set of weights; the table of all words stays distributed.

Defined cases: null and empty texts have one token, the end; rows without an id are scored, but not learnt from and not held out; repeated rows stay
repeated, and are learnt from as often; without learnable documents all counts are 0 and the untrained model scores; words are told apart by 64-bit hashes.
"""
from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from canopyframe.llm.common import FOLD, SPACES, Words, as_long, slices
from canopyframe.session import cut

VOCABULARY_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: pieces inside a word, each with the space before it
PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
END_HASH = -0x7E11E11E11E11E1
FREQUENT = 1 << 17
FIT_DOCS = 1_500
CLASSES, OWN = 128, 96
#: input symbols; the last ``SHARED`` each stand for many rare subwords
SYMBOLS, SHARED = 2048, 256
WIDTH, HIDDEN = 16, 32
WINDOW, STRIDE = 32, 24
BATCH = 256
STEPS, STEP_WINDOWS, RATE = 600, 128, 4e-3
ROUNDS, ROUND_RATE = 3, 2e-3
#: rows in which a task's weights are sent to be added up
PARTS = 64
CACHE = 200_000
ADD = 0.1


class Subwords:
    """Subword ids of hashed words; encodes a word once while it stays in the cache. The id after the last is the end."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken
        self._encode = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1
        self._known: dict[int, list[int]] = {}

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes with a position for each word, then ids of the distinct words one after another with their starts."""
        h, first, at = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self._known) > CACHE:
            self._known.clear()
        folded, known, found = FOLD[w.data], self._known, []
        for key, i in zip(h.tolist(), first.tolist()):
            ids = known.get(key)
            if ids is None:
                ids = known[key] = self._encode(" " + folded[w.start[i]: w.end[i]].tobytes().decode("utf-8", "replace"))
            found.append(ids)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        return h, at, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(starts[-1])), starts


_subwords: dict[int, Subwords] = {}


def _worker(ranks) -> Subwords:
    """One encoder per worker process and broadcast vocabulary."""
    key = id(ranks)
    if key not in _subwords:
        _subwords.clear()
        _subwords[key] = Subwords(ranks)
    return _subwords[key]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def expand(at: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in order, and how many come before each word."""
    size = np.diff(starts)[at]
    before = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(starts[:-1][at] - before[:-1], size) + np.arange(before[-1])], before


def count(docs: DataFrame, ranks) -> DataFrame:
    """``subword, key, c``: counts of word hashes (with the end) and of subword ids over ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subs = _worker(ranks.value)
        pieces = np.zeros(subs.end + 1, dtype=np.int64)
        for b in batches:
            keys, times = [], []
            for i, j, data, offs in slices(b.column(0)):
                h, at, flat, starts = subs.of(Words(data, offs, SPACES))
                c = np.bincount(at, minlength=len(h))
                keys.append(h), times.append(c)
                pieces += np.bincount(flat, weights=np.repeat(c, np.diff(starts)), minlength=len(pieces)).astype(np.int64)
                pieces[subs.end] += j - i
            if not keys:
                continue
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)
            key, c = np.append(as_long(key), END_HASH), np.append(c, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), bool)), pa.array(key), pa.array(c)], names=["subword", "key", "c"])
        seen = np.flatnonzero(pieces)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(seen), bool)), pa.array(seen), pa.array(pieces[seen])], names=["subword", "key", "c"])

    return (docs.select(F.col("text").cast("string")).mapInArrow(run, "subword boolean, key long, c long")
            .groupBy("subword", "key").agg(F.sum("c").alias("c")))


@dataclass
class Classes:
    """Of each subword: its class, its log10 share of the class, and the symbol that stands for it as an input."""

    of: np.ndarray
    within: np.ndarray
    symbol: np.ndarray


def make_classes(counts: np.ndarray) -> Classes:
    """The end (last id) and the ``OWN - 1`` most frequent subwords alone, the rest in order of frequency in classes of about equal mass."""
    n = len(counts)
    order = np.argsort(-counts[:-1], kind="stable")
    of = np.zeros(n, dtype=np.int16)
    of[order[: OWN - 1]] = np.arange(1, OWN)
    rest = order[OWN - 1:]
    mass = np.cumsum(counts[rest] + ADD)
    of[rest] = OWN + np.minimum((mass / mass[-1] * (CLASSES - OWN)).astype(np.int64), CLASSES - OWN - 1)
    smooth = counts + ADD
    total = np.bincount(of, weights=smooth, minlength=CLASSES)
    symbol = np.full(n, -1, dtype=np.int16)
    own = order[: SYMBOLS - SHARED]
    symbol[own] = np.arange(len(own))
    other = np.flatnonzero(symbol < 0)
    symbol[other] = SYMBOLS - SHARED + other % SHARED
    return Classes(of, np.log10(smooth / total[of]).astype(np.float32), symbol)


#: input symbol before the first subword
BEGIN = SYMBOLS


class Attention:
    """The model's weights by name; forward and backward passes over windows of class ids."""

    def __init__(self, seed: int = 11):
        g = np.random.default_rng(seed)
        d, f = WIDTH, HIDDEN
        shapes = {"emb": (SYMBOLS + 1, d), "pos": (WINDOW, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "w1": (d, f), "b1": (f,), "w2": (f, d), "out": (d, CLASSES), "bias": (CLASSES,)}
        self.w = {n: (g.standard_normal(s) * (0.3 if n in ("emb", "pos") else 1 / np.sqrt(s[0])) if len(s) > 1 else np.zeros(s)).astype(np.float32) for n, s in shapes.items()}
        self.mask = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Queries, keys, values, attention, its sums and the embeddings."""
        w = self.w
        e = w["emb"][x] + w["pos"][: x.shape[1]]
        q, k, v = e @ (w["q"] / np.sqrt(np.float32(WIDTH))), e @ w["k"], e @ w["v"]
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, -30, 30, out=a)
        np.exp(a, out=a)
        a *= self.mask
        a /= a.sum(axis=2, keepdims=True)
        return q, k, v, a, a @ v, e

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits ``(windows, WINDOW, CLASSES)`` of what follows each position."""
        w = self.w
        q, k, v, a, c, e = self.attend(x)
        h = e + c @ w["o"]
        u = np.maximum(h @ w["w1"] + w["b1"], 0)
        z = h + u @ w["w2"]
        return z @ w["out"] + w["bias"], (x, e, q, k, v, a, c, h, u, z)

    def log10(self, x: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """log10 probability of the class ``y`` at each used position, one after another; the others are only context."""
        w = self.w
        e = w["emb"][x] + w["pos"][: x.shape[1]]
        a = (e @ (w["q"] / np.sqrt(np.float32(WIDTH)))) @ (e @ w["k"]).transpose(0, 2, 1)
        if a.max() > 30 or a.min() < -30:
            np.clip(a, -30, 30, out=a)
        np.exp(a, out=a)
        a *= self.mask
        # values with a constant: one product gives the weighted sum and the weights' total
        c = a @ np.concatenate([e @ w["v"], np.ones((*x.shape, 1), np.float32)], axis=2)
        c, y = c[use], y[use]
        h = e[use] + (c[:, :-1] / c[:, -1:]) @ w["o"]
        logits = (h + np.maximum(h @ w["w1"] + w["b1"], 0) @ w["w2"]) @ w["out"] + w["bias"]
        if logits.max() > 40 or logits.min() < -40:
            np.clip(logits, -40, 40, out=logits)
        right = logits[np.arange(len(logits)), y]
        np.exp(logits, out=logits)
        return (right - np.log(logits @ np.ones(CLASSES, np.float32))) * np.float32(1 / np.log(10))

    def gradients(self, x: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the used positions and its gradients."""
        w = self.w
        q, k, v, a, c, e = self.attend(x)
        some = use > 0
        share, y, c = use[some], y[some], c[some]
        n = max(int(share.sum()), 1)
        h = e[some] + c @ w["o"]
        u = np.maximum(h @ w["w1"] + w["b1"], 0)
        z = h + u @ w["w2"]
        p = z @ w["out"] + w["bias"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        at = np.arange(len(y))
        loss = float(-(np.log(p[at, y] + 1e-30) * share).sum() / n)
        p[at, y] -= 1
        p *= (share / np.float32(n))[:, None]
        flat = lambda m: m.reshape(-1, m.shape[-1])
        g = {"out": z.T @ p, "bias": p.sum(0)}
        dz = p @ w["out"].T
        g["w2"] = u.T @ dz
        du = (dz @ w["w2"].T) * (u > 0)
        g["w1"], g["b1"] = h.T @ du, du.sum(0)
        dh = dz + du @ w["w1"].T
        g["o"] = c.T @ dh
        dc = np.zeros_like(e)
        dc[some] = dh @ w["o"].T
        dv = a.transpose(0, 2, 1) @ dc
        da = dc @ v.transpose(0, 2, 1)
        ds = a * (da - (da * a).sum(axis=2, keepdims=True))
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        root = np.sqrt(np.float32(WIDTH))
        g["q"], g["k"], g["v"] = flat(e).T @ flat(dq) / root, flat(e).T @ flat(dk), flat(e).T @ flat(dv)
        de = dq @ w["q"].T / root + dk @ w["k"].T + dv @ w["v"].T
        de[some] += dh
        g["pos"] = np.zeros_like(w["pos"])
        g["pos"][: x.shape[1]] = de.sum(0)
        g["emb"] = np.zeros_like(w["emb"])
        np.add.at(g["emb"], x.ravel(), flat(de))
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = STEPS, seed: int = 3) -> list[float]:
        """Adam on random batches of windows; returns the losses."""
        rng, losses, adam = np.random.default_rng(seed), [], Adam(self)
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(STEP_WINDOWS, len(x)))
            losses.append(adam.step(x[pick], y[pick], use[pick], RATE * min(1.0, t / 30) * (1 - 0.9 * t / steps)))
        return losses


class Adam:
    """Steps of the optimiser on a model's weights."""

    def __init__(self, model: Attention):
        self.model, self.t = model, 0
        self.m = {n: np.zeros_like(v) for n, v in model.w.items()}
        self.s = {n: np.zeros_like(v) for n, v in model.w.items()}

    def step(self, x: np.ndarray, y: np.ndarray, use: np.ndarray, rate: float) -> float:
        loss, g = self.model.gradients(x, y, use)
        self.t += 1
        for n, d in g.items():
            self.m[n] += 0.1 * (d - self.m[n])
            self.s[n] += 0.02 * (d * d - self.s[n])
            self.model.w[n] -= (rate * (self.m[n] / (1 - 0.9 ** self.t)) / (np.sqrt(self.s[n] / (1 - 0.98 ** self.t)) + 1e-8)).astype(np.float32)
        return loss


def windows(ids: np.ndarray, bound: np.ndarray, classes: Classes, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts whose subwords are ``ids[bound[r]:bound[r + 1]]``.

    Returns inputs and targets of all positions (symbols, then subword ids), and for each window the positions it holds and which of them it scores, with its row.
    """
    n = len(bound) - 1
    size = np.diff(bound) + 1
    first = np.concatenate([[0], np.cumsum(size)])
    target = np.empty(first[-1], dtype=np.int32)
    last = first[1:] - 1
    inner = np.ones(first[-1], dtype=bool)
    inner[last] = False
    target[inner], target[last] = ids, end
    inputs = np.empty(first[-1], dtype=np.int16)
    inputs[1:] = classes.symbol[target[:-1]]
    inputs[first[:-1]] = BEGIN
    many = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
    row = np.repeat(np.arange(n), many)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    place = (turn * STRIDE)[:, None] + np.arange(WINDOW)
    inside = place < size[row][:, None]
    scored = inside & ((turn == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))
    at = first[row][:, None] + np.minimum(place, size[row][:, None] - 1)
    return inputs, target, at, scored, row


def score_texts(model: Attention, classes: Classes, ids: np.ndarray, bound: np.ndarray, end: int) -> np.ndarray:
    """log10 probability of each text."""
    inputs, target, at, scored, row = windows(ids, bound, classes, end)
    kind, within = classes.of[target], classes.within[target]
    out = np.zeros(len(bound) - 1)
    for i in range(0, len(at), BATCH):
        a, s = at[i: i + BATCH], scored[i: i + BATCH]
        found = model.log10(inputs[a], kind[a], s) + within[a[s]]
        out += np.bincount(np.repeat(row[i: i + BATCH], s.sum(axis=1)), weights=found, minlength=len(out))
    return out


@dataclass
class Model:
    classes: Classes
    attention: Attention
    #: sorted frequent word hashes (as unsigned) and their counts
    frequent: np.ndarray
    counts: np.ndarray
    #: learnable documents, which is the end token's count
    ends: int
    total: int
    distinct: int
    losses: list[float]
    #: windows learnt from in the rounds: all of the learnable documents'
    learnt: int

    def log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.total + ADD * (self.distinct + 1)))


def text_windows(texts: pa.Array, classes: Classes, subs: Subwords) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, target classes and scored positions of the texts' windows, a slice of the texts at a time."""
    for _, _, data, offs in slices(texts):
        w = Words(data, offs, SPACES)
        _, at, flat, starts = subs.of(w)
        ids, before = expand(at, flat, starts)
        inputs, target, places, scored, _ = windows(ids, before[w.bound], classes, subs.end)
        yield inputs[places], classes.of[target][places], scored


def learn_round(texts: DataFrame, attention: Attention, classes: Classes, ranks, rate: float) -> tuple[Attention, int]:
    """The mean, by windows, of the weights that tasks reach from ``attention`` on their own windows of ``texts`` (text), and the number of windows."""
    spark = texts.sparkSession
    begin = spark.sparkContext.broadcast((attention, classes))
    names = list(attention.w)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subs = _worker(ranks.value)
        first, kinds = begin.value
        model = Attention()
        model.w = {n: v.copy() for n, v in first.w.items()}
        adam, rng, seen, rest = Adam(model), np.random.default_rng(5), 0, None
        for part in itertools.chain((p for b in batches for p in text_windows(b.column(0), kinds, subs)), [None]):
            if part is not None:
                order = rng.permutation(len(part[0]))
                part = tuple(p[order] for p in part)
                rest = part if rest is None else tuple(np.concatenate(p) for p in zip(rest, part))
            if rest is None:
                continue
            n = len(rest[0])
            whole = n if part is None else n - n % STEP_WINDOWS
            for i in range(0, whole, STEP_WINDOWS):
                x, y, use = (p[i: min(i + STEP_WINDOWS, whole)] for p in rest)
                adam.step(x.astype(np.int64), y.astype(np.int64), use.astype(np.float32), rate * min(1.0, (adam.t + 1) / 30))
            seen, rest = seen + whole, tuple(p[whole:] for p in rest)
        if seen:
            sums = np.array_split(np.concatenate([model.w[n].ravel() for n in names]).astype(np.float64) * seen, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([seen] * PARTS, pa.int64()), pa.array([x.tobytes() for x in sums], pa.binary())], names=["part", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for part, n, sums in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(sums)
                t = total.setdefault(part, [0, np.zeros_like(x)])
                t[0], t[1] = t[0] + n, t[1] + x
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([t[1].tobytes() for t in total.values()], pa.binary())], names=["part", "n", "sums"])

    shape = "part int, n long, sums binary"
    rows = sorted(texts.select("text").mapInArrow(learn, shape).repartition("part").mapInArrow(add, shape).collect(), key=lambda r: r.part)
    begin.unpersist()
    if not rows:
        return attention, 0
    flat, out, at = np.concatenate([np.frombuffer(r.sums) for r in rows]) / rows[0].n, Attention(), 0
    for n in names:
        size = attention.w[n].size
        out.w[n], at = flat[at: at + size].reshape(attention.w[n].shape).astype(np.float32), at + size
    return out, rows[0].n


def fit(spark: SparkSession, docs: DataFrame, learn: Column, ranks, fit_docs: int = FIT_DOCS) -> tuple[Model, DataFrame]:
    """The model and the table of word counts (``key, c``); ``fit_docs`` documents give the weights from which the rounds begin."""
    known = docs.where(learn)
    counts = cut(count(known, ranks))
    words = counts.where("not subword").select("key", "c")
    facts = words.agg(F.sum("c").alias("n"), F.max(F.when(F.col("key") == END_HASH, F.col("c"))).alias("ends"), F.count(F.lit(1)).alias("v")).first()
    # the count from which on words are frequent enough, from a histogram of logarithms
    steps = words.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 8).alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("s")).collect()
    room, least = FREQUENT, None
    for r in steps:
        room -= r.n
        if room < 0:
            break
        least = r.s
    often = [] if least is None else words.where(F.floor(F.log2(F.col("c").cast("double")) * 8) >= least).toPandas()
    keys = np.asarray(often["key"], dtype=np.int64).view(np.uint64) if len(often) else np.zeros(0, np.uint64)
    c = np.asarray(often["c"], dtype=np.int64) if len(often) else np.zeros(0, np.int64)
    order = np.argsort(keys)
    subs = _worker(ranks.value)
    pieces = np.zeros(subs.end + 1)
    for r in counts.where("subword").select("key", "c").collect():
        pieces[r.key] = r.c
    classes = make_classes(pieces)
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    texts = known.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("text").cast("string")).toArrow().column("text")
    attention, losses = Attention(), []
    parts = list(text_windows(texts, classes, subs))
    if parts:
        x, y, use = (np.concatenate(p) for p in zip(*parts))
        losses = attention.train(x.astype(np.int64), y.astype(np.int64), use.astype(np.float32))
    learnt = 0
    for i in range(ROUNDS):
        share = known.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(ROUNDS)) == i).select(F.col("text").cast("string").alias("text"))
        attention, n = learn_round(share, attention, classes, ranks, ROUND_RATE * 0.5 ** i)
        learnt += n
    return Model(classes, attention, keys[order], c[order], int(facts.ends or 0), int(facts.n or 0), int(facts.v or 0), losses, learnt), words


def score(docs: DataFrame, model: Model, words: DataFrame, ranks) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, subs = shared.value, _worker(ranks.value)
        for b in batches:
            for i, j, data, offs in slices(b.column(1)):
                w = Words(data, offs, SPACES)
                h, at, flat, starts = subs.of(w)
                n = j - i
                if len(m.frequent):
                    pos = np.minimum(np.searchsorted(m.frequent, h), len(m.frequent) - 1)
                    often = m.frequent[pos] == h
                    part = np.where(often, m.log10(m.counts[pos]), 0.0)
                else:
                    often, part = np.zeros(len(h), bool), np.zeros(len(h))
                base = np.bincount(w.row, weights=part[at], minlength=n) + m.log10(np.array([m.ends]))[0]
                known = np.bincount(w.row, weights=often[at], minlength=n).astype(np.int64) + (m.ends > 0)
                other = np.flatnonzero(~often[at])
                pair, times = np.unique(w.row[other] * len(h) + at[other], return_counts=True) if len(other) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                owner = pair // max(len(h), 1)
                edge = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
                ids, before = expand(at, flat, starts)
                found = score_texts(m.attention, m.classes, ids, before[w.bound], subs.end)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), pa.array(np.diff(w.bound) + 1), pa.array(known), pa.array(base), pa.array(found),
                     pa.ListArray.from_arrays(edge, pa.array(as_long(h[pair % max(len(h), 1)]))), pa.ListArray.from_arrays(edge, pa.array(times.astype(np.int32)))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>"))
    # row numbers are written with the rows, so they stay what they are when a task runs again
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    logs = F.log10((c + F.lit(ADD)) / F.lit(model.total + ADD * (model.distinct + 1)))
    sums = (rare.join(words, "key", "left").groupBy("row")
            .agg(F.sum(F.col("times") * logs).alias("base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known")))
    return (rows.drop("rare", "times").join(sums, "row", "left")
            .select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
                    (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score"))


def score_documents(docs: DataFrame, held: Column, path: str = VOCABULARY_PATH, fit_docs: int = FIT_DOCS) -> DataFrame:
    """All ``docs`` (doc_id, text) scored by models learnt from the rows where ``held`` is false (not null)."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    model, words = fit(spark, docs.select("doc_id", "text"), ~held, ranks, fit_docs)
    return score(docs, model, words, ranks)
