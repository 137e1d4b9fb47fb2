"""N-gram Jaccard self-join by prefix trees.

A document's set holds the distinct ``k``-word runs of its whole text as 64-bit hashes; documents link when
``100 * |A & B| >= percent * |A | B|``. The result is one row per document with its component.

1. Equal sets collapse to one (``sid``, a hash of the sorted set), so copies cost one row each.
2. Candidates: linked sets of sizes up to ``u`` differ in at most ``H = 2u(100 - percent) / (100 + percent)`` elements. The global order (by hash) is cut into
   more than ``H`` segments, so a segment is equal in both, elements and all. Sets that share a segment's signature form a
   group. A segment holds several elements, so a passage shared by many documents groups them only where it fills a whole segment. Segments depend
   on a size class; a set that can be the smaller one of a pair in the next class has signatures there too. Empty segments are only used
   by sets with so many that no other equal segment is sure.
3. A task stores a group's sets, ordered globally, in a trie: elements shared by several sets from their beginning are stored and compared once.
   A set traverses it carrying its overlap so far; a subtree is left when overlap plus what can still follow on either side stays under the need
   of its smallest set, when sizes do not fit, or when all of it already belongs to the traversing set's component.
4. Sets that hang together by groups form a block. A block of at most ``BLOCK_SETS`` sets is one tile, so each of its texts
   moves once. Groups of a larger block are linked in three rounds, so that a cluster of thousands costs its size and not its square: each
   set first in its largest group, in chunks of ``CHUNK`` sets; then a few representatives of each component of a group; last, exactly,
   every pair of different components that still shares a group (split by size band, and into pairs of chunks when large). No link
   between different components can be missed on either way, and links inside a component change nothing.

There are more segments than can differ, so linked sets have many signatures in common (``need``). Signatures seen once are dropped by a count, and sets left with fewer than
their need drop out with them; before the join that finds the others' sets, a Bloom filter of fixed size does the same where the signatures are.

Defined cases: null and empty texts have ``n_shingles`` 0, no links and their own id; a text with fewer than ``k`` words is one run;
rows without an id take part, but lend no id (a component of such rows has none); repeated rows are copies. Two sets with
the same 64-bit ``sid`` or elements with the same hash would count as equal.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from canopyframe.llm.common import SPACES, Words, as_long, mix, shingles, slices
from canopyframe.llm.url_filter import build_filter, held
from canopyframe.operators.components import components
from canopyframe.session import cut, free, sweep

GROWTH = 1.6  # of one size class over the next smaller
CHUNK = 256
BLOCK_SETS = 1024
REPRESENTATIVES = 3
BLOCK = 64
FILTER_BLOCKS = 1 << 19  # 4 MB


def size_class(n: int) -> tuple[int, int]:
    """The class of a size, and the first size of the next class."""
    c, bound = 0, 2
    while n >= bound:
        c, bound = c + 1, max(bound + 1, math.ceil(bound * GROWTH))
    return c, bound


def segments(bound: int, percent: int) -> tuple[int, int]:
    """How many segments may differ in a class of sizes under ``bound``, and how many there are."""
    differ = 2 * (bound - 1) * (100 - percent) // (100 + percent)
    return differ, differ + 1 + -(-differ * (100 - percent) // 80)


def signed_classes(s: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """``(class, need, signatures)`` of a sorted set in its class and, where it can be the smaller of a pair, in the next.

    A linked set has at least ``need`` of these signatures in common with it.
    """
    c, bound = size_class(len(s))
    out = [(c, *_signed(s, c, bound, percent))]
    if 100 * len(s) >= percent * bound:
        out.append((c + 1, *_signed(s, c + 1, size_class(bound)[1], percent)))
    return out


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of all a set's classes."""
    return np.concatenate([marks for _, _, marks in signed_classes(s, percent)])


def _signed(s: np.ndarray, c: int, bound: int, percent: int) -> tuple[int, np.ndarray]:
    differ, m = segments(bound, percent)
    part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    total = np.add.reduceat(mix(s), first)
    which = part[first]
    # of m segments at most ``differ`` are unequal, and this set's empty ones may be among the equal
    need = len(first) - differ
    if need < 1:
        every = np.zeros(m, dtype=np.uint64)
        every[which.astype(np.int64)] = total
        total, which, need = every, np.arange(m, dtype=np.uint64), 1  # the other set may not sign its empty ones
    return need, mix(total + mix(which + np.uint64(c << 40)))


def row_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct run hashes of each text."""
    for _, _, data, offs in slices(texts):
        w = Words(data, offs, SPACES)
        h, row = shingles(w, k)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        if len(h):
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
        bound = np.searchsorted(row, np.arange(len(offs)))
        for i in range(len(offs) - 1):
            yield h[bound[i]: bound[i + 1]]


def sid_of(s: np.ndarray) -> int:
    import xxhash
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], dtype=np.uint64).view(np.int64)[0])


def _key(doc_id: str, text: str):
    """A row's key where ids are missing."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))


def _text_hash(text: str):
    """Tells the texts of one key apart."""
    return F.xxhash64(F.col(text).cast("string"))


def summarise(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """``doc_id, key, mark, n, sid`` of every row; ``mark`` is a hash of its text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [(len(s), sid_of(s) if len(s) else None) for s in row_sets(b.column(3), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                                             names=["doc_id", "key", "mark", "n", "sid"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), _key(doc_id, text).alias("key"), _text_hash(text).alias("mark"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, key long, mark long, n long, sid long"))


def _first(sets: DataFrame) -> DataFrame:
    """``sid, key, mark`` of one row of each distinct set: the key alone may stand on other texts, too."""
    return sets.where("n > 0").groupBy("sid").agg(F.min(F.struct("key", "mark")).alias("x")).select("sid", "x.key", "x.mark")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(_key(doc_id, text).alias("key"), _text_hash(text).alias("mark"), F.col(text).cast("string").alias("text"))


def signed_sets(docs: DataFrame, sets: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """``sid, n, cls, need, marks``: the signatures of each distinct set in each of its classes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            sid, n, cls, need, marks = [], [], [], [], []
            for want, s in zip(b.column(0).to_pylist(), row_sets(b.column(1), k)):
                if len(s) and sid_of(s) == want:  # unless texts of one key share a hash
                    for c, least, found in signed_classes(s, percent):
                        sid.append(want), n.append(len(s)), cls.append(c), need.append(least), marks.append(as_long(found))
            yield _marked(sid, n, cls, need, marks)

    rows = _rows(docs, doc_id, text).join(_first(sets), ["key", "mark"])
    return rows.select("sid", "text").mapInArrow(run, MARKED)


MARKED = "sid long, n long, cls int, need int, marks array<long>"


def _marked(sid, n, cls, need, marks: list[np.ndarray]) -> pa.RecordBatch:
    offs = np.concatenate([[0], np.cumsum([len(x) for x in marks])]).astype(np.int32)
    flat = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int32()), pa.array(need, pa.int32()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                                      names=["sid", "n", "cls", "need", "marks"])


def _possible(signed: DataFrame, words: np.ndarray) -> DataFrame:
    """``signed`` with the signatures that others may have, without sets that cannot have enough of them."""
    shared = signed.sparkSession.sparkContext.broadcast(words)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            offs = np.asarray(b.column(4).offsets)
            flat = b.column(4).values.to_numpy()
            ok = held(shared.value, flat)
            kept = [np.flatnonzero(ok[i:j]) + i for i, j in zip(offs[:-1], offs[1:])]
            sid, n, cls, need = (b.column(i).to_pylist() for i in range(4))
            good = [i for i in range(b.num_rows) if len(kept[i]) >= need[i]]
            yield _marked([sid[i] for i in good], [n[i] for i in good], [cls[i] for i in good], [need[i] for i in good], [flat[kept[i]] for i in good])

    return signed.mapInArrow(run, MARKED)


def shared_keys(signed: DataFrame) -> DataFrame:
    """``token, df, sid, n``: signatures that several distinct sets have, of sets that have as many of them as a linked set must share.

    A set with fewer is linked with nothing: so texts that have but a passage in common with others go here. What goes may have been the only
    other one with a signature, so this is done twice.
    """
    spark = signed.sparkSession
    counts = cut(signed.select(F.explode("marks").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token"))
    sweep(spark)
    words = build_filter(counts.select(F.col("token").alias("h")), FILTER_BLOCKS)  # tokens are hashes already
    keys = cut(_possible(signed, words).select("sid", "n", "cls", "need", F.explode("marks").alias("token")).join(counts, "token"))
    free(counts)
    sweep(spark)
    for _ in range(2):
        enough = keys.groupBy("sid", "cls").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need")).where("c >= need").select("sid", "cls")
        left = keys.drop("df").join(enough, ["sid", "cls"], "left_semi")
        several = left.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        old, keys = keys, cut(left.join(several, "token").select("token", "df", "sid", "n", "cls", "need"))
        free(old)
        sweep(spark)
    return keys


class Node:
    __slots__ = ("label", "children", "doc", "low", "high", "end", "one")

    def __init__(self, label: np.ndarray, end: int, size: int):
        self.label, self.end = label, end
        self.children: dict[int, Node] = {}
        self.doc = -1  # the set that ends here
        self.low = self.high = size
        self.one = -1  # a set of the subtree while all are known to be in one component, else -2


class Forest:
    """Union of components inside a task."""

    def __init__(self, comps: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(comps)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


class Trie:
    """A prefix tree over globally ordered sets."""

    def __init__(self, sets: list[np.ndarray], comps: list[int], percent: int):
        self.sets, self.percent = sets, percent
        self.forest = Forest(comps)
        self.root: Node | None = None
        self.top: dict[int, Node] = {}
        self.links: list[tuple[int, int]] = []

    def join(self) -> list[tuple[int, int]]:
        """Links that connect what the components so far did not."""
        for i in sorted(range(len(self.sets)), key=lambda i: len(self.sets[i])):
            self._query(i)
            self._insert(i)
        return self.links

    def _mark(self, node: Node, i: int) -> None:
        size = len(self.sets[i])
        node.low, node.high = min(node.low, size), max(node.high, size)
        if node.one == -1:
            node.one = i
        elif node.one >= 0 and self.forest.find(node.one) != self.forest.find(i):
            node.one = -2

    def _insert(self, i: int) -> None:
        s, at, level = self.sets[i], 0, self.top
        while True:
            first = int(s[at])
            node = level.get(first)
            if node is None:
                node = Node(s[at:], len(s), len(s))
                node.doc = i
                self._mark(node, i)
                level[first] = node
                return
            m = min(len(node.label), len(s) - at)
            differs = np.flatnonzero(node.label[:m] != s[at: at + m])
            same = int(differs[0]) if len(differs) else m
            if same < len(node.label):
                upper = Node(node.label[:same], node.end - len(node.label) + same, node.low)
                upper.low, upper.high, upper.one = node.low, node.high, node.one
                node.label = node.label[same:]
                upper.children[int(node.label[0])] = node
                level[first] = node = upper
            self._mark(node, i)
            at += same
            if at == len(s):
                node.doc = i
                return
            level = node.children

    def _query(self, i: int) -> None:
        q = self.sets[i]
        stack = [(n, 0, 0) for n in self.top.values()]
        p, nq, find = self.percent, len(q), self.forest.find
        while stack:
            node, overlap, at = stack.pop()
            if p * node.low > 100 * nq or 100 * node.high < p * nq:
                continue
            if node.one >= 0 and find(node.one) == find(i):
                continue
            least = -(-p * (nq + node.low) // (100 + p))
            depth, label, dead = node.end - len(node.label), node.label, False
            for b in range(0, len(label), BLOCK):
                part = label[b: b + BLOCK]
                pos = np.searchsorted(q[at:], part) + at
                overlap += int(np.count_nonzero(q[np.minimum(pos, nq - 1)] == part))
                depth += len(part)
                last = int(pos[-1])
                at = last + (last < nq and q[last] == part[-1])
                if overlap + min(nq - at, node.high - depth) < least:
                    dead = True
                    break
            if dead:
                continue
            if node.doc >= 0:
                d = node.doc
                both = nq + len(self.sets[d]) - overlap
                if 100 * overlap >= p * both and find(d) != find(i):
                    self.links.append((i, d))
                    self.forest.up[find(i)] = find(d)
            stack += [(n, overlap, at) for n in node.children.values()]


def link_tiles(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``node, comp``: components of ``tile, sid, comp, packed`` that a tile's trie joins, each with the smallest one joined (itself included).

    Tiles hold some hundred sets.
    """

    def flush(members: dict[int, tuple[int, bytes]], out: list) -> None:
        if len({comp for comp, _ in members.values()}) < 2:
            return
        sid = list(members)
        sets = row_sets(pa.array([zlib.decompress(packed).decode() for _, packed in members.values()], pa.large_string()), k)
        right = [(s, x) for s, x in zip(sid, sets) if len(x) and sid_of(x) == s]  # unless texts of one key share a hash
        comps = [members[s][0] for s, _ in right]
        trie = Trie([x for _, x in right], comps, percent)
        trie.join()
        joined: dict[int, set[int]] = {}
        for i, c in enumerate(comps):
            joined.setdefault(trie.forest.find(i), set()).add(c)
        out += [(c, min(j)) for j in joined.values() if len(j) > 1 for c in j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, members, out = None, {}, []
        for b in batches:
            for t, s, c, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if t != tile:
                    flush(members, out)
                    tile, members = t, {}
                members[s] = (c, e.as_py())
            if out:
                yield _links(out)
                out = []
        flush(members, out)
        yield _links(out)

    return (rows.select("tile", "sid", "comp", "packed").repartition("tile").sortWithinPartitions("tile")
            .mapInArrow(run, "node long, comp long"))


def _links(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["node", "comp"])


def packed_texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``sid, tile, packed`` of ``wanted`` (key, mark, sid, tile): the texts, compressed, because they move in less space than hashes do."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            packed = [zlib.compress(x.as_py() or b"", 1) for x in b.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["sid", "tile", "packed"])

    rows = _rows(docs, doc_id, text).join(wanted, ["key", "mark"])
    return rows.select("sid", "tile", "text").mapInArrow(run, "sid long, tile long, packed binary")


def _several(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups of ``rows`` (by, sid, comp) with more than one component: ``by, size``; of groups with the same members, one."""
    groups = (rows.groupBy(*by).agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"),
                                    F.bit_xor(F.xxhash64("sid")).alias("m1"), F.sum(F.xxhash64(F.lit(1), "sid").cast("decimal(38,0)")).alias("m2"))
              .where("x <> y"))
    return groups.groupBy("size", "m1", "m2").agg(F.min(F.struct(*by)).alias("g")).select("g.*", "size")


def merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after joining the components that ``found`` pairs (node, comp) connect."""
    now = cut(components(found, "node", "comp")).select(F.col("node").alias("was"), F.col("comp").alias("now"))
    old = comps.join(now, comps.comp == now.was, "left").select("node", F.coalesce("now", "comp").alias("comp"))
    new = now.join(comps, now.was == comps.node, "left_anti").select(F.col("was").alias("node"), F.col("now").alias("comp"))
    return old.unionByName(new)


def _with_comp(keys: DataFrame, comps: DataFrame) -> DataFrame:
    return keys.join(comps, keys.sid == comps.node, "left").withColumn("comp", F.coalesce("comp", "sid")).drop("node")


def set_components(sets: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """``node, comp`` of the distinct sets that are linked with another."""
    spark = docs.sparkSession
    signed = cut(signed_sets(docs, sets, doc_id, text, k, percent))
    sweep(spark)
    every = shared_keys(signed)
    free(signed)
    sweep(spark)

    # sets that hang together by any signatures: a small block is one tile, and settled by it
    low = every.groupBy("token").agg(F.min("sid").alias("a"))
    blocks = components(every.join(low, "token").where("sid <> a").select("a", F.col("sid").alias("b")))
    blocks = blocks.select(F.col("node").alias("sid"), F.col("comp").alias("block"))
    large = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("members")).withColumn("large", F.col("members") > BLOCK_SETS)
    blocks = cut(blocks.join(large, "block").select("sid", "block", "large"))

    # in a large one, each set goes to its largest group
    keys = cut(every.join(blocks.where("large").select("sid"), "sid"))
    free(every)
    sweep(spark)
    own = keys.groupBy("sid").agg(F.max(F.struct("df", "token")).alias("x")).select("sid", "x.token")
    sizes = own.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    chunk = F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / CHUNK))
    homes = (own.join(sizes, "token").select("sid", F.xxhash64("token", chunk).alias("tile"))
             .unionByName(blocks.where("not large").select("sid", F.xxhash64("block").alias("tile"))))
    wanted = _first(sets).join(homes, "sid")
    full = cut(packed_texts(docs, wanted, doc_id, text))
    # every set is in one tile here, so what the tiles join are components already
    comps = cut(link_tiles(full.withColumn("comp", F.col("sid")), k, percent))
    if keys.isEmpty():
        free(full, blocks, keys)
        sweep(spark)
        return comps
    packed, full = full, cut(full.drop("tile").join(keys.select("sid").distinct(), "sid", "left_semi"))
    free(packed, blocks)
    sweep(spark)

    # some representatives of each component in each group
    rows = cut(_with_comp(keys, comps))
    few = _several(rows, ["token"])
    near = (rows.join(few, "token").groupBy("token", "comp")
            .agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "sid").alias("h"), "sid")).alias(f"r{i}") for i in range(REPRESENTATIVES)])
            .select("token", "comp", F.explode(F.array_distinct(F.array(*[f"r{i}.sid" for i in range(REPRESENTATIVES)]))).alias("sid")))
    sizes = near.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    tiles = near.join(sizes, "token").select(F.xxhash64("token", F.pmod(F.xxhash64("comp"), F.ceil(F.col("size") / CHUNK))).alias("tile"), "sid", "comp")
    comps, old = cut(merged(comps, link_tiles(tiles.join(full, "sid"), k, percent))), (rows, comps)
    free(*old)
    sweep(spark)

    # what is left, exactly: different components that share a group and a pair of size bands
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9)).cast("long")
    rows = (_with_comp(keys, comps).withColumn("band", F.explode(F.array(band, band + 1)))
            .select("token", "band", "sid", "comp"))
    rows = cut(rows)
    left = _several(rows, ["token", "band"])
    m = F.ceil(F.col("size") / CHUNK)
    parts = (rows.join(left, ["token", "band"])
             .withColumn("i", F.pmod(F.xxhash64("sid"), m)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), m - 1))))
    tiles = parts.select(F.xxhash64("token", "band", F.least("i", "j"), F.greatest("i", "j")).alias("tile"), "sid", "comp")
    out = cut(merged(comps, link_tiles(tiles.join(full, "sid"), k, percent)))
    free(rows, comps, full, keys)
    sweep(spark)
    return out


def _judged(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with words (``doc_id, mark, n, comp, component_id``) and without (``doc_id, mark, n``)."""
    sets = cut(summarise(docs, doc_id, text, k))
    comps = set_components(sets, docs, doc_id, text, k, percent)
    own = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"))
    named = own.join(comps, own.sid == comps.node, "left").select("sid", "low", F.coalesce("comp", "sid").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_set = named.select("sid", "comp").join(lowest, "comp").select("sid", "comp", "component_id")
    some = sets.where("n > 0").join(by_set, "sid").select("doc_id", "mark", "n", "comp", "component_id")
    return some, sets.where("n = 0").select("doc_id", "mark", "n")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the smallest id reachable by links)."""
    some, none = _judged(docs, doc_id, text, k, percent)
    some = some.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(none.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of each component a row with the smallest id stays (one, if that id stands on several of its rows).

    Rows are judged by id and text, so an id that stands on different texts may stay on several. Rows without an id and rows without words are no one's copies and stay.
    """
    some, none = _judged(docs, doc_id, text, k, percent)
    fate = (some.where("doc_id = component_id").select("doc_id", "mark", "comp")
            .unionByName(none.where("doc_id is not null").select("doc_id", "mark", F.lit(None).cast("long").alias("comp"))).distinct()
            .toDF("__d", "__m", "__c"))
    w = Window.partitionBy("__c").orderBy(F.length(text).desc_nulls_last(), F.xxhash64(text))
    known = docs.where(F.col(doc_id).isNotNull()).join(fate, (F.col(doc_id).cast("long") == F.col("__d")) & (_text_hash(text) == F.col("__m")))
    first = known.where("__c is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__d", "__m", "__c", "__r")
    return first.unionByName(known.where("__c is null").drop("__d", "__m", "__c")).unionByName(docs.where(F.col(doc_id).isNull()))
