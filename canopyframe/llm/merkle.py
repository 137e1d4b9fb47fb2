"""Merkle manifest of a table with proofs by octopus multiproofs.

Each row is a leaf; the rows of one ``lang`` form a tree in the order of their ids, the trees' roots form the top tree in the order
of their names. ``H`` is SHA-256 as lower-case hex over concatenated text. Of a level every two consecutive nodes become their
``H``; a last node without a neighbour becomes its own ``H`` alone, until one node remains.

How rows move. Leaves are digests of 32 bytes, made where the texts are read; texts never move. Places in a tree come from a range
partitioning with counts for each range, so no tree is sorted in one task. Trees are folded in blocks of ``2**BLOCK`` places, one
group each, and the blocks' tops are folded again: one round for every ``BLOCK`` levels.

Proofs. A partition (a block of leaves) first works out the smallest set of node coordinates ``(tree, level, index)`` that its
leaves' proofs need together and that neither its leaves nor nodes above them yield (the octopus set): neighbours of known nodes
that are not known themselves, level by level. All partitions' coordinates are joined with the nodes once; each partition then
derives the interior nodes that its proofs share and expands every leaf's own proof from them.

Defined cases: a null counts as ``-``, an empty text as ``0:``; rows with equal ids (null ids come first) are ordered by their
leaf; repeated rows are leaves of their own; a table without rows gives no rows; a very long text is hashed where it stands;
other columns, whatever their names, are not read. A lone leaf is its tree's root, a lone tree's root is the root.
"""
from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from canopyframe.session import cut

BLOCK = 12
#: name of the top tree; the others' names begin with - (null) or =
TOP = ""
#: coordinates of the top tree follow those of a partition's own tree
ABOVE = 100
ROOT = 200

NODE = "tree string, level int, index long, n long, digest binary"
COORDINATE = "tree string, block long, level int, index long"


def item(c: Column) -> Column:
    """A value as its byte count, a colon and its text, or - for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[item(v) for v in values]), 256)


def tree_of(group: Column) -> Column:
    """A name that sorts as its value does: null first, then bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def join_hash(left: str, right: str = "") -> str:
    return sha256((left + right).encode()).hexdigest()


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``index`` (place within ``tree`` from 0) and ``n`` (its leaves), written as a table."""
    ties = leaves.withColumn("__tie", F.monotonically_increasing_id())
    # a range's number is stored with its rows, so that counting and numbering see the same ranges
    spread = cut(ties.repartitionByRange("tree", *order, "__tie").withColumn("__part", F.spark_partition_id()))
    ends = Window.partitionBy("tree").orderBy("__part")
    ranges = (spread.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("here"))
              .withColumn("before", F.sum("here").over(ends.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("n", F.sum("here").over(Window.partitionBy("tree"))))
    place = F.row_number().over(Window.partitionBy("tree", "__part").orderBy(*order, "__tie"))
    return cut(spread.withColumn("__place", place).join(ranges, ["tree", "__part"])
               .withColumn("index", (F.coalesce("before", F.lit(0)) + F.col("__place") - 1).cast("long")).drop("__tie", "__part", "__place", "here", "before"))


def block_of(size: int) -> Column:
    return F.shiftright(F.col("index"), size).alias("block")


def _hex(column) -> list[str]:
    return [x.hex() for x in column.to_pylist()]


def _fold(base: int, size: int):
    def fold(t: pa.Table) -> pa.Table:
        order = np.argsort(t["index"].to_numpy())
        digests = [d for d in np.array(_hex(t["digest"]), dtype=object)[order]]
        first, n = int(t["index"].to_numpy().min()), t["n"][0].as_py()
        out: list[tuple[int, int, int, bytes]] = []
        for level in range(base + 1, base + size + 1):
            if n == 1:
                break
            digests = [join_hash(*digests[i: i + 2]) for i in range(0, len(digests), 2)]
            first, n = first >> 1, (n + 1) >> 1
            out += [(level, first + i, n, bytes.fromhex(d)) for i, d in enumerate(digests)]
        levels, index, ns, d = zip(*out) if out else ((), (), (), ())
        return pa.table({"tree": pa.array([t["tree"][0].as_py()] * len(levels), pa.string()), "level": pa.array(levels, pa.int32()), "index": pa.array(index, pa.int64()),
                         "n": pa.array(ns, pa.int64()), "digest": pa.array(d, pa.binary())})
    return fold


def build(leaves: DataFrame, size: int = BLOCK) -> DataFrame:
    """All nodes (``NODE``; ``n`` nodes on that level) of all trees of ``leaves`` (``tree, index, n, digest``), leaves at level 0."""
    nodes = leaves.select("tree", F.lit(0).alias("level"), "index", "n", "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    frontier, base = nodes, 0
    while most > 1:
        inner = cut(frontier.where(F.col("n") > 1).select("tree", "index", "n", "digest").groupBy("tree", block_of(size)).applyInArrow(_fold(base, size), NODE))
        nodes = nodes.unionByName(inner)
        base, most = base + size, -(-most >> size)
        frontier = inner.where(F.col("level") == base)
    return nodes


def octopus(index: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The fewest ``(level, index)`` from which, with the leaves at ``index`` of ``n``, all their proofs follow."""
    known, out, level = np.unique(index), [], 0
    while n > 1:
        beside = known ^ 1
        out += [(level, int(i)) for i in np.setdiff1d(beside[beside < n], known)]
        known, n, level = np.unique(known >> 1), (n + 1) >> 1, level + 1
    return out


class Part:
    """What a partition knows of a tree: its leaves, the fetched nodes and every node that follows from them."""

    def __init__(self, index, digests: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.sizes = [n]
        while self.sizes[-1] > 1:
            self.sizes.append((self.sizes[-1] + 1) >> 1)
        self.nodes = [dict() for _ in self.sizes]
        for (level, i), d in fetched.items():
            self.nodes[level][i] = d
        self.nodes[0].update(zip(index, digests))
        own = sorted(set(index))
        for level in range(len(self.sizes) - 1):
            have, parents = self.nodes[level], sorted({i >> 1 for i in own})
            for p in parents:
                self.nodes[level + 1][p] = join_hash(have[2 * p], have[2 * p + 1] if 2 * p + 1 < self.sizes[level] else "")
            own = parents
        self.root = self.nodes[-1][0]
        self._rest: dict[tuple[int, int], str] = {}

    def beside(self, level: int, i: int) -> str:
        return self.nodes[level][i ^ 1] if i ^ 1 < self.sizes[level] else ""

    def path(self, i: int) -> list[tuple[int, int, str]]:
        """``(level, index, digest)`` of a leaf's siblings."""
        return [(level, i >> level ^ 1, d) for level in range(len(self.sizes) - 1) if (d := self.beside(level, i >> level))]

    def proof(self, i: int, level: int = 0) -> str:
        """The siblings' digests, concatenated; what lies above a node is put together once for all leaves below it."""
        if level == len(self.sizes) - 1:
            return ""
        if level == 0:
            return self.beside(0, i) + self.proof(i >> 1, 1)
        key = (level, i)
        if key not in self._rest:
            self._rest[key] = self.beside(level, i) + self.proof(i >> 1, level + 1)
        return self._rest[key]

    def fold(self, i: int, digest: str) -> str:
        """The root that another leaf at ``i`` leads to with the same siblings."""
        for level in range(len(self.sizes) - 1):
            beside = self.beside(level, i)
            digest = join_hash(beside, digest) if i & 1 else join_hash(digest, beside)
            i >>= 1
        return digest


def _need(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    tree, block = key
    found = octopus(t["index"].to_numpy(), t["n"][0].as_py())
    return pa.table({"tree": pa.array([tree.as_py()] * len(found), pa.string()), "block": pa.array([block.as_py()] * len(found), pa.int64()),
                     "level": pa.array([x for x, _ in found], pa.int32()), "index": pa.array([x for _, x in found], pa.int64())})


def fetch(leaves: DataFrame, nodes: DataFrame, size: int = BLOCK) -> DataFrame:
    """``tree, block, level, index, digest``: every partition's missing nodes."""
    need = cut(leaves.select("tree", "index", "n").groupBy("tree", block_of(size)).applyInArrow(_need, COORDINATE))
    least = need.agg(F.min("level")).first()[0]  # whole blocks need nothing below their tops
    return need.join(nodes.where(F.col("level") >= F.lit(least)).select("tree", "level", "index", "digest"), ["tree", "level", "index"]).select("tree", "block", "level", "index", "digest")


def _fetched(t: pa.Table, low: int, high: int) -> dict[tuple[int, int], str]:
    return {(level - low, i): d for level, i, d in zip(t["level"].to_pylist(), t["index"].to_pylist(), _hex(t["digest"])) if low <= level < high}


def _paths(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    index = leaves["index"].to_pylist()
    part = Part(index, _hex(leaves["digest"]), leaves["n"][0].as_py() if index else 1, _fetched(fetched, 0, ABOVE)) if index else None
    rows = [(name, [{"level": a, "index": b, "digest": bytes.fromhex(c)} for a, b, c in part.path(i)], i, leaves["n"][0].as_py(), leaves["digest"][k].as_py(), bytes.fromhex(part.root))
            for k, (name, i) in enumerate(zip(leaves["name"].to_pylist(), index))]
    shape = pa.schema([("name", pa.string()), ("path", pa.list_(pa.struct([("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary())]))), ("index", pa.int64()), ("n", pa.int64()),
                       ("digest", pa.binary()), ("root", pa.binary())])
    return pa.Table.from_pylist([dict(zip(shape.names, r)) for r in rows], shape)


def paths(leaves: DataFrame, nodes: DataFrame, size: int = BLOCK) -> DataFrame:
    """``name, path, index, n, digest, root``: each named leaf's own siblings and root."""
    parts = leaves.select("tree", block_of(size), "index", "n", "digest", "name").groupBy("tree", "block")
    return parts.cogroup(cut(fetch(leaves, nodes, size)).groupBy("tree", "block")).applyInArrow(
        _paths, "name string, path array<struct<level int, index long, digest binary>>, index long, n long, digest binary, root binary")


PROVED = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    index, digests, bad = leaves["index"].to_pylist(), _hex(leaves["digest"]), leaves["bad"].to_pylist()
    # the top tree's rows: its siblings at ABOVE + level, the subroot's place and the stored root at ROOT
    own = Part(index, digests, leaves["n"][0].as_py(), _fetched(fetched, 0, ABOVE))
    above = _fetched(fetched, ABOVE, ROOT)
    (_, place), root = next((k, d) for k, d in _fetched(fetched, ROOT, ROOT + 1).items())
    (_, n), _ = next((k, d) for k, d in _fetched(fetched, ROOT + 1, ROOT + 2).items())
    top = Part([place], [own.root], n, above)
    rest = top.proof(place)
    proofs = [sha256((own.proof(i) + rest).encode()).hexdigest() for i in index]
    folded = [top.root if b is None else top.fold(place, own.fold(i, b.hex())) for i, b in zip(index, bad)]
    k = len(index)
    return pa.table({"doc_id": leaves["doc_id"], "leaf": pa.array(digests, pa.string()), "subroot": pa.array([own.root] * k, pa.string()), "root": pa.array([root] * k, pa.string()),
                     "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})


def manifest(docs: DataFrame, leaf: Column, group: Column, doc_id: str = "doc_id", tampered: Column | None = None, size: int = BLOCK) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``leaf`` is a row's digest as hex, ``group`` names its tree. Where ``tampered`` is not null, the row's proof is folded from
    that digest in place of ``leaf``: ``verified`` tells whether it still leads to the root.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), tree_of(group).alias("tree"), F.unhex(leaf).alias("digest"), F.unhex(tampered if tampered is not None else F.lit(None).cast("string")).alias("bad"))
    kind = dict(rows.dtypes)["doc_id"]
    leaves = ranked(cut(rows), ["doc_id", "digest"])
    nodes = build(leaves, size)
    tops = nodes.where(F.col("n") == 1).select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest")
    top_leaves = ranked(tops, ["name"])
    above = cut(paths(top_leaves, build(top_leaves, size), size))
    # of each tree: its siblings in the top tree, its place there with the stored root, the top tree's size
    told = above.select(F.col("name").alias("tree"), F.explode(F.concat(
        F.transform("path", lambda p: F.struct((p["level"] + ABOVE).alias("level"), p["index"].alias("index"), p["digest"].alias("digest"))),
        F.array(F.struct(F.lit(ROOT).alias("level"), F.col("index").alias("index"), F.col("root").alias("digest")), F.struct(F.lit(ROOT + 1).alias("level"), F.col("n").alias("index"), F.col("root").alias("digest")))
    )).alias("x")).select("tree", "x.*")
    blocks = leaves.select("tree", block_of(size)).distinct()
    known = cut(fetch(leaves, nodes, size).unionByName(blocks.join(told, "tree").select("tree", "block", "level", "index", "digest")))
    parts = leaves.select("tree", block_of(size), "doc_id", "index", "n", "digest", "bad").groupBy("tree", "block")
    return parts.cogroup(known.groupBy("tree", "block")).applyInArrow(_prove, PROVED.format(kind))


def of_documents(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The manifest of a table of documents; every seventh id (by crc32) has its length tampered with."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = leaf_of(*fields[:3], F.col("n_chars").cast("decimal(20,0)") + 1, fields[4])
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(docs, leaf_of(*fields), F.col("lang"), tampered=F.when(hit, changed), size=size)
