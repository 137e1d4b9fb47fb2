"""The Merkle manifest against trees built and proofs folded one by one in plain Python."""
import zlib
from hashlib import sha256

import numpy as np
import pytest
from fixtures import documents
from pyspark.sql import functions as F

from canopyframe.llm import merkle
from canopyframe.llm.queries import QUERIES


def h(*x):
    return sha256("".join(x).encode()).hexdigest()


def leaf(r, add=0):
    values = (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + add, r["text"])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i: i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        i >>= 1
    return out


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in groups[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            path = siblings(trees[x], i) + siblings(top, k)
            d = leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for right, s in path:
                d = h(d) if s is None else h(s, d) if right else h(d, s)
            out.append((r["doc_id"], leaf(r), trees[x][-1][0], top[-1][0], h(*(s for _, s in path if s)), d, d == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [3, 12])
def test_equals_single_proofs(spark, size):
    docs = documents(spark).withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("l"), F.col("doc_id") % 4))).withColumn("n_chars", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    docs = docs.withColumn("index", F.lit("x")).withColumn("tree", F.lit("y")).withColumn("digest", F.lit(1))
    more = spark.range(100, 400).selectExpr("id as doc_id", "concat('text ', id) as text", "'l1' as lang", "null as source", "id as n_chars")
    docs = docs.unionByName(more, allowMissingColumns=True)
    assert got(merkle.of_documents(docs, size)) == brute([r.asDict() for r in docs.collect()])


def test_query_and_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    q = got(QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001"))
    assert q == brute([r.asDict() for r in docs.collect()]) and {r[-1] for r in q} == {True, False}
    assert merkle.of_documents(docs.limit(0)).collect() == []
    one = docs.where("doc_id = 1")
    assert got(merkle.of_documents(one)) == brute([r.asDict() for r in one.collect()])


def test_octopus_is_minimal_and_enough():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 16, 37):
        levels = tree([h(str(i)) for i in range(n)])
        for size in {1, 2, n // 2 or 1, n}:
            index = rng.choice(n, min(size, n), replace=False)
            need = merkle.octopus(index, n)
            fetched = {(a, b): levels[a][b] for a, b in need}
            part = merkle.Part(index.tolist(), [levels[0][i] for i in index], n, fetched)
            assert part.root == levels[-1][0]
            wanted = {(a, (i >> a) ^ 1) for i in index.tolist() for a in range(len(levels) - 1) if (i >> a) ^ 1 < len(levels[a])}
            derived = {(a, i >> a) for i in index.tolist() for a in range(len(levels))}
            assert set(need) == wanted - derived
            for i in index.tolist():
                assert part.proof(i) == "".join(s for _, s in siblings(levels, i) if s) == "".join(d for _, _, d in part.path(i))
