"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

A test item is found in a document when at least ``percent`` of its distinct ``k``-word runs occur there, however long the
document is. Items are partitioned by size, because a sketch's length must follow the item's size: a partition's sketch
holds the ``m`` smallest hashes of an item's runs (a bottom-m MinHash), where ``m`` is one more than the number of runs that the
partition's largest item may miss. Any ``m`` runs of an item then include one that a contaminated document has, so the
search loses nothing, while it looks at a fifth of the items' runs. A document's runs meet the sketches in one hash join that
also requires a document large enough for the partition. Candidate pairs are verified by their exact runs (as text).

The benchmark side is what is small; Spark broadcasts it only under its own size threshold and shuffles both sides beyond. The verifying step joins
the candidates' ids back to the texts. Nothing is gathered by document or by item; an item found in a third
of all documents just gives that many result rows.

Defined cases: null or empty texts and items have no runs and match nothing; an item or a document of fewer than ``k`` words is one
run; rows without an id cannot be reported and are left out of the pairs (``clean`` judges them by their text all the same); repeated
rows give one pair.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from canopyframe.llm.common import ascii_lower

# ASCII white space, as between words elsewhere in this package.
BETWEEN = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _places(w: Column, k: int) -> Column:
    """Where runs start; one place for a text of fewer words, none without words."""
    n = F.size(w)
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def run_texts(w: Column, k: int) -> Column:
    return F.array_distinct(F.transform(_places(w, k), lambda i: F.concat_ws(" ", F.slice(w, i, k))))


def item_runs(items: DataFrame, item_id: str, text: str, k: int) -> DataFrame:
    """``item_id, item, size, run``; ``item`` tells apart rows with the same id."""
    rows = items.select(F.col(item_id).alias("item_id"), F.xxhash64(F.col(text)).alias("item"), words_of(F.col(text)).alias("w")).dropDuplicates(["item_id", "item"])
    runs = rows.select("item_id", "item", run_texts(F.col("w"), k).alias("runs"))
    return runs.select("item_id", "item", F.size("runs").alias("size"), F.explode("runs").alias("run"))


def sketches(runs: DataFrame, percent: int, k: int) -> DataFrame:
    """``h, part, least``: hashes of each item's sketch with its size partition and the fewest runs that contain one."""
    part = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    largest = F.pow(F.lit(2.0), F.col("part") + 1) - 1
    m = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    hashed = runs.select("item_id", "item", "size", part.alias("part"), F.xxhash64(F.transform(F.split("run", " "), lambda x: F.xxhash64(x))).alias("h"))
    kept = (hashed.groupBy("item_id", "item", "part").agg(F.sort_array(F.collect_set("h")).alias("hs"))
            .select("part", F.explode(F.slice("hs", F.lit(1), m)).alias("h")))
    # an item of the partition has at least 2 ** part runs
    least = F.ceil(F.pow(F.lit(2.0), F.col("part")) * percent / 100)
    return kept.groupBy("h").agg(F.min(least).alias("least"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 k: int = 5, percent: int = 80) -> DataFrame:
    """Pairs ``doc_id, row, item_id, item_runs, shared, containment``; ``row`` is a hash of the document's text."""
    runs = item_runs(items, item_id, item_text, k)
    search = sketches(runs, percent, k)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    hashed = F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x))
    exploded = (rows.select("doc_id", "row", hashed.alias("w"))
                .select("doc_id", "row", F.size("w").alias("n"), F.explode(F.transform(_places(F.col("w"), k), lambda i: F.xxhash64(F.slice("w", i, k)))).alias("h")))
    found = exploded.join(search, "h").where(F.greatest(F.col("n") - (k - 1), F.lit(1)) >= F.col("least")).select("doc_id", "row").distinct()
    # ids may be missing: a hash of id and text stands for the row on both sides
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "row")
    texts = rows.withColumn("key", key).join(found.select(key.alias("key")).distinct(), "key", "left_semi").dropDuplicates(["doc_id", "row"])
    # words first, as a column of their own: inside the function of each run they would be split again for every run
    exact = texts.select("doc_id", "row", words_of(F.col("text")).alias("w")).select("doc_id", "row", F.explode(run_texts(F.col("w"), k)).alias("run"))
    return (exact.join(runs, "run").groupBy("doc_id", "row", "item_id", "item", "size").agg(F.count(F.lit(1)).alias("shared"))
            .where(F.col("shared") * 100 >= F.col("size") * percent)
            .select("doc_id", "row", "item_id", F.col("size").cast("long").alias("item_runs"), "shared", (F.col("shared") / F.col("size")).alias("containment")))


def pairs(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """One row per document and item: ``doc_id, item_id, item_runs, shared, containment`` (of the row that holds most)."""
    found = contaminated(docs, items, **how).where("doc_id is not null")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "shared", "item_runs")).alias("b"))
    return best.select("doc_id", "item_id", "b.item_runs", "b.shared", "b.containment")


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose own text holds an item; all columns and other rows stay."""
    bad = contaminated(docs, items, doc_id, text, **how).select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", F.xxhash64(F.col(text))).join(bad, "__row", "left_anti").drop("__row")
