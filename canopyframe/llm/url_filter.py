"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listing is a table ``host, path, verdict``: an entry fits its host, all subdomains and every path that
starts with its path. A page's possible keys are its host's label suffixes with the prefixes of its path
whose lengths occur in the listing. The filter lets through the keys that may be listed; the hash join
that follows drops the filter's false positives, so the result is exact.

Filter layout: ``blocks`` words of 64 bits; a key sets ``PROBES`` bits of a single word, so a probe costs one
memory access. Its size is a parameter, fixed whatever the listing holds (2**17 words, 1 MB, by default):
that is what is broadcast. With more entries than about one per eight bits it lets more through, and
the join has more to do; the result stays the same.

Defined cases: a null url or one without ``://`` has an empty host and path and no entry; repeated pages
stay repeated; a repeated entry counts once (``block`` beats ``allow`` on equal entries); entries with a
null or empty host fit nothing; an empty listing gives the default verdict everywhere; extra columns are
kept as they are, the operator's own are named by the caller's ``prefix``.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from canopyframe.llm.common import ascii_lower

PROBES = 6
BLOCKS = 1 << 17
#: a listing of at most so many rows (after the count) may be broadcast; a larger one is shuffled with salt
BROADCAST_ROWS = 10_000
SALT = 16
SEP = "\x01"


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def build_filter(listed: DataFrame, blocks: int = BLOCKS) -> np.ndarray:
    """The filter's words over the hashes ``h``: bits of one block are combined on the executors, at most ``blocks`` words come back."""
    h = F.col("h")
    bits = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    words = (listed.select(F.shiftrightunsigned(h, 64 - blocks.bit_length() + 1).alias("block"), bits.alias("bits"))
             .groupBy("block").agg(F.bit_or("bits").alias("bits")))
    found = words.toArrow()  # two numbers a word; as row objects they would fill the driver
    out = np.zeros(blocks, dtype=np.int64)
    out[found["block"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def held(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of 64-bit hashes (longs), whether the filter may hold them: False means surely not."""
    x = hashes.astype(np.int64, copy=False).view(np.uint64)
    word = words[(x >> np.uint64(64 - len(words).bit_length() + 1)).astype(np.int64)]
    ok = np.ones(len(x), dtype=bool)
    for i in range(PROBES):
        ok &= (word >> ((x >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) == 1
    return ok


def may_hold(spark, words: np.ndarray):
    """A column function on 64-bit key hashes: False means surely not listed."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        return pd.Series(held(shared.value, h.to_numpy(dtype=np.int64)))

    return probe


def judge(pages: DataFrame, listing: DataFrame, url: str = "url", default: str = "allow", blocks: int = BLOCKS,
          prefix: str = "") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (named with ``prefix``): the longest fitting entry wins.

    One shuffle carries a row per distinct URL, not the pages: verdicts are found for distinct URLs and joined back by
    URL (adaptive execution splits a URL that many pages share).
    """
    spark = pages.sparkSession
    rules = (listing.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .where("host is not null and host <> ''")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    facts = rules.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    host, path = canonical(F.col("u"))
    urls = (pages.select(F.col(url).alias("u")).where("u is not null").groupBy("u").agg(F.count(F.lit(1)).alias("n"))
            .select("u", host.alias("h"), path.alias("p")))
    labels = F.split("h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.concat_ws(".", F.slice("parts", i, F.size("parts"))))
    lengths = F.array(*[F.lit(n) for n in facts.lengths]).cast("array<int>")
    keys = (urls.where("h <> ''").withColumn("parts", labels)
            .select("u", "p", F.explode(suffixes).alias("host"))
            .select("u", "host", F.explode(F.filter(lengths, lambda n: n <= F.length("p"))).alias("n"), "p")
            .select("u", "host", F.substring("p", F.lit(1), F.col("n")).alias("path"))
            .withColumn("k", F.xxhash64(F.concat_ws(SEP, "host", "path"))))
    possible = keys.where(may_hold(spark, build_filter(rules.select(F.xxhash64(F.concat_ws(SEP, "host", "path")).alias("h")), blocks))("k")).drop("k")
    if facts.n <= BROADCAST_ROWS:
        hits = possible.join(F.broadcast(rules), ["host", "path"])
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hits = possible.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALT)).cast("int")).join(salted, ["host", "path", "salt"])
    best = hits.groupBy("u").agg(F.max(F.struct(
        (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("m"), F.concat("host", "path").alias("rule"), "verdict")).alias("b"))
    verdicts = best.select(F.col("u").alias("__u"), F.col("b.rule").alias("__r"), F.col("b.verdict").alias("__v"))
    host, path = canonical(F.col(url))
    return (pages.withColumns({f"{prefix}host": host, f"{prefix}path": path})
            .join(verdicts, F.col(url) == F.col("__u"), "left")
            .withColumns({f"{prefix}rule": F.col("__r"), f"{prefix}verdict": F.coalesce("__v", F.lit(default))})
            .drop("__u", "__r", "__v"))
