"""License scans by diagonal voting, with DataFrame functions only.

Every rolling ``K``-word gram of every whole text is joined by its hash (and its words, so a hash alone decides nothing) to
the template positions that hold it. A hit at word ``p`` of a text and word ``t`` of a template votes for the diagonal
``p - t``: an occurrence without changes gathers all its votes on one diagonal, inserted or lost words move the rest to a
neighbouring one. Diagonals of a template at most ``SLIP`` apart merge; a merged span is verified by the share of the
template's distinct grams that it holds (at least ``COVER``), and gives way to a fuller span from the same word on.

A phrase stands at a place exactly if one diagonal holds all its grams, because consecutive grams overlap.

One pass reads the texts: each text also sends a marker gram that carries its word count, so texts without a hit stay in the
result without a second scan. The template table is a parameter of the code (some hundred grams) and the only side that can be
broadcast. Hits are grouped by text, template and diagonal after map-side combination; a text that repeats a license
yields rows in proportion to its own length.

Defined cases: null and empty texts have no words and no labels; repeated rows stay repeated; rows without an id keep a null id;
overlapping places all count; ties between labels cannot occur, as all labels that hold are listed in order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from canopyframe.llm.common import ascii_lower

K = 3
SLIP = 2
COVER = 0.6
MAX_GRAMS = 100_000
MARK = "\x00"
# ASCII between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed values of the contract: phrases and labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Opening words of public license texts, lower case, without punctuation.
TEXTS = [
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def words_of(text: Column) -> Column:
    """Lower-cased words: ASCII letters and digits and all characters beyond ASCII."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def templates(spark: SparkSession, phrases=None, texts=None) -> DataFrame:
    """``template, label, base, grams, t, gram``: every gram position of every template, with the marker as template -1."""
    if sum(len(w.split()) for w, _ in [*(phrases or PHRASES), *(texts or TEXTS)]) > MAX_GRAMS:
        raise ValueError(f"templates of more than {MAX_GRAMS} words in all are not broadcast")
    rows = [(-1, None, False, 1, 0, MARK)]
    for i, (words, label, base) in enumerate([(*p, True) for p in phrases or PHRASES] + [(*p, False) for p in texts or TEXTS]):
        w = words.split()
        if len(w) < K:
            raise ValueError(f"a template needs {K} words")
        rows += [(i, label, base, len(w) - K + 1, t, " ".join(w[t: t + K])) for t in range(len(w) - K + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int, t int, gram string").withColumn("h", F.xxhash64("gram"))


def hits(docs: DataFrame, table: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, row, n_words, template, label, base, grams, t, diagonal, copies``."""
    w = F.col("w")
    many = F.size(w) - K + 1
    grams = F.when(many > 0, F.transform(F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<string>"))
    rows = (docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), words_of(F.col(text)).alias("w"))
            .select("doc_id", "row", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(grams, F.array(F.lit(MARK)))).alias("p", "gram"))
            .withColumn("h", F.xxhash64("gram")))
    # the table's size follows from the code alone (see templates), so all texts stay where they are
    return (rows.join(F.broadcast(table), ["h", "gram"])
            .groupBy("doc_id", "row", "n_words", "template", "label", "base", "grams", "t", F.when(F.col("template") >= 0, F.col("p") - F.col("t")).alias("diagonal"))
            .agg(F.count(F.lit(1)).alias("copies")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=None, texts=None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``spans`` lists what was verified: template, label, first word, share of its grams. ``score`` is the largest share (0 without).
    """
    key = ["doc_id", "row", "n_words"]
    found = hits(docs, templates(docs.sparkSession, phrases, texts), doc_id, text)
    votes = (found.groupBy(*key, "template", "label", "base", "grams", "diagonal")
             .agg(F.count(F.lit(1)).alias("votes"), F.max("copies").alias("copies"), F.collect_set("t").alias("ts")))
    w = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= SLIP, 0).otherwise(1)
    run = F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = (votes.withColumn("apart", apart).withColumn("run", run)
             .groupBy(*key, "template", "label", "base", "grams", "run")
             .agg(F.max("copies").alias("copies"),
                  F.array_size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("held"), F.min("diagonal").alias("first"),
                  F.sum(F.when(F.col("votes") == F.col("grams"), 1).otherwise(0)).alias("whole"),
                  F.min(F.when(F.col("votes") == F.col("grams"), F.col("diagonal"))).alias("low"),
                  F.max(F.when(F.col("votes") == F.col("grams"), F.col("diagonal"))).alias("high")))
    real, base = F.col("template") >= 0, F.col("base") & (F.col("template") >= 0)
    share = F.col("held") / F.col("grams")
    # templates that begin alike are told apart by their shares: of spans from one word on, only the fullest count
    spans = spans.withColumn("fullest", F.max(F.when(~F.col("base"), share)).over(Window.partitionBy(*key, F.col("template") >= 0, "first")))
    good = real & F.when(F.col("base"), F.col("whole") > 0).otherwise((share >= COVER) & (share == F.col("fullest")))
    listed = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    out = spans.groupBy(*key).agg(
        F.max(F.when(~real, F.col("copies"))).alias("copies"),
        F.coalesce(F.sum(F.when(base, F.col("whole"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("high"))).cast("long").alias("last_word"),
        listed(F.when(base & (F.col("whole") > 0), F.col("label"))).alias("base_labels"),
        listed(F.when(good, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(good, share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct("template", "label", F.greatest("first", F.lit(0)).alias("word"), share.alias("share"))))).alias("spans"))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"))
