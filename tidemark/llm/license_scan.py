"""License scan by diagonal voting, in DataFrame functions only.

A text is split into words once. Every pair of neighbouring words that the templates may
hold is hashed and joined to the places where they hold it. A hit votes for the diagonal ``word place - template place``. The
votes of one diagonal are pre-aggregated, each diagonal is merged with its neighbours (a word
more or less in the middle shifts the rest by one), and the merged spans are verified by the
distinct template places that they cover.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, row_id

# Phrases and labels of the base scan.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# Sentences of well-known licenses and notices, with the method's own labels.
TEXTS = (
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit-notice"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved", "reserved"),
)
SHIFT = 3
COVERED = 0.75
# A word: a run of digits, ASCII letters and anything outside ASCII. Texts are lower-cased
# first; no word of a template has a letter that another script's capital turns into.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_pairs(spark: SparkSession, phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """``template, label, base, size, place, pair``: at most a few hundred rows, as many as
    the word pairs of the templates."""
    rows = []
    for number, (text, label) in enumerate([*phrases, *texts]):
        words = re.findall(WORD, text)
        rows += [(number, label, number < len(phrases), len(words) - 1, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    frame = spark.createDataFrame(rows, "template int, label string, base boolean, size int, place int, a string, b string")
    return frame.withColumn("pair", F.xxhash64("a", "b")).drop("a", "b")


def read_once(docs: DataFrame, phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """``row, doc_id, n_words, hits``: the number of words of a text, and ``at, pair`` of the
    pairs whose words begin and end some pair of the templates."""
    split = [re.findall(WORD, text) for text, _ in (*phrases, *texts)]
    firsts, seconds = (sorted({w for words in split for w in words[part]}) for part in (slice(None, -1), slice(1, None)))
    # Splitting gives an empty word before a text that starts, and after one that ends, between words.
    words = F.array_remove(F.split(F.lower("text"), BETWEEN), "")
    read = docs.select(row_id("doc_id", "text").alias("row"), "doc_id", words.alias("words"))
    word = F.col("words")
    starts = F.when(F.size(word) >= 2, F.sequence(F.lit(0), F.size(word) - 2)).otherwise(F.array().cast("array<int>"))
    found = F.filter(starts, lambda i: word[i].isin(firsts) & word[i + 1].isin(seconds))
    hits = F.transform(found, lambda i: F.struct(i.alias("at"), F.xxhash64(word[i], word[i + 1]).alias("pair")))
    return read.select("row", "doc_id", F.size(word).cast("long").alias("n_words"), hits.alias("hits"))


def diagonal_votes(read: DataFrame, templates: DataFrame) -> DataFrame:
    """``row, template, label, base, size, diagonal, places, first, last``: the template places
    of a diagonal that agree, at most as many as the template has, and the word places of the
    outer ones."""
    rolled = read.select("row", F.inline("hits"))
    # The template table is bounded by the fixed templates above.
    hits = rolled.join(F.broadcast(templates), "pair").withColumn("diagonal", F.col("at") - F.col("place"))
    # One row per place first: repeated documents do not vote twice.
    once = hits.groupBy("row", "template", "label", "base", "size", "diagonal", "place").agg(F.first("at").alias("at"))
    keys = ["row", "template", "label", "base", "size", "diagonal"]
    return once.groupBy(*keys).agg(F.collect_list("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))


def verified_spans(votes: DataFrame) -> DataFrame:
    """``row, label, base, start, end, covered`` of the spans that stand.

    A phrase stands where all its pairs agree on one diagonal. A text stands where a diagonal
    and those up to ``2 * SHIFT`` words behind it cover enough of its places together; a place
    counts once however often it is repeated, and such a span is about as long as the text.
    """
    full = votes.filter(F.col("base") & (F.size("places") == F.col("size"))).select(
        "row", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("size")).alias("end"), F.lit(1.0).alias("covered")
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, 2 * SHIFT)
    merged = votes.filter("not base").select(
        "row", "label", "base", F.min("first").over(near).alias("start"), (F.max("last").over(near) + 1).alias("end"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near)))) / F.col("size")).alias("covered"),
    )
    return full.unionByName(merged.filter(F.col("covered") >= COVERED))


def license_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the largest covered share of a standing span, 0 without one. Null text is
    empty: no words, no labels, null places. Repeated rows each get their result; an empty
    table gives no rows; columns other than ``doc_id, text`` are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Texts are read once, for the counts and for the votes; phrases and texts both read the votes.
    read = cut(read_once(docs), "license_words")
    spans = verified_spans(cut(diagonal_votes(read, template_pairs(docs.sparkSession)), "license_votes"))
    joined = lambda labels: F.array_join(F.array_sort(F.collect_set(labels)), ",")
    base = F.col("base")
    found = spans.groupBy("row").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max("covered").alias("score"),
    )
    out = read.drop("hits").join(found, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
