"""Phrase collocation mining by dynamic itemset counting.

The corpus is dealt into shards that are scanned in turn, over and over. Words are counted
from the first scan on. A longer phrase becomes active at the scan after both its subphrases
(all but its last, all but its first word) have reached the threshold, and is counted for
one full cycle from there, so its count is exact. Lengths are thus counted side by side.

When a subphrase reached the threshold is kept in one table of ``2 ** bits`` scan numbers per
length, which tasks look up by digest. Its size does not grow with the corpus; the places
that are set are sent. Where two
phrases share a place of the table, a phrase may become active early, which costs work but
not exactness: its cycle starts at the scan that the table gives, whatever the reason.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bitmap import bit_table, places, set_bits
from tidemark.llm.common import cut
from tidemark.llm.tokens import SPACED, digests, find_words, mixed, portions_by_size, rolled
from tidemark.sources.sinks import Cuts, stage_root
from tidemark.sources.tabular import remove_path

LEAST = 30
LONGEST = 4
SHARDS = 3
BITS = 24
TOP = 2000
NEVER = 255
KEY = ["lang", "words", "phrase", "started", "digest"]
COUNTED = "lang string, words int, phrase string, started int, digest long, n long"


def deal_shards(docs: DataFrame, shards: int) -> str:
    """Writes ``lang, text`` in folders of one shard each and returns the path."""
    path = posixpath.join(stage_root(docs.sparkSession), f"shards-{uuid.uuid4().hex}")
    dealt = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text <> ''")
    dealt.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(path)
    return path


def scan_shard(shard: DataFrame, scan: int, shards: int, shared: Broadcast, bits: int) -> DataFrame:
    """Counts of the phrases that are active at this scan. ``shared`` holds, by length, places
    and the scans from which phrases at a place count as frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since = {n: np.full(1 << bits, NEVER, np.uint8) for n in shared.value}
        for n, (at, scans) in shared.value.items():
            since[n][at] = scans
        for batch in portions_by_size(batches, "text"):
            found = find_words(batch.column(1), SPACED)
            if not len(found.row):
                continue
            codes, distinct = found.coded()
            lang = batch.column(0).dictionary_encode()
            lang_code = lang.indices.to_numpy().astype(np.int64)[found.row]
            lang_mark = digests(pc.binary_join_element_wise(lang.dictionary, "|", ""))[lang_code]
            marks = digests(distinct)[codes]
            for n in range(1, LONGEST + 1):
                count = len(codes) - n + 1
                if count <= 0 or (n == 1 and scan >= shards) or (n > 1 and n - 1 not in since):
                    continue
                if n == 1:
                    at, started = np.arange(count), np.zeros(count, np.int32)
                else:
                    begun = since[n - 1][places(mixed(rolled(marks, n - 1) + lang_mark[: count + 1]), bits)]
                    started = np.maximum(begun[:-1], begun[1:]).astype(np.int32)
                    active = (started <= scan) & (scan < started + shards) & (found.piece[:count] == found.piece[n - 1 :])
                    at, started = np.flatnonzero(active), started[active]
                if not len(at):
                    continue
                key = lang_code[at] * len(distinct) + codes[at]
                for i in range(1, n):
                    key = np.unique(key, return_inverse=True)[1] * len(distinct) + codes[at + i]
                _, first, times = np.unique(key, return_index=True, return_counts=True)
                at, started = at[first], started[first]
                phrase = [distinct.take(pa.array(codes[at + i])) for i in range(n)]
                mark = mixed(rolled(marks, n)[at] + lang_mark[at]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(lang_code[at])), pa.array(np.full(len(at), n, np.int32)),
                        pc.binary_join_element_wise(*phrase, " ") if n > 1 else phrase[0], pa.array(started), pa.array(mark), pa.array(times.astype(np.int64)),
                    ],
                    names=["lang", "words", "phrase", "started", "digest", "n"],
                )

    return shard.select("lang", "text").mapInArrow(count, COUNTED)


def count_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, words, phrase, n`` of every phrase of up to four words with ``n >= least``, exact,
    and ``lang, n``: all words of each language."""
    if not 0 < shards * LONGEST < NEVER:
        raise ValueError(f"shards must be from 1 to {NEVER // LONGEST}")
    spark, path = docs.sparkSession, deal_shards(docs, shards)
    dealt = spark.read.schema("lang string, text string, shard int").parquet(path)
    since: dict[int, np.ndarray] = {}
    open_counts, before, done, totals, scan = None, None, [], None, 0
    while True:
        needed = {n: np.flatnonzero(table != NEVER).astype(np.int32) for n, table in since.items() if _may_be_active(n + 1, scan, shards, since)}
        shared = spark.sparkContext.broadcast({n: (at, since[n][at]) for n, at in needed.items()})
        rows = scan_shard(dealt.filter(F.col("shard") == scan % shards), scan, shards, shared, bits)
        rows = rows if open_counts is None else rows.unionByName(open_counts)
        with Cuts() as now:
            merged = cut(rows.groupBy(*KEY).agg(F.sum("n").alias("n")), "phrase_counts")
        frequent = merged.filter(F.col("n") >= least)
        ended = F.col("started") + shards - 1 <= scan
        done.append(cut(frequent.filter(ended).select("lang", "words", "phrase", "n"), "phrases_done"))
        if scan == shards - 1:
            totals = cut(merged.filter("words = 1").groupBy("lang").agg(F.sum("n").alias("n")), "phrase_totals")
        for n in range(1, LONGEST):
            table = bit_table(frequent.filter(F.col("words") == n), bits) if _may_be_active(n, scan, shards, since) else None
            if table is not None and table.any():
                known, at = since.setdefault(n, np.full(1 << bits, NEVER, np.uint8)), set_bits(table, bits)
                known[at[known[at] == NEVER]] = scan + 1
        open_counts = merged.filter(~ended)
        # Whatever is still counted has been carried over to this scan's table.
        shared.destroy()
        if before is not None:
            before.delete(spark)
        before = now
        scan += 1
        if scan >= shards and not any(_may_be_active(n, scan, shards, since) for n in range(2, LONGEST + 1)):
            break
    before.delete(spark)
    remove_path(spark, path)
    return cut(reduce(DataFrame.unionByName, done), "phrases"), totals


def _may_be_active(n: int, scan: int, shards: int, since: dict[int, np.ndarray]) -> bool:
    """Whether phrases of ``n`` words can be in their cycle at this scan."""
    if n == 1:
        return scan < shards
    return n - 1 in since and bool(((since[n - 1] <= scan) & (since[n - 1] > scan - shards)).any())


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    A null lang is 'und'; null and empty texts have no words; repeated rows count as often as
    they occur; equal scores are ranked by ``a``, then by phrase in byte order; an empty table
    gives no rows; columns other than ``lang, text`` are not read.
    """
    counts, totals = count_phrases(docs, least, shards, bits)
    words = F.split("phrase", " ")
    phrases = counts.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), words.alias("w"))

    # Every cut of a phrase into two parts, each of which is frequent as the phrase is.
    at = phrases.withColumn("cut", F.explode(F.expr("sequence(1, words - 1)")))
    at = at.withColumns({"head": F.expr("array_join(slice(w, 1, cut), ' ')"), "tail": F.expr("array_join(slice(w, cut + 1, words - cut), ' ')")})
    heads, tails = (counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n)) for part, n in (("head", "l"), ("tail", "r")))
    both = at.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    million = F.lit(2_000_000).cast("decimal(10,0)")
    score = F.call_function("div", million * F.col("a"), F.col("l") + F.col("r"))
    best = F.min(F.struct(score.alias("score"), F.col("cut"), F.col("l"), F.col("r")))
    scored = both.groupBy("lang", "phrase", "a").agg(best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    # The most frequent longer phrase around each one.
    spans = F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    longer = phrases.filter("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("around"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    percent = lambda c, x: F.col(c).cast("decimal(20,0)") * F.lit(x)
    covered = F.coalesce(percent("around", 100) >= percent("a", 80), F.lit(False))
    own = scored.join(longer, ["lang", "phrase"], "left").filter(~covered).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
