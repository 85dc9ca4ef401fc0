"""Benchmark decontamination by a broadcast set of normalised test n-grams.

The n-grams of all benchmark items go to every task while their number is within ``held``.
Windows of a document whose digest is in the set are verified word by word. A larger set
stays in Spark: tasks then get a bit table of fixed size, and only windows that pass it are
joined to the n-grams by their text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bitmap import bit_table, passes
from tidemark.llm.common import cut
from tidemark.llm.tokens import ALPHANUMERIC, Words, digests, find_words, portions_by_size, rolled

WINDOW = 10
HELD = 200_000
BITS = 24
SPANS = "array<struct<first: bigint, last: bigint>>"
RUNS = T.ArrayType(T.StructType().add("first", "long").add("last", "long"))
ITEM_SCHEMA = "item string, words int, window string, digest long"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``item, words, window, digest``: every ``window`` words in a row of an item,
    or all words of a shorter one. A null ``item_id`` is the item ''."""

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions_by_size(batches, "text"):
            found = find_words(batch.column(1), ALPHANUMERIC)
            words, word_digests = found.words.to_pylist(), digests(found.words)
            sizes = np.bincount(found.row, minlength=batch.num_rows)
            firsts = np.cumsum(sizes) - sizes
            rows = []
            for item, first, size in zip(batch.column(0).to_pylist(), firsts.tolist(), sizes.tolist(), strict=True):
                n = min(size, window)
                if n:
                    marks = rolled(word_digests[first : first + size], n).view(np.int64).tolist()
                    rows += [(item, n, " ".join(words[first + i : first + i + n]), mark) for i, mark in enumerate(marks)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)],
                    names=["item", "words", "window", "digest"],
                )

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(cut_items, ITEM_SCHEMA).distinct()


def _windows_at(found: Words, lengths: dict[int, np.ndarray], bits: int) -> Iterator[tuple[int, int, str]]:
    """Place, number of words and text of the windows whose bit is set."""
    if not len(found.row):
        return
    codes, distinct = found.coded()
    marks = digests(distinct)[codes]
    for n, table in lengths.items():
        at = np.flatnonzero(passes(table, rolled(marks, n), bits))
        at = at[found.row[at] == found.row[at + n - 1]]
        for i in at.tolist():
            yield i, n, " ".join(found.words.slice(i, n).to_pylist())


def _runs(hit: np.ndarray, row: np.ndarray, rows: int) -> list[list[dict[str, int]]]:
    """First and last word of each run of hit words, by row."""
    firsts = np.searchsorted(row, np.arange(rows))
    edge = np.ones(len(hit), bool)
    edge[1:] = ~hit[:-1] | (row[1:] != row[:-1])
    begins = np.flatnonzero(hit & edge)
    closes = np.flatnonzero(hit & np.append(edge[1:] | ~hit[1:], True))
    out: list[list[dict[str, int]]] = [[] for _ in range(rows)]
    for a, b in zip(begins.tolist(), closes.tolist(), strict=True):
        r = row[a]
        out[r].append({"first": int(a - firsts[r]), "last": int(b - firsts[r])})
    return out


_RUN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _tables(windows: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """A bit table for each number of words that a window has, of which there are few."""
    sizes = sorted(r[0] for r in windows.select("words").distinct().collect())
    return {n: bit_table(windows.filter(F.col("words") == n), bits) for n in sizes}


def _scan_held(packed: DataFrame, windows: DataFrame, bits: int) -> DataFrame:
    holders: dict[str, list[str]] = {}
    for r in windows.select("window", "item").toArrow().to_pylist():
        holders.setdefault(r["window"], []).append(r["item"])
    lengths = _tables(windows, bits)
    shared = packed.sparkSession.sparkContext.broadcast((lengths, holders))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, holders = shared.value
        for batch in portions_by_size(batches, "text"):
            found = find_words(batch.column(1), ALPHANUMERIC)
            hit = np.zeros(len(found.row), bool)
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for at, n, window in _windows_at(found, lengths, bits):
                if window in holders:
                    hit[at : at + n] = True
                    items[found.row[at]].update(holders[window])
            counts = np.bincount(found.row, minlength=batch.num_rows)
            hits = np.bincount(found.row[hit], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array(_runs(hit, found.row, batch.num_rows), _RUN),
                ],
                names=["doc", "n_words", "n_hit", "items", "spans"],
            )

    schema = T.StructType([packed.schema["doc"]]).add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", RUNS)
    return packed.mapInArrow(scan, schema)


def _merge(spans: Column, mark: Column) -> Column:
    """Spans with one more window, whose place is not before that of any earlier one."""
    end = mark["at"] + mark["words"] - 1
    top = F.element_at(spans, -1)
    grown = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], end).alias("last"))))
    apart = F.concat(spans, F.array(F.struct(mark["at"].alias("first"), end.alias("last"))))
    return F.when((F.size(spans) > 0) & (mark["at"] <= F.try_element_at(spans, F.lit(-1))["last"] + 1), grown).otherwise(apart)


def _scan_joined(packed: DataFrame, windows: DataFrame, bits: int) -> DataFrame:
    shared = packed.sparkSession.sparkContext.broadcast(_tables(windows, bits))
    passing = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.int64()), ("window", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions_by_size(batches, "text"):
            found = find_words(batch.column(1), ALPHANUMERIC)
            firsts = np.searchsorted(found.row, np.arange(batch.num_rows))
            passed: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for at, n, window in _windows_at(found, shared.value, bits):
                row = found.row[at]
                passed[row].append({"at": int(at - firsts[row]), "words": n, "window": window})
            counts = np.bincount(found.row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(passed, passing)], names=["doc", "n_words", "passed"])

    passing_type = T.ArrayType(T.StructType().add("at", "long").add("words", "long").add("window", "string"))
    schema = T.StructType([packed.schema["doc"]]).add("n_words", "long").add("passed", passing_type)
    # The number is fixed once the table is written.
    scanned = cut(packed.mapInArrow(scan, schema).withColumn("row", F.monotonically_increasing_id()), "windows")
    marks = scanned.select("row", F.explode("passed").alias("mark")).select("row", "mark.*")
    hits = marks.join(windows.select("window", "item"), "window")
    found = hits.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("at", "words"))).alias("marks"), F.array_sort(F.collect_set("item")).alias("items")
    )
    spans = F.aggregate("marks", F.expr(f"cast(array() as {SPANS})"), _merge)
    found = found.select("row", "items", spans.alias("spans"))
    words = F.aggregate("spans", F.expr("0L"), lambda n, s: n + s["last"] - s["first"] + 1)
    out = scanned.drop("passed").join(found, "row", "left").withColumn("n_hit", F.coalesce(words, F.expr("0L")))
    empty = {"items": F.expr("cast(array() as array<string>)"), "spans": F.expr(f"cast(array() as {SPANS})")}
    return out.select("doc", "n_words", "n_hit", *[F.coalesce(c, e).alias(c) for c, e in empty.items()])


def scan_benchmark(
    docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] | None = None, window: int = WINDOW, held: int = HELD, bits: int = BITS
) -> DataFrame:
    """``doc`` (a struct of the columns ``keep``, all by default), ``n_words``, ``n_hit``,
    ``items`` (sorted ids as text of items with a window in the text) and ``spans`` (first
    and last word of each run of hit words, from 0).

    Null and empty texts have no words and no hits; every row, repeated ones too, gets its
    own result; windows and items that are equal count once; an empty benchmark hits
    nothing; an empty table gives no rows. Other columns may have any names.
    """
    windows = cut(item_windows(benchmark, window), "benchmark_windows")
    packed = docs.select(F.struct(*(keep or docs.columns)).alias("doc"), F.col("text"))
    return _scan_held(packed, windows, bits) if windows.count() <= held else _scan_joined(packed, windows, bits)


def decontaminate(docs: DataFrame, benchmark: DataFrame, documents: bool = False, window: int = WINDOW, held: int = HELD) -> DataFrame:
    """``docs`` without benchmark passages, with its own columns. ``documents`` drops every
    document that holds one; otherwise the text from the first to the last word of each run
    goes, and ``n_chars``, if there is such a column, follows."""
    scanned = scan_benchmark(docs, benchmark, None, window, held)
    if documents:
        return scanned.filter("n_hit = 0").select("doc.*")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions_by_size(batches, "text"):
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, runs in enumerate(spans):
                if runs:
                    found, whole = find_words(batch.column(1).slice(i, 1), ALPHANUMERIC), texts[i].encode()
                    edges = [0, *[x for r in runs for x in (int(found.start[r["first"]]), int(found.end[r["last"]]))], len(whole)]
                    texts[i] = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    packed = scanned.select("doc", F.col("doc.text").alias("text"), "spans")
    cleaned = packed.mapInArrow(clean, T.StructType([packed.schema["doc"], packed.schema["text"]]))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, held: int = HELD) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    scanned = scan_benchmark(docs, benchmark, ["doc_id"], window, held)
    return scanned.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
