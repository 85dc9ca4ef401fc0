"""Source divergence audit with late string materialization.

Terms travel as 64-bit digests. A first pass counts the documents of each digest; digests
that reach the threshold make a bit table of fixed size, and a second pass writes the counts
of what passes it. The counts are shuffled without their strings. The smallest and largest
string of a digest tell whether it stands for one term; a digest that does not is counted
again by string. Strings are joined back for the terms that are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bitmap import bit_table, passes
from tidemark.llm.common import cut, number_in_groups
from tidemark.llm.tokens import LETTERS, digests, find_words, portions_by_size

DOCS_NEEDED = 30
TOP = 50
BITS = 24
BLOCK = 64
SLICE_CELLS = 50_000
HELD_ROWS = 1_000_000
TERM = ["lang", "digest", "split"]


def _digested(words: pa.StringArray, digest_bits: int) -> np.ndarray:
    return digests(words) << np.uint64(64 - digest_bits)


def document_counts(docs: DataFrame, digest_bits: int = 64) -> DataFrame:
    """``lang, digest, docs``: documents of each digest, strings left behind."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions_by_size(batches, "text"):
            found = find_words(batch.column(1), LETTERS)
            if not len(found.row):
                continue
            codes, terms = found.coded()
            lang = batch.column(0).dictionary_encode()
            held = np.unique(found.row * len(terms) + codes)
            keys, n = np.unique(lang.indices.to_numpy()[held // len(terms)].astype(np.int64) * len(terms) + held % len(terms), return_counts=True)
            mark = _digested(terms, digest_bits)[keys % len(terms)]
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(keys // len(terms))), pa.array(mark.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "digest", "docs"]
            )

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, digest long, docs long")
    return counted.groupBy("lang", "digest").agg(F.sum("docs").alias("docs"))


def term_counts(docs: DataFrame, passing: np.ndarray, bits: int, digest_bits: int = 64, named: bool = False) -> DataFrame:
    """``lang, source, digest, term, n, docs`` of the digests that pass, a few rows per task and
    digest. ``term`` is set where a task meets a term for the first time, or always if
    ``named``."""
    shared = docs.sparkSession.sparkContext.broadcast(passing)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(named)
        for batch in portions_by_size(batches, "text"):
            found = find_words(batch.column(2), LETTERS)
            if not len(found.row):
                continue
            codes, terms = found.coded()
            marks = _digested(terms, digest_bits)
            known = passes(shared.value, marks, bits)
            number = np.cumsum(known) - 1
            terms, marks, kept = terms.filter(pa.array(known)), marks[known], known[codes]
            codes, row = number[codes[kept]], found.row[kept]
            if len(codes):
                in_text, n = np.unique(row * len(terms) + codes, return_counts=True)
                yield from held.add(batch.column(0), batch.column(1), in_text // len(terms), in_text % len(terms), terms, marks, n)
        yield from held.empty()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, digest long, term string, n long, docs long")


class Held:
    """Counts of a task that have not been handed on, by number of group and term."""

    def __init__(self, named: bool):
        self._named = named
        self._clear()

    def _clear(self) -> None:
        self._groups: dict[tuple[str, str], int] = {}
        self._terms: dict[str, int] = {}
        self._marks: list[int] = []
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._rows = 0

    def add(self, lang: pa.Array, source: pa.Array, row: np.ndarray, code: np.ndarray, terms: pa.Array, marks: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.array([self._groups.setdefault(g, len(self._groups)) for g in zip(lang.to_pylist(), source.to_pylist(), strict=True)])
        before = len(self._terms)
        number = np.array([self._terms.setdefault(t, len(self._terms)) for t in terms.to_pylist()])
        fresh = number >= before
        self._marks += marks[fresh][np.argsort(number[fresh])].tolist()
        self._part(group[row] << 40 | number[code], n, np.ones(len(n), np.int64))
        if self._rows > HELD_ROWS:
            self._merge()
        if self._rows > HELD_ROWS // 2 or len(self._terms) > HELD_ROWS:
            yield from self.empty()

    def _part(self, keys: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        keys, at = np.unique(keys, return_inverse=True)
        self._parts.append((keys, np.bincount(at, weights=n).astype(np.int64), np.bincount(at, weights=docs).astype(np.int64)))
        self._rows += len(keys)

    def _merge(self) -> None:
        parts, self._parts, self._rows = self._parts, [], 0
        self._part(*(np.concatenate(column) for column in zip(*parts, strict=True)))

    def empty(self) -> Iterator[pa.RecordBatch]:
        if not self._parts:
            return
        self._merge()
        keys, n, docs = self._parts[0]
        group, number = keys >> 40, keys & ((1 << 40) - 1)
        term = pa.array(list(self._terms), pa.string()).take(pa.array(number))
        if not self._named:
            first = np.zeros(len(keys), bool)
            first[np.unique(number, return_index=True)[1]] = True
            term = pc.if_else(pa.array(first), term, pa.scalar(None, pa.string()))
        lang, source = (pa.array([g[i] for g in self._groups], pa.string()).take(pa.array(group)) for i in (0, 1))
        mark = np.array(self._marks, np.uint64)[number].view(np.int64)
        whole = pa.RecordBatch.from_arrays([lang, source, pa.array(mark), term, pa.array(n), pa.array(docs)], names=["lang", "source", "digest", "term", "n", "docs"])
        self._clear()
        for at in range(0, whole.num_rows, 50_000):
            yield whole.slice(at, 50_000)


def part_per_billion(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in decimals; null without terms."""
    billion = F.lit(1_000_000_000).cast("decimal(10,0)")
    share = F.call_function("div", billion * (count + F.lit(5)), F.nullif(total + F.lit(5) * terms, F.lit(0)))
    return (share + F.lit(1)).cast("long")


def split_counts(docs: DataFrame, written: DataFrame, names: DataFrame, bits: int, digest_bits: int) -> DataFrame:
    """``lang, source, digest, split, n, docs``. ``split`` is null but for digests of more than
    one term, where it is the term: those alone are counted once more, by string."""
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    one = written.groupBy("lang", "source", "digest").agg(*sums).withColumn("split", F.lit(None).cast("string"))
    clashing = names.filter("low <> high").select("digest")
    if clashing.isEmpty():
        return one
    again = term_counts(docs, bit_table(clashing, bits), bits, digest_bits, named=True).join(clashing, "digest", "left_semi")
    split = again.withColumnRenamed("term", "split").groupBy("lang", "source", "digest", "split").agg(*sums)
    return one.join(clashing, "digest", "left_anti").unionByName(split)


def _pair_sums(cells: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """``lang, a, b, total, terms`` for sources numbered ``a < b``: the sum of differences over
    the terms that either block of sources holds, and how many terms those are.

    Blocks of sources meet slice of terms by slice, so no task holds more than a slice of one
    pair of blocks, and no pair is written per term.
    """
    spread = ["lang", "slice", "low", "high"]
    sized = groups.select("lang", "slices", "sources").distinct()

    def to_blocks(df: DataFrame) -> DataFrame:
        here = F.floor(F.col("idx") / block).cast("int")
        partners = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / block).cast("int")))
        return df.withColumn("_here", here).withColumn("_other", partners).withColumns(
            {"low": F.least("_here", "_other"), "high": F.greatest("_here", "_other")}
        ).drop("_here", "_other")

    cells = to_blocks(cells.withColumn("slice", F.pmod(F.xxhash64("digest"), "slices").cast("int")))
    heads = groups.join(sized, ["lang", "slices", "sources"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    heads = to_blocks(heads).withColumns({"digest": F.expr("0L"), "split": F.lit(None).cast("string"), "p": F.col("p0"), "head": F.lit(True)})
    columns = [*spread, "idx", "digest", "split", "p", "head"]
    rows = cells.withColumn("head", F.lit(False)).select(*columns).unionByName(heads.select(*columns))

    def add_up(batch: pa.Table) -> pa.Table:
        lang, part, low, high = (batch[c][0].as_py() for c in spread)
        idx, p, head = (batch[c].to_numpy() for c in ("idx", "p", "head"))
        sides = {s: np.sort(idx[head & (idx // block == s)]) for s in (low, high)}
        body = ~head
        split = batch["split"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        term = np.unique(np.stack([batch["digest"].to_numpy()[body], split[body].astype(np.int64)]), axis=1, return_inverse=True)
        terms, code = term[0].shape[1], term[1].reshape(-1)

        def dense(side: int) -> np.ndarray:
            order = np.argsort(idx[head])
            start = p[head][order][np.isin(idx[head][order], sides[side])]
            out = np.tile(np.nan_to_num(start).astype(np.int64), (terms, 1))
            mine = idx[body] // block == side
            out[code[mine], np.searchsorted(sides[side], idx[body][mine])] = p[body][mine]
            return out

        left, right = dense(low), dense(high)
        a, b, total = [], [], []
        for i, source in enumerate(sides[low]):
            others = np.flatnonzero(sides[high] > source)
            a.append(np.full(len(others), source))
            b.append(sides[high][others])
            total.append(np.abs(right[:, others] - left[:, i : i + 1]).sum(axis=0))
        a, b, total = (np.concatenate(x).astype(np.int64) for x in (a, b, total))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "total": total, "terms": np.full(len(a), terms, np.int64)})

    partial = rows.groupBy(*spread).applyInArrow(add_up, "lang string, a long, b long, total long, terms long")
    return partial.groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("terms").alias("terms"))


def source_divergence(
    docs: DataFrame, docs_needed: int = DOCS_NEEDED, top: int = TOP, bits: int = BITS, block: int = BLOCK,
    slice_cells: int = SLICE_CELLS, digest_bits: int = 64,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language stands
    from each other one (part ``pair``), and the ``top`` terms by which it stands out from
    the language as a whole (part ``term``).

    Null text, lang and source are ''. A language without kept terms has pairs of value 0.
    Equal values are ranked by item in byte order. Repeated rows count as often as they
    occur; an empty table gives no rows; other columns are not read. ``digest_bits`` below 64
    makes digests clash, for tests.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    passing = bit_table(document_counts(docs, digest_bits).filter(F.col("docs") >= docs_needed), bits)
    written = cut(term_counts(docs, passing, bits, digest_bits), "term_counts")
    named = written.filter("term is not null").select("digest", "term")
    names = cut(named.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "term_names")
    whole = Window.partitionBy(*TERM)
    counted = split_counts(docs, written, names, bits, digest_bits).withColumns({"n_lang": F.sum("n").over(whole), "docs_lang": F.sum("docs").over(whole)})
    cells = cut(counted.filter(F.col("docs_lang") >= docs_needed).drop("docs", "docs_lang"), "term_cells")

    # One row per group, with what all its terms need.
    of_lang = cells.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("cells"))
    kinds = cells.select(*TERM).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    zero = F.expr("0L")
    groups = (
        groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(sources, "lang").join(of_lang, "lang", "left").join(kinds, "lang", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("total", "lang_total", "cells", "kept")})
        .withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("cells") / slice_cells)).cast("int"))
        .withColumn("p0", part_per_billion(zero, F.col("total"), F.col("kept")))
    )
    groups = cut(groups, "term_groups")
    groups = cut(number_in_groups(groups, ["lang"], ["source"], groups.count(), "idx"), "term_groups")

    placed = cells.join(groups.drop("cells", "p0", "rows"), ["lang", "source"]).withColumn("p", part_per_billion(F.col("n"), F.col("total"), F.col("kept")))
    ranked = Window.partitionBy("lang", "source")
    above = placed.withColumn("value", F.col("p") - part_per_billion(F.col("n_lang"), F.col("lang_total"), F.col("kept"))).filter("value > 0")
    # Ties at the end stay until the strings that part them are there.
    leading = above.withColumn("_rank", F.rank().over(ranked.orderBy(F.desc("value")))).filter(F.col("_rank") <= top)
    listed = leading.join(names, "digest").withColumn("item", F.coalesce("split", "low"))
    order = ranked.orderBy(F.desc("value"), F.asc("item"))
    terms = listed.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    one, other = (groups.select("lang", F.col("idx").alias(i), F.col("source").alias(s), F.col("p0").alias(p), *more) for i, s, p, more in (("a", "source", "p_a", ["kept"]), ("b", "item", "p_b", [])))
    apart = _pair_sums(placed, groups, block).join(one, ["lang", "a"]).join(other, ["lang", "b"])
    rest = (F.col("kept") - F.col("terms")) * F.abs(F.coalesce(F.col("p_a") - F.col("p_b"), zero))
    apart = apart.select("lang", "source", "item", (F.col("total") + rest).alias("value"))
    both = apart.unionByName(apart.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
