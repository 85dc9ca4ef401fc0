import random
from collections import defaultdict

import brute
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix_sources, mixed_sizes
from tidemark.llm.packing import best_fit_packing, fullest, plan_bins
from tidemark.llm.queries import QUERIES


def check_mix(rows, docs):
    sizes, per_doc = defaultdict(int), defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(brute.words(text))
    want, taken = brute.targets(sizes), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        per_doc[r.source] += 1
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 1
    assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)


def test_mixing(spark, sf, documents, odd_docs, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixed_sizes(docs).collect()
    check_mix(rows, documents)
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.source or "", r.taken)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixed_sizes(docs.repartition(7)).collect()))
    check_mix(sorted(mixed_sizes(odd_docs).collect(), key=key), [(d, t, s) for d, t, _, s in odd])
    assert mixed_sizes(odd_docs.limit(0)).count() == 0
    assert sorted(QUERIES["op3_source_mixing"](spark, sf).columns) == ["doc_id", "size", "source_size", "taken", "target"]


def test_mixed_documents(spark, sf, odd_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        want = {(r.source, r.doc_id): r.taken for r in mixed_sizes(docs).groupBy("source", "doc_id").agg(F.sum("taken").alias("taken")).collect() if r.taken}
        mixed = mix_sources(docs)
        assert mixed.columns == docs.columns
        got = defaultdict(int)
        for r in mixed.collect():
            got[(r.source, r.doc_id)] += len(brute.words(r.text))
            assert r.n_chars == len(r.text)
        assert got == want


def test_mixing_with_clashing_names(spark):
    rows = [(i, "w " * (i + 1), "st"[i % 2], 2 * i + 2, i, -i, f"t{i}") for i in range(40)] + [(None, None, None, None, 1, 1, "n"), (3, "w w", None, 3, 3, 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, _size int, nth int, taken string")
    mixed = mix_sources(docs)
    assert mixed.schema == docs.schema
    given = {(r[0], r[2]): r[4:] for r in rows}
    got = mixed.collect()
    assert got and all(tuple(r)[4:] == given[(r.doc_id, r.source)] for r in got)
    assert mix_sources(docs.limit(0)).count() == 0


def check_pack(rows, docs, capacity=2048):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sorted(((d if d is not None else -1), i, *p) for d, t, *_ in docs for i, p in enumerate(brute.pieces(t, tokenizer)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing(spark, sf, documents, odd_docs, odd):
    bins, total = check_pack(QUERIES["op8_best_fit_packing"](spark, sf).collect(), documents)
    assert bins <= -(-total // 2048) * 1.01 + 1
    check_pack(best_fit_packing(odd_docs).collect(), odd)
    assert best_fit_packing(odd_docs.limit(0)).count() == 0


def test_fullest_is_the_fullest():
    rng = random.Random(5)
    for _ in range(60):
        left = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        reach = {0}
        for length, n in left.items():
            reach = {s + length * k for s in reach for k in range(n + 1)}
        top = max(left)
        best = max(s for s in reach if s + 0 <= 40)
        got = fullest(left, 40)
        assert all(got[x] <= left[x] for x in got) and top in got
        total = sum(x * n for x, n in got.items())
        with_top = {0}
        for length, n in left.items():
            with_top = {s + length * k for s in with_top for k in range(n + 1 - (length == top))}
        assert total == top + max(s for s in with_top if s + top <= 40) <= best


def test_plan_uses_everything():
    rng = random.Random(6)
    histogram = {rng.randint(1, 2048): rng.randint(1, 500) for _ in range(300)}
    plan = plan_bins(histogram)
    used = defaultdict(int)
    for combination, times in plan:
        assert sum(x * n for x, n in combination.items()) <= 2048
        for x, n in combination.items():
            used[x] += n * times
    assert used == histogram and len(plan) <= 2 * len(histogram)
