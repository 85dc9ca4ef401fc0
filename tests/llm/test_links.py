import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram_join, vector_dedup
from tidemark.llm.graph import components
from tidemark.llm.ngram_join import forest, keep_one, ngram_jaccard, overlaps
from tidemark.llm.queries import QUERIES
from tidemark.llm.vector_dedup import near_duplicate_vectors, passes_for


def linked_sets(rows):
    """Brute force over all pairs that share a shingle; keys are row numbers."""
    sets = [brute.shingles(text) for _, text in rows]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    common = Counter((a, b) for ids in holders.values() for k, b in enumerate(ids) for a in ids[:k])
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return sets, brute.components(range(len(rows)), links)


def expected(rows):
    sets, group = linked_sets(rows)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[group[i]] = min(least.get(group[i], doc_id), doc_id)
    return by_id((rows[i][0], len(sets[i]), least.get(group[i]) if sets[i] else rows[i][0]) for i in range(len(rows)))


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def got(df):
    return by_id((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)]
    frame = spark.createDataFrame([*edges, (None, 4), (7, 7)], "a long, b long")
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    want = brute.components(nodes, [e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in components(frame).collect()} == want


def test_jaccard_on_documents(spark, sf, documents):
    assert got(QUERIES["op2_ngram_jaccard"](spark, sf)) == expected([(d, t) for d, t, _ in documents])


def near_copies(n, seed):
    """A chain of edits: neighbours are alike, distant members are not; all share most words."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((1000 + i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(5000 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(rng.choice([2, 15, 19, 20, 21, 60])))) for i in range(80)]
    rows += [(7000 + i, "a b c d e") for i in range(40)] + [(7100 + i, "A b C d") for i in range(5)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_of_groups(spark, odd_docs, odd, small, monkeypatch):
    """Also with row blocks and column blocks so small that groups span many of them."""
    if small:
        monkeypatch.setattr(ngram_join, "ROWS_PER_BLOCK", 16)
        monkeypatch.setattr(ngram_join, "ENTRIES_HELD", 50)
        monkeypatch.setattr(ngram_join, "WORDS_PER_BATCH", 3000)
        monkeypatch.setattr(ngram_join, "DENSE", 4)
    rows = near_copies(150, 1) + [(d, t) for d, t, _, _ in odd]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(ngram_jaccard(frame)) == expected(rows)
    assert ngram_jaccard(odd_docs.limit(0)).count() == 0


def test_keep_one(spark):
    rows = near_copies(60, 2) + [(9000, ""), (9001, None), (9002, "one"), (9002, "one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    want = sorted({d for d, n, c in expected(rows) if n == 0 or d == c})
    kept = keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == want


def test_keep_one_decides_by_row(spark):
    t, u = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, t), (5, t), (5, u), (6, u), (6, u), (7, "z"), (7, ""), (7, ""), (None, t), (8, t + " c")]
    frame = spark.createDataFrame([(*r, i % 2, "n", 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, nth int, _nth string, others int, digest int")
    kept = keep_one(frame)
    assert kept.schema == frame.schema
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in kept.collect())
    assert got == sorted([(3, t), (5, u), (7, "z"), (7, ""), (-1, t)])
    assert keep_one(frame.limit(0)).count() == 0


def test_overlaps_and_forest():
    rng = np.random.default_rng(4)
    matrix = rng.random((70, 90)) < 0.3
    matrix[:, :10] = True
    rows, grams = np.nonzero(matrix)
    counts = overlaps(rows, grams, 70)
    want = matrix.astype(int) @ matrix.T.astype(int)
    off = ~np.eye(70, dtype=bool)
    assert (counts[off] == want[off]).all()
    linked = rng.random((70, 70)) < 0.01
    linked |= linked.T
    np.fill_diagonal(linked, False)
    pairs = list(zip(*np.nonzero(linked), strict=True))
    assert brute.components(range(70), forest(linked)) == brute.components(range(70), pairs)


def vectors(seed=8):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        centre = rng.standard_normal((12, 24))
        for i in range(240):
            noise = rng.standard_normal(24) * rng.choice([0.05, 0.2, 0.35])
            rows.append((label * 1000 + i, [float(x) for x in np.float32(centre[i % 12 if label else 0] + noise)], label))
    copy = rows[5][1]
    rows += [(9000 + i, copy, 0) for i in range(60)] + [(5, copy, 0), (None, copy, 0)]
    rows += [(9100, None, 0), (9101, [0.0] * 24, 0), (9102, [None] + [1.0] * 23, 0), (9103, [float("nan")] + [1.0] * 23, 0)]
    rows += [(9104, copy, None), (9105, [1.0, 2.0], 0), (9106, [2.0, 4.0], 0), (9107, [], 0), (9108, [float("inf")] * 24, 1)]
    return rows


def brute_vectors(rows):
    unit = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n, links = [0] * len(rows), []
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and float(a @ b) >= 0.93:
                n[i] += 1
                n[j] += 1
                links.append((j, i))
    group = brute.components(range(len(rows)), links)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[group[i]] = min(least.get(group[i], vec_id), vec_id)
    return n, [least.get(group[i]) for i in range(len(rows))]


@pytest.mark.parametrize("block", [2000, 50])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vector_dedup, "ROWS_PER_BLOCK", block)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("unit", F.lit("x")).repartition(4)
    n, component = brute_vectors(rows)
    want = by_id((v, k, c, v is not None and v == c) for (v, _, _), k, c in zip(rows, n, component, strict=True))
    found = by_id((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(frame).collect())
    assert len(found) == len(want) and sum(r[1] for r in found) >= 0.9 * sum(n)
    assert sum(a == b for a, b in zip(found, want, strict=True)) >= 0.97 * len(want)
    assert near_duplicate_vectors(frame.limit(0)).count() == 0


def test_vector_query(spark, sf):
    rows = QUERIES["op4_vector_dedup"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert passes_for(10**9) > passes_for(10**6) > passes_for(10**3) >= 4
