"""Benchmark decontamination, source divergence and phrase collocations against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.decontamination import contamination, decontaminate, scan_benchmark
from tidemark.llm.divergence import source_divergence
from tidemark.llm.phrases import collocations, count_phrases
from tidemark.llm.tokens import ALPHANUMERIC, LETTERS, SPACED, digests, find_words, portions_by_size, rolled

DOCS = "doc_id long, text string, lang string, source string"
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def windows(text, n=10):
    w = ITEM_WORD.findall(brute.lowered(text))
    return {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} - {()}


def contaminated(doc_id, text, items):
    w = ITEM_WORD.findall(brute.lowered(text))
    hit, ids = set(), set()
    for item, parts in items:
        for n in {len(p) for p in parts}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in parts:
                    hit.update(range(i, i + n))
                    ids.add("" if item is None else str(item))
    return doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


ITEMS = [
    (1, "One two THREE four five six seven eight nine ten eleven twelve"), (2, "ein, zwei."), (10, "one two three"), (None, "zwölf é12"),
    (3, ""), (4, None), (5, "... !"), (10, "one two three"), (2, "ein zwei"), (7, " ".join(["same"] * 30)),
]
PASSAGES = [
    (1, "before One two three, four-five six seven eight nine ten eleven twelve after", "en", "s"), (2, "one two\nthree ein", "en", "s"),
    (2, "nothing here", None, None), (None, "EIN zwei ein ZWEI", "de", "s"), (3, "zwölf É12 zwölf é12", "fr", "s"), (4, " ".join(["same"] * 9), "en", "t"),
    (5, " ".join(["same"] * 400), "en", "t"), (5, " ".join(["same"] * 400), "en", "t"), (6, "one two three four five six seven eight nine ten x eleven twelve", "en", "t"),
]


@pytest.mark.parametrize("held", [1000, 0])
def test_contamination(spark, odd_docs, odd, held):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(PASSAGES, DOCS).unionByName(odd_docs.select("doc_id", "text", "lang", "source"))
    want = [contaminated(d, t, [(i, windows(x)) for i, x in ITEMS]) for d, t, *_ in PASSAGES + odd]
    assert rows(contamination(docs, items, held=held)) == ordered(want)
    assert sum(r[5] for r in want) > 6
    assert contamination(docs.limit(0), items, held=held).count() == 0
    assert contamination(docs, items.limit(0), held=held).filter("contaminated").count() == 0


@pytest.mark.parametrize("held", [1000, 0])
def test_spans_and_removal(spark, held):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clash = {c: F.lit(7) for c in ("doc", "n_words", "items", "spans", "row")}
    docs = spark.createDataFrame(PASSAGES, DOCS).withColumns(clash | {"n_chars": F.length("text").cast("int")})
    spans = {r.doc.text: [tuple(s) for s in r.spans] for r in scan_benchmark(docs, items, held=held).collect()}
    assert spans[PASSAGES[0][1]] == [(1, 12)] and spans[PASSAGES[8][1]] == [(0, 9)] and spans["EIN zwei ein ZWEI"] == [(0, 3)]
    assert spans["one two\nthree ein"] == [(0, 2)] and spans["nothing here"] == []
    left = decontaminate(docs, items, held=held)
    assert left.schema.names == docs.columns and left.dtypes == docs.dtypes
    texts = sorted((r.doc_id or 0, r.text, r.n_chars) for r in left.collect())
    assert texts == [(0, "", 0), (1, "before  after", 13), (2, " ein", 4), (2, "nothing here", 12), (3, "zwölf É12 ", 10), (4, " ".join(["same"] * 9), 44), (5, "", 0), (5, "", 0), (6, " x eleven twelve", 16)]
    clean = decontaminate(docs, items, documents=True, held=held)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4] and clean.columns == docs.columns


def divergence(docs, least, top):
    texts = [(lang or "", source or "", TERM.findall(brute.lowered(text))) for text, lang, source in docs]
    out = []
    for lang in {x[0] for x in texts}:
        mine = [x for x in texts if x[0] == lang]
        kept = {t for t, n in Counter(t for _, _, w in mine for t in set(w)).items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, w in mine:
            counts[source].update(t for t in w if t in kept)
        everything = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for source, c in counts.items():
            pairs = [(-sum(abs(share(c, t) - share(o, t)) for t in kept), other.encode(), other) for other, o in counts.items() if other != source]
            terms = [(share(everything, t) - share(c, t), t.encode(), t) for t in kept if c[t] and share(c, t) > share(everything, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(sorted(found)[:most])]
    return ordered(out)


def test_divergence(spark, odd_docs, odd):
    rng = random.Random(3)
    made = [
        (" ".join(rng.choice(["The", "of", "Été", "x1y", "rare" + rng.choice("abcdefghij"), "Ünder", "ünder"]) for _ in range(rng.randrange(12))), rng.choice(["en", None, "fr"]), rng.choice(["s", "t", "u", None, "é"]))
        for _ in range(150)
    ]
    docs = spark.createDataFrame(made, "text string, lang string, source string").unionByName(odd_docs.select("text", "lang", "source")).withColumn("digest", F.lit(1))
    plain = made + [(t, lang, s) for _, t, lang, s in odd]
    want = divergence(plain, 5, 3)
    assert rows(source_divergence(docs, 5, 3)) == want
    # clashing digests, few bits, many blocks and slices
    assert rows(source_divergence(docs, 5, 3, bits=3, block=2, slice_cells=4, digest_bits=2)) == want
    # languages without kept terms, equal values, and none at all
    assert rows(source_divergence(docs, 1000, 3)) == divergence(plain, 1000, 3)
    assert source_divergence(docs.limit(0)).count() == 0


def phrases(docs, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if 100 * around[p] < 80 * a:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return ordered(out)


@pytest.mark.parametrize("shards,bits", [(3, 20), (1, 20), (2, 7)])
def test_collocations(spark, odd_docs, odd, shards, bits):
    rng = random.Random(5)
    names = ["a", "B", "é", "x-1", "[y]", "the", "of"]
    made = [("".join(rng.choice(names) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ";"]) for _ in range(rng.randrange(40))), rng.choice(["en", None, "fr"])) for _ in range(120)]
    docs = spark.createDataFrame(made, "text string, lang string").unionByName(odd_docs.select("text", "lang")).withColumn("words", F.lit(1)).repartition(5)
    assert rows(collocations(docs, 8, 60, shards, bits)) == phrases(made + [(t, lang) for _, t, lang, _ in odd], 8, 60)


def test_no_phrases(spark):
    docs = spark.createDataFrame([("", "en"), (None, "en"), ("a b c", None)], "text string, lang string")
    assert collocations(docs).count() == 0 and collocations(docs.limit(0)).count() == 0
    counts, totals = count_phrases(docs, 1)
    assert counts.count() == 6 and [tuple(r) for r in totals.collect()] == [("und", 3)]


def test_words_of_bytes():
    texts = ["A-b c1", None, "", "é.É!x", "x", "y y\n;y"]
    for kinds, pattern in ((ALPHANUMERIC, ITEM_WORD), (LETTERS, TERM)):
        found = find_words(pa.array(texts), kinds)
        want = [(i, w) for i, t in enumerate(texts) for w in pattern.findall(brute.lowered(t))]
        assert list(zip(found.row.tolist(), found.words.to_pylist(), strict=True)) == want
    found = find_words(pa.array(["zz"] + texts).slice(1), SPACED)
    assert [found.words.to_pylist(), np.unique(found.piece, return_inverse=True)[1].tolist()] == [["a-b", "c1", "é", "É", "x", "x", "y", "y", "y"], [0, 0, 1, 2, 3, 4, 5, 5, 6]]
    marks = digests(pa.array(["pad", "a", "b", "ab", "ba"]).slice(1))
    assert len(set(marks.tolist())) == 4 and marks[0] == digests(pa.array(["a"]))[0]
    assert rolled(marks, 2)[0] == rolled(digests(pa.array(["a", "b"])), 2)[0] and len(rolled(marks, 5)) == 0
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 5, 5, 0)])], names=["text"])
    assert [b.num_rows for b in portions_by_size(iter([batch]), "text", 10)] == [1, 1, 3]
