import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import license_scan
from tidemark.llm.license_scan import license_report
from tidemark.llm.quality import BITS, POLICIES, _repeated_words, ablations, apply_policy, measure, quality_ledger
from tidemark.llm.queries import QUERIES
from tidemark.llm.secret_scan import RULES, redact_secrets, secret_report, trigram_query


def pairs(df, *cols):
    return sorted((r.doc_id, *(r[c] for c in cols)) for r in df.collect())


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def secrets(df):
    return by_id((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in df.collect())


def test_secret_counts(spark, sf, documents, odd_docs, odd):
    assert secrets(QUERIES["op5_secret_scan"](spark, sf)) == by_id((d, *brute.secret_base(t)[:4]) for d, t, _ in documents)
    assert secrets(secret_report(odd_docs)) == by_id((d, *brute.secret_base(t)[:4]) for d, t, _, _ in odd)


def test_secret_spans_hold_the_base(spark, sf, documents):
    text = {d: t for d, t, _ in documents}
    for r in QUERIES["op5_secret_scan"](spark, sf).filter("spans <> ''").collect():
        base = [x for x in brute.secret_base(text[r.doc_id])[4].split(",") if x]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == base


def test_trigram_queries():
    assert trigram_query("abc[0-9]+def") == [frozenset({"abc", "def"})]
    assert set(trigram_query("(foo|ba_?r)x")) == {frozenset({"foo", "oox"}), frozenset({"ba_", "a_r", "_rx"}), frozenset({"bar", "arx"})}
    assert trigram_query("[0-9a-f]{24,}") is None
    by_kind = {r.kind: trigram_query(r.pattern) for r in RULES}
    assert by_kind["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in by_kind["assign"] and len(by_kind["assign"]) == 6


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "x token=abcdefgh y", 18), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in redact_secrets(docs).collect()}
    assert got == {1: ("x [secret] y", 12), 2: ("clean", 5), 3: (None, None)}


def quality_rows(df):
    return by_id((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect())


def test_quality(spark, sf, documents, odd_docs, odd):
    assert quality_rows(QUERIES["op6_quality_rules"](spark, sf)) == by_id((d, *brute.quality(t)) for d, t, _ in documents)
    assert quality_rows(apply_policy(quality_ledger(odd_docs))) == by_id((d, *brute.quality(t)) for d, t, _, _ in odd)
    assert measure(odd_docs.limit(0)).count() == 0


def test_ablations(spark, sf):
    ledger = quality_ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    bits = [r.failures for r in ledger.collect()]
    for r in ablations(ledger).collect():
        mask, bit = POLICIES[r.policy], BITS[r.rule]
        assert (r.n_fail, r.n_alone) == (sum(b & mask & bit != 0 for b in bits), sum(b & mask == bit for b in bits))
        assert (r.n_kept, r.n_kept_without) == (sum(b & mask == 0 for b in bits), sum(b & mask & ~bit == 0 for b in bits))


def license_rows(df):
    return by_id((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect())


def test_licenses(spark, sf, documents, odd_docs, odd):
    assert license_rows(QUERIES["op7_license_scan"](spark, sf)) == by_id((d, *brute.licenses(t)) for d, t, _ in documents)
    assert license_rows(license_report(odd_docs)) == by_id((d, *brute.licenses(t)) for d, t, _, _ in odd)


def test_license_votes_survive_edits(spark):
    texts = {
        1: "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files",
        2: "all rights reserved", 3: "all rights are reserved", 4: "permission is granted to copy",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_report(docs).collect()}
    assert got[1][0] == "mit-text" and 0.8 < got[1][1] < 1
    assert got[2] == ("reserved", 1.0) and got[3] == ("", 0.0) and got[4] == ("", 0.0)


def test_repeated_license_texts(spark):
    texts = {1: "all rights reserved " * 5, 2: "all rights reserved " * 400, 3: "all rights all rights all rights", 4: "all rights so reserved"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_report(docs).collect()}
    assert got[1] == got[2] == ("reserved", 1.0) and got[3] == got[4] == ("", 0.0)


def test_license_texts_are_read_and_split_once(spark, tmp_path, monkeypatch):
    """Whatever stands at either end of a text; pairs of the templates have their word places."""
    texts = ["", "--", "The MIT License", "...mit license...", "x\u00e9 MIT--license\nall rights reserved!", "mit", None]
    path = str(tmp_path / "license-texts")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    plans, cut = [], license_scan.cut
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(license_scan, "cut", lambda df, name: plans.append(text(df)) or cut(df, name))
    report = license_report(spark.read.parquet(path))
    plans.append(text(report))
    assert sum(p.count("text:string>") for p in plans) == 1 and not any("regexp" in p for p in plans)
    assert sum(p.count("split(") for p in plans) == 1
    got = {r.doc_id: (r.n_words, r.first_word, r.labels) for r in report.collect()}
    assert got == {0: (0, None, ""), 1: (0, None, ""), 2: (3, 1, "mit"), 3: (2, 0, "mit"), 4: (6, 1, "mit,reserved"), 5: (1, None, ""), 6: (0, None, "")}


def test_signed_tokens(spark):
    part = "eyJabcdefgh"
    texts = {
        1: part * 40_000, 2: f"x{part}.abcdefgh.abcdefgh-_ y", 3: f"{part}.{part}.short {part}.{part}.{part}.{part}", 4: f"{part}.abcdefgh", 5: (part + ".") * 4_000,
        6: "eyJshort.abcdefgh.abcdefgh",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {}
    for doc_id, text in texts.items():  # RE2-like leftmost search, run by run
        found = re.finditer(r"eyJ[A-Za-z0-9_-]{8,}+(\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)?", text)
        want[doc_id] = ",".join(f"signed_token:{m.start()}:{m.end()}" for m in found if m.group(1))
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    for doc_id in (2, 3, 4, 5, 6):
        assert want[doc_id] == ",".join(f"signed_token:{m.start()}:{m.end()}" for m in plain.finditer(texts[doc_id]))
    assert want[1] == "" and {r.doc_id: r.spans for r in secret_report(docs).collect()} == want


def test_redaction_with_clashing_names(spark):
    rows = [(1, "x token=abcdefgh y", 18, 7, "r", True, 5, "at")] * 2 + [(None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _row int, _rules string, _found boolean, changed int, others string")
    got = redact_secrets(docs)
    assert got.schema == docs.schema
    want = [(1, "x [secret] y", 12, 7, "r", True, 5, "at")] * 2 + [rows[2]]
    assert by_id(map(tuple, got.collect())) == by_id(want)
    assert redact_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("report", [secret_report, license_report])
def test_empty(odd_docs, report):
    assert report(odd_docs.limit(0)).count() == 0


def test_repeated_words_do_not_rest_on_hashes(spark):
    """With 60 bits given to places, 4 are left for hashes: nearly all windows collide."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") + rng.choice("uvwxyz") for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 60, 300, 3000)]
    docs = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id long, words array<string>")
    got = {r.doc_id: r.n for r in docs.select("doc_id", _repeated_words(F.col("words"), 60).alias("n")).collect()}
    assert got == {i: brute.quality(t)[4] for i, t in enumerate(texts)}
