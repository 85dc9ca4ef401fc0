import hashlib
import re
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm.packing import tokenized_pieces
from tidemark.llm.personal_data import emails, luhn, personal_data
from tidemark.llm.queries import QUERIES
from tidemark.llm.toxicity import drop_toxic, lexicon, toxicity


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def personal(text):
    """The contract's patterns as they are written."""
    text = text or ""
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[^0-9]", "", m.group())]
        double = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 16 <= len(digits) <= 19 and (sum(digits[::-2]) + double) % 10 == 0:
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m.group())) <= 15]
    spans = ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, m in found)
    return (*(sum(k == kind for k, _ in found) for kind in ("email", "ip", "card", "phone")), hashlib.sha256(spans.encode()).hexdigest())


def personal_rows(df):
    return by_id((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in df.collect())


HARD = [
    "a@b.c@d.e f@g.h. @x.y z@ q@w", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1 0255.0.0.1 9999999.1.1.1", "4111 1111-1111 1111 2 4111111111111111",
    "+1 (017) 555-7713 +12 +1........2 +44 20 7946 0958. ++49-30-1234567", "é@b.co \U0001F600 x.y+z%w@aa-b.cc-d.e", "1" * 5000, "@" * 50, "a" * 20000 + " b@c.d",
]


def test_personal_base(spark, sf, documents, odd_docs, odd):
    assert personal_rows(QUERIES["op10_personal_data"](spark, sf)) == by_id((d, *personal(t)) for d, t, _ in documents)
    assert personal_rows(personal_data(odd_docs)) == by_id((d, *personal(t)) for d, t, _, _ in odd)
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    assert personal_rows(personal_data(hard)) == by_id((i, *personal(t)) for i, t in enumerate(HARD))
    assert personal_data(odd_docs.limit(0)).count() == 0
    assert luhn("4111111111111111") and not luhn("4111111111111112") and emails("x@y") == []


def test_contexts_find_what_no_format_describes(spark):
    texts = [f"please call me at +1 (555) 010-{i:04d} today" for i in range(40)]
    texts += ["please call me at 555-0199 now", "please call me at 555-0173 now", "room 555-0198 is free"]
    texts += [f"page {i} of {i + 1} and more" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {r.doc_id: r.spans for r in personal_data(docs).collect() if "context_" in r.spans}
    assert added == {40: "context_phone:18:26", 41: "context_phone:18:26"}


def test_contexts_of_long_tokens(spark):
    """A token of any length takes part; only its shape is shortened."""
    long_ = "555-0199" + "a" * 200
    texts = [f"please call me at +1 (555) 010-{i:04d} today" for i in range(40)]
    texts += [f"please call me at {long_} now", f"please call me at {long_} now, again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {r.doc_id: r.spans for r in personal_data(docs).collect() if "context_" in r.spans}
    assert added == {i: f"context_phone:18:{18 + len(long_)}" for i in (40, 41)}


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    hit = sum(r.predicted for r in held if r.toxic == 1)
    assert hit >= 0.85 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if r.toxic == 0) <= 0.02 * len(held)
    # Labels of the held-out fold change nothing.
    changed = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity(docs, changed).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_copies_of_a_clean_text_count_once(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"badword {' '.join('q' + letters[i % 26] * (2 + i // 26) + x for x in letters)}" for i in range(40)] + ["one clean text names badword once"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert "badword" in lexicon(docs, {i: int(i < 40) for i in range(len(texts))})


def test_toxicity_of_odd_rows(spark, odd_docs, odd):
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, None), (None, 0, 1), (4, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity(odd_docs, labels).collect()
    assert by_id((r.doc_id,) for r in rows) == by_id((d,) for d, *_ in odd) and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity(odd_docs.limit(0), labels).count() == 0
    assert toxicity(odd_docs, labels.limit(0)).count() == len(odd)
    assert drop_toxic(odd_docs, labels).columns == odd_docs.columns


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, odd_docs, tmp_path, empty):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs.limit(0) if empty else odd_docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        assert name == "packing" or after.columns == docs.columns
        docs = after
    assert (docs.count() == 0) == empty


def test_pipeline(spark, sf):
    """The stages' decisions meet in the result: every piece is one of a mixed document, no
    sequence is overfull, and no toxic or second document of a group is left."""
    rows = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id for r in toxicity(docs, labels).filter("predicted = 1").collect()}
    kept = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert kept and not kept & toxic
    clean = docs.filter(~F.col("doc_id").isin(list(toxic)))
    from tidemark.llm.ngram_join import ngram_jaccard

    first = {r.doc_id for r in ngram_jaccard(clean).filter("doc_id = component_id").collect()}
    assert kept <= first
    bins = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert bins.filter("n <> end or n > 2048").count() == 0
    whole = {(r.doc_id, r.piece): r.ids_crc32 for r in tokenized_pieces(clean).collect()}
    same = sum(whole.get((r.doc_id, r.piece)) == r.ids_crc32 for r in rows.collect())
    assert same > 0.9 * rows.count()
