"""Toxicity by weak supervision.

Labelled documents give a lexicon: words, and beginnings of words, that toxic documents
hold and clean ones do not. Lexicon voters (each a part of the lexicon) and pattern voters
(beginnings of one length, several hits, density, repetition) vote on every document of the
corpus. A generative model of the votes estimates from all documents how accurate each voter
is and how strongly voters repeat each other; its posteriors label the documents that a
linear classifier over the lexicon is fitted to.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

# At most so many labelled rows, those of the smallest hashes, make the lexicon, and at most
# so many rows are fitted to. Votes and the label model cover every document.
LABELLED_ROWS = 40_000
FIT_ROWS = 40_000
LEXICON = 320
LEAST_TEXTS = 4
PURITY = 0.9
LISTS = 6
BEGINNINGS = (3, 4, 5, 6)
VOTERS = LISTS + len(BEGINNINGS) + 3
FOLDS = 5

_TOKEN = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that nothing is learned from; null ids do not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def terms(word: str) -> list[str]:
    """The word itself and its proper beginnings, marked by a trailing hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def _signature(words: list[str]) -> int:
    """Near copies mostly agree on it: the least hash of three words in a row."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def labelled_rows(labels: DataFrame, limit: int = LABELLED_ROWS) -> dict[int, int]:
    """Labels of at most ``limit`` rows outside the held-out fold. An id with several labels
    counts as toxic if one of them is."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return {r[0]: int(r[1]) for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()}


def lexicon(docs: DataFrame, labelled: dict[int, int], size: int = LEXICON) -> dict[str, int]:
    """The ``size`` terms that most toxic texts hold, among those found in at least
    ``LEAST_TEXTS`` unlike toxic texts and hardly in clean ones; numbered."""
    shared = docs.sparkSession.sparkContext.broadcast(labelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            term, signature, toxic = [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                label = known.get(doc_id.as_py())
                if label is None:
                    continue
                words = tokens(text.as_py())
                found = {t for w in set(words) for t in terms(w)}
                term += found
                signature += [_signature(words)] * len(found)
                toxic += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(signature, pa.int64()), pa.array(toxic, pa.int32())], names=["term", "signature", "toxic"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "term string, signature long, toxic int")
    per_text = counted.distinct()
    per_term = per_text.groupBy("term").agg(F.sum("toxic").alias("toxic_texts"), F.sum(1 - F.col("toxic")).alias("clean_texts"))
    pure = per_term.filter((F.col("toxic_texts") >= LEAST_TEXTS) & (F.col("toxic_texts") >= PURITY * (F.col("toxic_texts") + F.col("clean_texts"))))
    rows = pure.orderBy(F.desc("toxic_texts"), F.length("term").desc(), "term").limit(size).collect()
    return {r.term: i for i, r in enumerate(rows)}


def _vote(words: list[str], lexicon: dict[str, int]) -> tuple[list[int], list[int]]:
    """Votes (0 none, 1 toxic, 2 clean) and the numbers of the terms held."""
    seen = Counter(words)
    hits: dict[int, int] = {}
    votes = [0] * VOTERS
    total = 0
    for word, n in seen.items():
        found = False
        for term in terms(word):
            number = lexicon.get(term)
            if number is not None:
                hits[number] = hits.get(number, 0) + n
                found = True
                if term[-1] == "-":
                    votes[LISTS + BEGINNINGS.index(len(term) - 1)] = 1
                else:
                    votes[number % LISTS] = 1
        total += n * found
    several, dense, again = range(LISTS + len(BEGINNINGS), VOTERS)
    votes[several] = 1 if len(hits) >= 2 else 2 if not hits else 0
    votes[dense] = 1 if total and 100 * total >= len(words) else 2 if not total else 0
    votes[again] = 1 if total >= 2 else 0 if total else 2
    return votes, sorted(hits)


def voted(docs: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """``doc_id, pattern, hits`` per document; ``pattern`` packs the votes."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, held = [], []
            for text in batch.column(1):
                votes, hits = _vote(tokens(text.as_py()), lexicon)
                patterns.append(sum(v << 2 * i for i, v in enumerate(votes)))
                held.append(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns, pa.int64()), pa.array(held, pa.list_(pa.int32()))], names=["doc_id", "pattern", "hits"])

    return docs.select("doc_id", "text").mapInArrow(vote, "doc_id long, pattern long, hits array<int>")


class LabelModel:
    """Two classes; each voter votes independently given the class, except that voters which
    still agree given the class share their weight."""

    def __init__(self, patterns: dict[int, int], prior: float, rounds: int = 25):
        keys = np.array(sorted(patterns), np.int64)
        n = np.array([patterns[k] for k in keys.tolist()], float)
        votes = self._votes(keys)
        self.prior = min(max(prior, 1e-3), 0.5)
        # Start: voters are right four times out of five.
        self.table = np.tile(np.log([[0.6, 0.05, 0.35], [0.2, 0.75, 0.05]]), (VOTERS, 1, 1))
        self.weight = np.ones(VOTERS)
        for _ in range(rounds):
            toxic = self._posterior(votes)
            for cls, share in ((0, 1 - toxic), (1, toxic)):
                mass = np.stack([((votes == v) * (share * n)[:, None]).sum(axis=0) for v in range(3)], axis=1) + 0.5
                self.table[:, cls] = np.log(mass / mass.sum(axis=1, keepdims=True))
            self.prior = float(np.clip((toxic * n).sum() / max(1.0, n.sum()), 1e-4, 0.9))
            self.weight = self._weights(votes, n, toxic)

    @staticmethod
    def _votes(keys: np.ndarray) -> np.ndarray:
        return (keys[:, None] >> 2 * np.arange(VOTERS)) & 3

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = self.table[:, 1] - self.table[:, 0]
        odds = np.log(self.prior / (1 - self.prior)) + (self.weight * ratio[np.arange(VOTERS), votes]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    @staticmethod
    def _weights(votes: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        total = np.zeros((VOTERS, VOTERS))
        for share in (toxic * n, (1 - toxic) * n):
            x = (votes == 1).astype(float)
            mass = max(share.sum(), 1e-9)
            centred = x - (share[:, None] * x).sum(axis=0) / mass
            spread = (share[:, None] * centred).T @ centred / mass
            deviation = np.sqrt(np.maximum(np.diag(spread), 1e-9))
            total += np.clip(spread / np.outer(deviation, deviation), 0, 1) * mass / max(n.sum(), 1e-9)
        np.fill_diagonal(total, 0)
        return 1 / (1 + total.sum(axis=1))

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        return self._posterior(self._votes(pattern))


def fit_linear(hits: list[list[int]], target: np.ndarray, width: int, penalty: float = 0.05) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the intercept comes last."""
    x = np.zeros((len(hits), width + 1), np.float32)
    for i, held in enumerate(hits):
        x[i, held] = 1
    x[:, width] = 1
    weights = np.zeros(width + 1)
    ridge = np.full(width + 1, penalty)
    ridge[width] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - target) + ridge * weights
        curve = (x.T * (p * (1 - p) + 1e-6)).astype(np.float32) @ x
        weights -= np.linalg.solve(curve + np.diag(ridge), slope)
    return weights


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document.

    Labels of the held-out fold are never read. Null and empty texts hold no term and get the
    score of such texts. Repeated rows stay; null ids are scored and have no label; without
    labelled toxic texts there is no lexicon and all scores are low; an empty table gives
    no rows. Only ``doc_id, text`` of the documents and ``doc_id, toxic`` of the labels are read.
    """
    labelled = labelled_rows(labels)
    terms_ = lexicon(docs, labelled)
    votes = cut(voted(docs, terms_), "toxicity_votes")
    # Vote patterns are few: each voter says one of three things, and most say nothing.
    patterns = {r[0]: r[1] for r in votes.groupBy("pattern").count().collect()}
    rate = sum(labelled.values()) / len(labelled) if labelled else 0.05
    model = LabelModel(patterns, rate)
    sample = votes.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).collect()
    target = model.posterior(np.array([r.pattern for r in sample], np.int64)) if sample else np.zeros(0)
    width = len(terms_)
    weights = fit_linear([r.hits for r in sample], target, width) if sample else np.full(1, -3.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(hits).to_numpy(zero_copy_only=False))
            odds = weights[width] + np.bincount(row, weights[hits.flatten().to_numpy()], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-odds)))], names=["doc_id", "held_out", "score"])

    scored = votes.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "hits").mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic. Ids are taken as the documents' key; a row
    without an id stays."""
    toxic = toxicity(docs.filter("doc_id is not null"), labels).filter("predicted = 1").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
