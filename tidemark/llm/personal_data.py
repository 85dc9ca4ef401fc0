"""Personal data by bootstrapped contextual extraction.

Fixed formats give the seeds. Every identifier-like token of the corpus is an instance, known
by its shape, and the words before it are its pattern. Spark scores patterns by the seeds that
they introduce and instances by their patterns, in turns, over the aggregated graph of both.
High-confidence patterns then mark instances that no format describes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, row_id

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SURE = 0.6
SEEDS_NEEDED = 5
DOCS_NEEDED = 3
CONTEXT_WORDS = 2
LONGEST = 120

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Inside a run of digits a match can start only where the run does, which keeps this linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARKED = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_OUTER = "\"'()[]{}<>.,;:!?*#$%&|"


def emails(text: str) -> list[tuple[int, int]]:
    """Each sign is extended over the characters of a local part to its left, so long runs
    without a sign are never scanned."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            out.append((start, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _pattern(words: list[str]) -> str:
    return " ".join("0" if _DIGIT.search(w) else w.lower() for w in words[-CONTEXT_WORDS:])


def instances(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str, str | None]]:
    """``start, end, pattern, shape, seed kind`` of every seed and identifier-like token."""
    if not _MARKED.search(text):
        return []
    held = sorted((s, e, k) for k, s, e in spans)
    out, last, i = [], ["^"], 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while i < len(held) and held[i][0] < end:
            s, e, kind = held[i]
            out.append((s, e, _pattern(last), f"<{kind}>", kind))
            i += 1
        covered = any(s < end and e > start for s, e, _ in held[max(0, i - 4) : i])
        token = m.group()
        if not covered and _MARKED.search(token):
            lead = len(token) - len(token.lstrip(_OUTER))
            core = token.strip(_OUTER)
            if core:
                shape = re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", core))[:LONGEST]
                out.append((start + lead, start + lead + len(core), _pattern(last), shape, None))
        word = token[:LONGEST].strip(_OUTER)
        if word:
            last = [*last[1 - CONTEXT_WORDS :], word]
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """``row, doc_id``, base counts and spans, and the document's instances."""
    schema = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, instances array<struct<start:int,end:int,pattern:string,shape:string,seed:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("shape", pa.string()), ("seed", pa.string())]))
    names = ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "instances"]
    fields = ("start", "end", "pattern", "shape", "seed")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, hashes, found = [[], [], [], []], [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                spans = base_spans(text)
                for n, kind_ in zip(counts, KINDS, strict=True):
                    n.append(sum(s[0] == kind_ for s in spans))
                bases.append(joined(spans))
                hashes.append(hashlib.sha256(bases[-1].encode()).hexdigest())
                found.append([dict(zip(fields, x, strict=True)) for x in instances(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(n, pa.int64()) for n in counts), pa.array(bases), pa.array(hashes), pa.array(found, kind)], names=names
            )

    return docs.select(row_id("doc_id", "text").alias("row"), "doc_id", "text").mapInArrow(scan, schema)


def confident_contexts(edges: DataFrame) -> DataFrame:
    """``pattern, shape, kind`` of contexts whose instances are taken, from the graph
    ``pattern, shape, seed, n, docs``.

    A pattern's score for a kind is the mean score of the instances that it introduces; an
    instance's is 1 for a seed, else the mean score of the patterns that introduce it. Only
    patterns that introduce enough seeds, in enough documents, take part.
    """
    seeds = edges.filter("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.sum("n").alias("seeds"), F.sum("docs").alias("seed_docs"))
    seeds = seeds.filter(f"seeds >= {SEEDS_NEEDED} and seed_docs >= {DOCS_NEEDED}")
    near = cut(edges.join(seeds.select("pattern").distinct(), "pattern", "left_semi"), "contexts")
    totals = near.groupBy("pattern").agg(F.sum("n").alias("total"))
    open_ = near.filter("seed is null").select("pattern", "shape", "n")
    weights = open_.groupBy("shape").agg(F.sum("n").alias("shape_n"))
    patterns = cut(seeds.join(totals, "pattern").select("pattern", "kind", "seeds", "total", (F.col("seeds") / F.col("total")).alias("score")), "patterns")
    for _ in range(ROUNDS):
        lent = open_.join(patterns.select("pattern", "kind", "score"), "pattern").join(weights, "shape")
        shapes = lent.groupBy("shape", "kind").agg((F.sum(F.col("n") * F.col("score")) / F.first("shape_n")).alias("shape_score"))
        gained = open_.join(shapes, "shape").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("shape_score")).alias("gained"))
        scored = patterns.drop("score").join(gained, ["pattern", "kind"], "left")
        patterns = cut(scored.select("pattern", "kind", "seeds", "total", ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / F.col("total")).alias("score")), "patterns")
    sure = patterns.filter(F.col("score") >= SURE).select("pattern", "kind", "score")
    taken = open_.join(sure, "pattern").join(shapes.filter(F.col("shape_score") >= SURE), ["shape", "kind"])
    return taken.groupBy("pattern", "shape").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per document; spans that
    the method adds carry ``context_`` and the kind. Null text is empty; repeated rows each get
    their result; an empty table gives no rows; columns but ``doc_id, text`` are not read."""
    found = cut(scanned(docs.select("doc_id", "text")), "personal_data")
    single = found.select("row", F.inline("instances")).distinct()
    # Per document first, so that documents are counted exactly.
    each = single.groupBy("pattern", "shape", "seed", "row").agg(F.count(F.lit(1)).alias("n"))
    edges = each.groupBy("pattern", "shape", "seed").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    contexts = confident_contexts(cut(edges, "context_graph"))
    marked = single.filter("seed is null").join(contexts, ["pattern", "shape"])
    span = F.struct("kind", "start", F.concat_ws(":", F.concat(F.lit("context_"), "kind"), F.col("start"), F.col("end")).alias("span"))
    added = marked.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_set(span)), lambda x: x["span"]), ",").alias("added"))
    out = found.drop("instances").join(added, "row", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("added"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))
