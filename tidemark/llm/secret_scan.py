"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's pattern gives a Boolean query over trigrams that any match must contain. The
index holds, for the trigrams of all queries, the documents that contain them; postings are
intersected per alternative of a query, and only the candidates are verified by the pattern.
Rules without mandatory trigrams are verified on every document.
"""

from __future__ import annotations

import itertools
import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_id


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Base rules, in the order in which their kinds are listed. A long run always begins where
# its first match does, so the least length of `access` and `hex` can stand in the pattern.
BASE = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# What the method adds: formats with a fixed lead.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}"),
    # A run that no second and third part follow is matched as well and dropped for its empty
    # group: no later start inside it can do better, so each run is read once.
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}+(\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)?", 1, 1),
    Rule("bearer", r"[bB]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", r"://[A-Za-z0-9._~-]{1,64}:[^\x20\x09-\x0D/@:]{4,128}@"),
)
RULES = BASE + ADDED
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams that a match along it contains. None
    if some match contains no mandatory trigram."""
    alternatives = [frozenset(text[i : i + 3] for text in runs for i in range(len(text) - 2)) for runs in _runs(list(parser.parse(pattern)))]
    if not all(alternatives):
        return None
    distinct = list(dict.fromkeys(alternatives))
    return [a for a in distinct if not any(b < a for b in distinct)]  # a wider condition says it already


def _runs(items: list) -> list[tuple[str, ...]]:
    """Ways through a pattern, each the literal runs that it spells out ("" breaks a run)."""
    ways: list[list[str]] = [[""]]
    for code, value in items:
        if code is op.LITERAL:
            steps = [[chr(value).lower()]]
        elif code is op.IN:
            found = {chr(x).lower() for c, x in value if c is op.LITERAL}
            narrow = all(c is op.LITERAL for c, _ in value) and len(found) <= 5
            steps = [[c] for c in sorted(found)] if narrow else [["", ""]]
        elif code is op.SUBPATTERN:
            steps = [list(x) for x in _runs(list(value[3]))]
        elif code is op.BRANCH:
            steps = [list(x) for branch in value[1] for x in _runs(list(branch))]
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and value[:2] == (0, 1):
            steps = [[""], *(list(x) for x in _runs(list(value[2])))]
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1 and all(c is op.LITERAL for c, _ in value[2]):
            steps = [[x[0], "", x[-1]] for x in _runs(list(value[2]))]
        else:
            steps = [["", ""]]
        if len(ways) * len(steps) > MOST_STRINGS:
            steps = [["", ""]]
        ways = [[*way[:-1], way[-1] + step[0], *step[1:]] for way, step in itertools.product(ways, steps)]
    return [tuple(way) for way in ways]


def _matches(text: Column, rule: Rule, keep: Column) -> Column:
    """Array of ``start, end`` of the leftmost non-overlapping matches whose group is long
    enough, in code points. The pieces between matches give the places."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.slice(F.split(text, rule.pattern, -1), 1, F.regexp_count(text, pattern)).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )
    kind = "array<struct<start:int,end:int>>"
    walk = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")),
        lambda state, x: F.struct(
            (state["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.when(
                F.length(x["part"]) >= rule.least,
                F.concat(
                    state["found"],
                    F.array(
                        F.struct(
                            (state["at"] + F.length(x["gap"])).alias("start"),
                            (state["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
                        )
                    ),
                ),
            ).otherwise(state["found"]).alias("found"),
        ),
        lambda state: state["found"],
    )
    return F.when(keep, walk).otherwise(F.array().cast(kind))


def _labelled(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: x["kind"] == kind)


def postings(docs: DataFrame, trigrams: list[str], key: Column) -> DataFrame:
    """``trigram, row`` for every listed trigram that a document's text contains, in any case."""
    lowered = docs.select(key.alias("row"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lowered.select("row", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: Column) -> DataFrame:
    """``row, rules``: bits of the rules whose trigram query the row's postings satisfy."""
    queries = {i: q for i, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) is not None}
    trigrams = sorted({t for query in queries.values() for alternative in query for t in alternative})
    number = {t: i for i, t in enumerate(trigrams)}
    # A document's postings come together as a set of bits; an alternative is an intersection.
    per_word = 62
    index = postings(docs, trigrams, key)
    words = -(-len(trigrams) // per_word)

    def bit(w: int) -> Column:
        here = [F.lit(x) for t in trigrams if number[t] // per_word == w for x in (t, 1 << number[t] % per_word)]
        return F.coalesce(F.bit_or(F.create_map(*here)[F.col("trigram")].cast("long")), F.lit(0)).alias(f"w{w}")

    sets = index.groupBy("row").agg(*[bit(w) for w in range(words)])

    def holds(alternative: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(words):
            mask = sum(1 << number[t] % per_word for t in alternative if number[t] // per_word == w)
            out = out & (F.col(f"w{w}").bitwiseAND(F.lit(mask).cast("long")) == mask) if mask else out
        return out

    bits = F.lit(0)
    for i, query in queries.items():
        any_of = F.lit(False)
        for alternative in query:
            any_of = any_of | holds(alternative)
        bits = bits + F.when(any_of, F.lit(1 << i)).otherwise(0)
    return sets.select("row", bits.alias("rules")).filter("rules <> 0")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` and ``_found``: array of ``start, rank, end, kind`` ordered by
    start, then rule. Null text is empty; repeated rows each get their result; an empty table
    gives no rows. Columns named ``_found``, ``_row`` or ``_rules`` are replaced."""
    docs = docs.drop("_found", "_row", "_rules")
    key = row_id("doc_id", "text")
    hits = candidates(docs, rules, key).select(F.col("row").alias("_row"), F.col("rules").alias("_rules"))
    joined = docs.withColumn("_row", key).join(hits, "_row", "left")
    found = []
    for i, rule in enumerate(rules):
        if trigram_query(rule.pattern) is None:
            keep = F.col("text").rlike(rule.pattern)
        else:
            keep = F.coalesce(F.col("_rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
        spans = _matches(F.col("text"), rule, F.coalesce(keep, F.lit(False)))
        found.append(_labelled(spans, i, rule.kind))
    return joined.withColumn("_found", F.array_sort(F.concat(*found))).drop("_row", "_rules")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per document."""
    found = F.col("_found")
    counts = [F.size(_of_kind(found, rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in BASE]
    base = F.filter(found, lambda x: x["rank"] < len(BASE))
    return secret_spans(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(found).alias("spans"))


MARK = "[secret]"


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span, or run of overlapping spans, replaced by a mark; ``n_chars``
    counted anew where the text changed. Every row stays, repeated ones and those without an
    id or a text too; other columns are handed on as they are, whatever their names; an empty
    table gives no rows."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    found = secret_spans(docs.select("doc_id", "text", F.struct(*others).alias("others")))
    step = F.aggregate(
        "_found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda state, x: F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(x["start"] >= state["at"], F.concat(state["out"], F.substring("text", state["at"] + 1, x["start"] - state["at"]), F.lit(MARK))).otherwise(state["out"]).alias("out"),
        ),
        lambda state: F.concat(state["out"], F.substring("text", state["at"] + 1, F.length("text"))),
    )
    changed = F.size("_found") > 0
    out = found.select("others", changed.alias("changed"), F.when(changed, step).otherwise(F.col("text")).alias("text"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        value = F.col("others").getField(name)
        if name == "n_chars":
            value = F.when(F.col("changed"), F.length("text").cast(docs.schema[name].dataType)).otherwise(value)
        return value.alias(name)

    return out.select(*[column(c) for c in docs.columns])
