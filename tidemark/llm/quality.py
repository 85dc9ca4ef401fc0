"""Quality rules as a ledger of failure bits, in DataFrame functions only.

Every rule is evaluated once per document; its failure is one bit of ``failures`` beside the
measurements. A policy is a named, versioned mask: it rejects a document that fails any of
its rules. Counting what a policy or a policy without one rule would drop needs bits alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[], Column]


RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule("repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("capitals", lambda: 2 * F.col("n_capitals") > F.col("word_chars")),
)
BITS = {rule.name: 1 << i for i, rule in enumerate(RULES)}
POLICIES = {
    "base/1": BITS["few_words"] | BITS["repeated_words"],
    "full/1": sum(BITS.values()),
    "full/2": sum(BITS.values()) & ~BITS["short_words"],
}
POLICY = "full/1"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though the body names it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column, least_bits: int = 1) -> Column:
    """Words inside three-word windows that occur at least twice.

    A window is a number whose low bits are its place and whose high bits are its hash, so
    that sorting plain numbers brings equal windows together: linear memory, no pairs. The
    few places that share a hash are then sorted by the words themselves, so that windows
    count as equal only if their words are.
    """
    count = F.size(words)
    bits = F.greatest(F.lit(least_bits), F.ceil(F.log2(F.greatest(count, F.lit(2)))) + 1).cast("int")

    def windows(words: Column, bits: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
        )

    def meeting(found: Column, bits: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        high = lambda i: F.call_function("shiftright", found[i], bits)
        twice = F.filter(
            found,
            lambda x, i: ((i > 0) & (high(F.greatest(i - 1, F.lit(0))) == F.call_function("shiftright", x, bits)))
            | ((i < F.size(found) - 1) & (high(F.least(i + 1, F.size(found) - 1)) == F.call_function("shiftright", x, bits))),
        )
        return F.transform(twice, lambda x: x.bitwiseAND(low).cast("int"))

    def spelled(places: Column, words: Column) -> Column:
        return F.sort_array(F.transform(places, lambda p: F.struct(words[p].alias("a"), words[p + 1].alias("b"), words[p + 2].alias("c"), p.alias("p"))))

    def covered(found: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

        twice = F.filter(
            found,
            lambda x, i: ((i > 0) & same(found[F.greatest(i - 1, F.lit(0))], x))
            | ((i < F.size(found) - 1) & same(found[F.least(i + 1, F.size(found) - 1)], x)),
        )
        places = F.transform(twice, lambda x: x["p"])
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    def total_of(w: Column, b: Column) -> Column:
        places = _let(F.sort_array(windows(w, b)), lambda found: meeting(found, b))
        return _let(spelled(places, w), covered)

    total = _let(words, lambda w: _let(bits, lambda b: total_of(w, b)))
    return F.when(count >= 3, total).otherwise(0).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of each text. Null text has no words and measures 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    base = docs.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )


def quality_ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failures``, one row per document. Repeated rows stay; an empty
    table gives no rows; columns other than ``doc_id, text`` are not read."""
    bits = F.lit(0)
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(), BITS[rule.name]).otherwise(0))
    return measure(docs).withColumn("failures", bits.cast("int"))


def apply_policy(ledger: DataFrame, policy: str = POLICY) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and the ``policy`` that decided."""
    failed = lambda mask: F.col("failures").bitwiseAND(F.lit(mask)) != 0
    base = failed(POLICIES["base/1"])
    return ledger.select("*", base.alias("base_failed"), (~base & ~failed(POLICIES[policy])).alias("kept"), F.lit(policy).alias("policy"))


def ablations(ledger: DataFrame) -> DataFrame:
    """Per policy and rule: documents that the rule fails, that it alone rejects, and that
    the policy keeps with and without it. One pass of bit tests, pre-aggregated per task."""
    out = []
    for policy, mask in POLICIES.items():
        hit = F.col("failures").bitwiseAND(F.lit(mask))
        out += [F.sum((hit == 0).cast("long")).alias(f"{policy}|kept")]
        for rule in RULES:
            bit = BITS[rule.name]
            if mask & bit:
                out.append(F.sum((hit.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"{policy}|{rule.name}|fails"))
                out.append(F.sum((hit == bit).cast("long")).alias(f"{policy}|{rule.name}|alone"))
    totals = ledger.agg(*out)
    rows = [
        F.struct(
            F.lit(policy).alias("policy"),
            F.lit(rule.name).alias("rule"),
            F.coalesce(F.col(f"`{policy}|{rule.name}|fails`"), F.lit(0)).alias("n_fail"),
            F.coalesce(F.col(f"`{policy}|{rule.name}|alone`"), F.lit(0)).alias("n_alone"),
            F.coalesce(F.col(f"`{policy}|kept`"), F.lit(0)).alias("n_kept"),
            F.coalesce(F.col(f"`{policy}|kept`") + F.col(f"`{policy}|{rule.name}|alone`"), F.lit(0)).alias("n_kept_without"),
        )
        for policy, mask in POLICIES.items()
        for rule in RULES
        if mask & BITS[rule.name]
    ]
    return totals.select(F.inline(F.array(*rows)))
