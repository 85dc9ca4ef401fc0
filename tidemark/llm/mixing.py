"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, slices_for, word_count

MAX_EPOCHS = 3
SEED = 17


def default_weights(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, weigh 1, 2, 3, repeating."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))


def fill_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to ``source_size, weight``: shares of the total size by weight, clamped
    at ``max_epochs`` sizes, the excess shared out again among the rest until none is above.

    Each round reads one row from the aggregated sources; a clamped source stays clamped,
    so there are at most as many rounds as sources.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, clamped = None, F.lit(False)
    while True:
        held, weight = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0))
        ).first()
        now = (total - held) / weight if weight else math.inf
        if now == level:
            break
        level, clamped = now, F.col("weight") * F.lit(now) > cap
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def _order_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mixed_sizes(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights=default_weights) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``source, order_key`` per document.

    Every document is taken ``floor(target / source_size)`` times whole. The fraction left is
    one more pass through the source in seeded order that stops at the target: documents
    before the stop are taken once more, the one at the stop for the words still missing.
    So a source's taken words are its target rounded, and none is above ``max_epochs``.

    The pass needs running totals. They are made per slice of the seeded order, and only
    the slice where a source stops is ordered row by row, so a source that holds a third of
    all rows never meets in one task.

    Null text: size 0, takes nothing. Null sources form one source. Null ids share one place in the order;
    repeated rows are separate documents. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order_key(seed).alias("order_key"))
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source")))
    rows = cut(rows.withColumn("source_key", key), "mix_sizes")
    n = rows.count()
    digits = max(1, math.ceil(math.log(slices_for(n), 16)))
    rows = rows.withColumn("slice", F.substring("order_key", 1, digits))
    per_slice = cut(rows.groupBy("source_key", "source", "slice").agg(F.sum("size").alias("slice_size")), "mix_slices")
    sources = cut(per_slice.groupBy("source_key", "source").agg(F.sum("slice_size").alias("source_size")), "mix_sources")
    targets = fill_targets(weights(sources), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    extra = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    targets = targets.select("source_key", "source_size", "target", whole.alias("whole"), extra.alias("extra"))
    before = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = per_slice.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).drop("source")
    plan = plan.join(targets, "source_key")
    joined = rows.join(plan, ["source_key", "slice"])
    stops = (F.col("slice_start") < F.col("extra")) & (F.col("slice_start") + F.col("slice_size") > F.col("extra"))
    inside = Window.partitionBy("source_key", "slice").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_stop = joined.filter(stops).withColumn("_before", F.col("slice_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    elsewhere = joined.filter(~stops).withColumn("_before", F.col("slice_start"))
    part = F.when(stops, F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("_before"))))
    part = part.when(F.col("slice_start") < F.col("extra"), F.col("size")).otherwise(0)
    both = at_stop.unionByName(elsewhere)
    return both.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"), "source", "order_key")


def _end_of_words(text: str, n: str) -> Column:
    """Code points up to the end of the first ``n`` words."""
    gaps, words = F.split(text, WORD, -1), F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    steps = F.zip_with(F.slice(gaps, 1, F.col(n)), F.slice(words, 1, F.col(n)), lambda gap, word: F.length(gap) + F.length(word))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def mix_sources(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: each row repeated once per whole pass, and the leading
    part of a document whose last pass stops inside it. Columns are those of ``docs``, with
    ``n_chars`` counted anew for a leading part; other columns are handed on as they are,
    whatever their names. Documents of no words, null texts among them, take no part. Null
    ids and null sources are values like others; of repeated rows each takes its own words;
    an empty table gives no rows."""
    sizes = mixed_sizes(docs, max_epochs, seed).select("doc_id", F.col("size").alias("words"), F.col("source").alias("of"), "taken")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "source", "text")]
    packed = docs.select("doc_id", "source", "text", F.struct(*others, F.lit(0).alias("_")).alias("others"), word_count(F.col("text")).alias("size"))
    # Equal ids share their place in the order; numbering them pairs each row with one result.
    same = Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("text"))
    numbered = packed.withColumn("nth", F.row_number().over(same))
    also = Window.partitionBy("doc_id", "of", "words").orderBy("taken")
    sizes = sizes.withColumn("number", F.row_number().over(also)).withColumnRenamed("doc_id", "id")
    on = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("words")) & (F.col("nth") == F.col("number"))
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    joined = numbered.join(sizes, on).filter("taken > 0").withColumn("part", part)
    lengths = F.concat(F.array_repeat(F.lit(0), whole), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<int>")))
    exploded = joined.withColumn("leading", F.explode(lengths))
    leading = F.substring("text", F.lit(1), _end_of_words("text", "leading"))
    out = exploded.withColumn("text", F.when(F.col("leading") > 0, leading).otherwise(F.col("text")))

    def column(name: str) -> Column:
        if name in ("doc_id", "source", "text"):
            return F.col(name)
        value = F.col("others").getField(name)
        if name == "n_chars":
            value = F.when(F.col("leading") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(value)
        return value.alias(name)

    return out.select(*[column(c) for c in docs.columns])
