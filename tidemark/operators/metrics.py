"""Ranking, calibration and threshold metrics per (model, variant) or any other grouping.

Prediction tables are long: one row per scored panel row and model. Every metric is exact,
including at tied scores, and none sorts a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nulls import clip
from tidemark.operators.prefix import RANGES, cut_points, exact_quantiles, value_prefix
from tidemark.operators.ranking import equal_count_bins, mid_rank
from tidemark.operators.skew import top_k

MODEL = ("model", "variant")


def best_first(score: str, key: Sequence[str]) -> list[Column]:
    """Total order of a ranking: best score first, ties by key."""
    return [F.desc(score), *[F.asc(c) for c in key]]


def top_rows(pred: DataFrame, k: int, key: Sequence[str], groups: Sequence[str] = MODEL, score: str = "score") -> DataFrame:
    return top_k(pred, groups, k, best_first(score, key), key)


def precision_at_k(
    pred: DataFrame, ks: Sequence[int], label: str, key: Sequence[str], groups: Sequence[str] = MODEL
) -> DataFrame:
    """Mean label of the best k rows, one column per k. The largest k is selected once."""
    top = top_rows(pred.select(*groups, *key, label, "score"), max(ks), key, groups)
    return top.groupBy(*groups).agg(
        *[F.avg(F.when(F.col("top_rank") <= k, F.col(label))).alias(f"precision_at_{k}") for k in ks]
    )


def score_prefix(
    pred: DataFrame, label: str, groups: Sequence[str] = MODEL, ranges: int = RANGES, cuts: Sequence[float] | None = None
) -> DataFrame:
    """Counts of rows and positives at and below every distinct score."""
    return value_prefix(pred, "score", groups, {"pos": F.col(label).cast("long")}, ranges, cuts=cuts)


def rank_quality(prefix: DataFrame, groups: Sequence[str] = MODEL) -> DataFrame:
    """ROC AUC by mean ranks and average precision by distinct scores; NULL with one class."""
    n, pos = F.col("n"), F.col("pos")
    rows, positives = F.max("n_total"), F.max("pos_total")
    ranks = F.sum(pos * mid_rank(F.col("n_before"), n))
    # from the top down to and including this score
    hits = F.col("pos_total") - F.col("pos_before")
    taken = F.col("n_total") - F.col("n_before")
    step = F.sum(pos * hits / taken)
    both = (positives > 0) & (positives < rows)
    auc = F.try_divide(ranks - positives * (positives + 1) / 2, positives * (rows - positives))
    return prefix.groupBy(*groups).agg(
        F.when(both, F.try_divide(step, positives)).alias("pr_auc"), F.when(both, auc).alias("roc_auc")
    )


def threshold_quality(
    prefix: DataFrame, groups: Sequence[str] = MODEL, threshold: float | None = None, quantile: float = 0.9
) -> DataFrame:
    """Accuracy, precision, recall and F1 of ``score >= threshold``. Without a threshold the
    cut is the given quantile of each group's scores. Precision and the rest are 0 where
    their denominator is."""
    if threshold is None:
        cut = exact_quantiles(prefix, "score", {"threshold": quantile}, groups)
        joined = prefix.join(cut, list(groups))
    else:
        joined = prefix.withColumn("threshold", F.lit(float(threshold)))
    above = F.col("score") >= F.col("threshold")
    counts = joined.groupBy(*groups).agg(
        F.max("threshold").alias("threshold"),
        F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)).alias("called"),
        F.max("pos_total").alias("p"),
        F.max("n_total").alias("rows"),
    )
    right = F.col("rows") - F.col("called") - F.col("p") + 2 * F.col("tp")

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.select(
        *groups,
        "threshold",
        share(right, F.col("rows")).alias("accuracy"),
        share(F.col("tp"), F.col("called")).alias("precision"),
        share(F.col("tp"), F.col("p")).alias("recall"),
        share(2 * F.col("tp"), F.col("called") + F.col("p")).alias("f1"),
    )


def binned_calibration(
    pred: DataFrame, label: str, key: Sequence[str], bins: int = 10, groups: Sequence[str] = MODEL,
    pooled: bool = False, ranges: int = RANGES, cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Mean clipped score, realized rate and rows per equal-count bin. ``pooled`` cuts the
    bins over all groups together instead of within each."""
    clipped = pred.select(*groups, *key, label, clip(F.col("score"), 0.0, 1.0).alias("score"))
    if pooled:
        placed = equal_count_bins(clipped, "score", [*groups, *key], bins, (), "decile", ranges, cuts)
    else:
        placed = equal_count_bins(clipped, "score", key, bins, groups, "decile", ranges, cuts)
    return placed.groupBy(*groups, "decile").agg(
        F.avg("score").alias("predicted"), F.avg(F.col(label).cast("double")).alias("realized"), F.count(F.lit(1)).alias("rows")
    )


def expected_calibration_error(calibration: DataFrame, groups: Sequence[str] = MODEL) -> DataFrame:
    """Row-weighted mean distance between predicted and realized rate over the bins."""
    gap = F.abs(F.col("realized") - F.col("predicted"))
    return calibration.groupBy(*groups).agg((F.sum(F.col("rows") * gap) / F.sum("rows")).alias("ece"))


def brier(pred: DataFrame, label: str, groups: Sequence[str] = MODEL) -> DataFrame:
    error = clip(F.col("score"), 0.0, 1.0) - F.col(label)
    return pred.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).alias("events"), F.avg(error * error).alias("brier")
    )


def metric_rows(
    pred: DataFrame, label: str, key: Sequence[str], split: str = "test", groups: Sequence[str] = MODEL,
    ks: Sequence[int] = (500, 5000), ranges: int = RANGES,
) -> DataFrame:
    """All metrics of every (model, variant), one row each."""
    cuts = cut_points(pred, "score", ranges)
    prefix = score_prefix(pred, label, groups, ranges, cuts)
    deciles = binned_calibration(pred, label, key, 10, groups, ranges=ranges, cuts=cuts)
    parts = [
        brier(pred, label, groups),
        precision_at_k(pred, ks, label, key, groups),
        rank_quality(prefix, groups),
        expected_calibration_error(deciles, groups),
        threshold_quality(prefix, groups).drop("threshold"),
    ]
    joined = reduce(lambda a, b: a.join(b, list(groups)), parts)
    return joined.select(
        *groups, F.lit(split).alias("split"), "rows", "events", *[f"precision_at_{k}" for k in ks],
        "pr_auc", "roc_auc", "brier", "ece", "accuracy", "precision", "recall", "f1",
    )
