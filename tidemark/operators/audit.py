"""Policy backtests and leakage audits of ranked test rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import PanelSpec
from tidemark.operators.metrics import MODEL, top_rows
from tidemark.sources.sinks import cut

AUDIT_MEANS = ("preqin_institutional_confirmation", "crosswalk_matched_asof", "enterprise_value_missing_flag")
AUDIT_MEDIANS = (
    "preqin_deal_count_asof", "quarters_since_first_preqin_deal", "preqin_deal_size_sum_asof",
    "log_enterprise_value_at_entry",
)


def _per_k(top: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Each selected row once for every k it belongs to. The ranking is computed once for
    the largest k."""
    fits = F.filter(F.array(*map(F.lit, ks)), lambda k: F.col("top_rank") <= k)
    return top.withColumn("top_k", F.explode(fits))


def policy_backtest(
    pred: DataFrame, spec: PanelSpec, ks: Sequence[int] = (500, 5000), groups: Sequence[str] = MODEL
) -> DataFrame:
    """Realized rate, base rate and lift of acting on the best k rows."""
    key = [spec.entity, spec.period]
    slim = pred.select(*groups, *key, spec.label, "score")
    base = slim.groupBy(*groups).agg(F.avg(spec.label).alias("test_base_rate"))
    chosen = _per_k(top_rows(slim, max(ks), key, groups), ks).groupBy(*groups, "top_k").agg(
        F.count(F.lit(1)).alias("selected_rows"),
        F.countDistinct(spec.entity).alias("selected_companies"),
        F.avg(spec.label).alias("selected_realized_rate"),
    )
    lift = F.try_divide("selected_realized_rate", "test_base_rate")
    return chosen.join(base, list(groups)).withColumn("lift", lift)


def split_overlap(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """How many entities appear in train, in test, and in both."""
    sides = panel.groupBy(spec.entity).agg(
        F.max((F.col("split") == "train").cast("int")).alias("tr"),
        F.max((F.col("split") == "test").cast("int")).alias("te"),
    )
    counts = sides.agg(
        F.sum("tr").alias("train_companies"),
        F.sum("te").alias("test_companies"),
        F.sum(F.col("tr") * F.col("te")).alias("overlap_companies"),
    )
    return counts.withColumn(
        "share_of_test_companies_seen_in_train", F.try_divide("overlap_companies", "test_companies")
    )


def audited_top(
    pred: DataFrame, panel: DataFrame, spec: PanelSpec, ks: Sequence[int] = (500, 5000), groups: Sequence[str] = MODEL
) -> DataFrame:
    """The best k rows with the panel columns an auditor needs.

    The selection is written once and read three times. It holds at most ``max(ks)`` rows per
    fitted model; whether that is broadcast is left to its measured size.
    """
    key = [spec.entity, spec.period]
    top = cut(top_rows(pred.select(*groups, *key, spec.label, "score"), max(ks), key, groups), "audited-top")
    have = [c for c in (*AUDIT_MEANS, *AUDIT_MEDIANS) if c in panel.columns]
    facts = (
        panel.filter(F.col("split") == "test")
        .select(*key, "exit_q", "company_exit_route", *have)
        .join(top.select(*key).distinct(), key, "left_semi")
    )
    seen = (
        panel.filter(F.col("split") == "train")
        .select(spec.entity)
        .join(top.select(spec.entity).distinct(), spec.entity, "left_semi")
        .distinct()
        .withColumn("company_seen_in_train", F.lit(1))
    )
    joined = top.join(facts, key, "left").join(seen, spec.entity, "left")
    return _per_k(
        joined.withColumns(
            {
                "company_seen_in_train": F.coalesce("company_seen_in_train", F.lit(0)),
                "quarters_to_exit": F.col("exit_q") - F.col(spec.period),
            }
        ),
        ks,
    )


def topk_summary(audited: DataFrame, spec: PanelSpec, groups: Sequence[str] = MODEL) -> DataFrame:
    """Concentration and near-exit measures per k. Exact medians are safe here: a group
    holds at most k rows."""
    event = F.col(spec.label) == 1
    wait = F.when(event, F.col("quarters_to_exit"))

    def share(cond: Column) -> Column:
        return F.avg(F.when(event, F.coalesce(cond, F.lit(False)).cast("int")))

    rate = F.avg(spec.label)
    extra = [F.avg(c).alias(f"top_mean_{c}") for c in AUDIT_MEANS if c in audited.columns]
    extra += [F.median(c).alias(f"top_median_{c}") for c in AUDIT_MEDIANS if c in audited.columns]
    return audited.groupBy(*groups, "top_k").agg(
        F.count(F.lit(1)).alias("top_rows"),
        F.countDistinct(spec.entity).alias("top_companies"),
        (F.count(F.lit(1)) - F.countDistinct(spec.entity)).alias("duplicate_company_rows"),
        rate.alias("top_realized_rate"),
        F.avg("company_seen_in_train").alias("company_seen_in_train_share"),
        F.count_if(event).alias("event_rows"),
        F.count(wait).alias("event_rows_with_exit_q"),
        F.median(wait).alias("median_quarters_to_exit_among_events"),
        share(wait.between(0, 1)).alias("share_event_rows_exit_within_1q"),
        share(wait.between(0, 2)).alias("share_event_rows_exit_within_2q"),
        (rate >= 0.75).cast("int").alias("high_precision_flag_ge_75pct"),
        *extra,
    )


def topk_detail(audited: DataFrame, spec: PanelSpec, groups: Sequence[str] = MODEL) -> DataFrame:
    wanted = [
        *groups, "top_k", "top_rank", spec.entity, spec.period, "score", spec.label, "company_exit_route", "exit_q",
        "quarters_to_exit", "company_seen_in_train", *AUDIT_MEANS[:2], *AUDIT_MEDIANS, AUDIT_MEANS[2],
    ]
    return audited.select(*[c for c in wanted if c in audited.columns])
