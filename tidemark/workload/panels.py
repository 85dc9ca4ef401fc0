"""Panel construction, as-of features, labels, splits and feature families."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.config import SplitSpec
from tidemark.operators import asof, audit, availability, cohort, labels, rank_ic, sampling, spine
from tidemark.plans import features, panel as P
from tidemark.sources.sinks import cut
from tidemark.workload import sql as S
from tidemark.workload import standins as D

R = lambda c, n=6: F.round(c, n)
E, Q = "company_uuid", "quarter_idx"
SPEC = D.panel_spec()
LABEL = SPEC.label


def split_counts(spark, sf):
    p = D.labelled_spine(spark, sf)
    return p.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(E).alias("companies"), F.sum(LABEL).alias("events")
    )


SPLIT_COUNTS = f"""WITH {S.SPINE} SELECT split, count(*)::BIGINT AS rows, count(DISTINCT company_uuid)::BIGINT AS companies,
  sum(label)::BIGINT AS events FROM panel WHERE split <> 'exclude' GROUP BY 1"""


def risk_intervals(spark, sf):
    base = spine.entity_base(D.companies(spark, sf), D.funding_rounds(spark, sf), SPEC, D.sector())
    exits = labels.first_exit(labels.exit_events(D.exit_sources(spark, sf), SPEC), SPEC)
    last = spine.mature_end(D.data_asof(spark, sf), SPEC)
    return spine.at_risk(base.join(exits, E, "left"), last, SPEC).select(E, "panel_start", "panel_end")


RISK_INTERVALS = f"""WITH {S.BASE} SELECT company_uuid, ps::INTEGER AS panel_start, pe::INTEGER AS panel_end FROM risk WHERE ps <= pe"""


def labelled_rows(spark, sf):
    return D.labelled_spine(spark, sf).select(E, Q, "sector_bucket", "exit_q", LABEL, "company_exit_route", "split")


LABELLED_ROWS = f"""WITH {S.SPINE} SELECT company_uuid, quarter_idx, sector_bucket, exit_q, label AS {S.LABEL_NAME},
  company_exit_route, split FROM panel WHERE split <> 'exclude'"""


def purged_splits(spark, sf):
    spec = D.panel_spec()
    purged = SplitSpec(spec.splits.train_end, spec.splits.validation_end, spec.splits.test_end, purge=2)
    p = D.labelled_spine(spark, sf, D.panel_spec())
    again = labels.split_rows(p.drop("split"), type(spec)(spec.window_start, purged))
    return again.groupBy("split", Q).agg(F.count(F.lit(1)).alias("rows"))


PURGED_SPLITS = f"""WITH {S.SPINE} SELECT split, quarter_idx, count(*)::BIGINT AS rows FROM panel
  WHERE split <> 'exclude' AND quarter_idx NOT IN (7990, 7991, 7994, 7995) GROUP BY 1, 2"""


def route_support(spark, sf):
    return labels.route_support(D.labelled_spine(spark, sf), SPEC)


ROUTE_SUPPORT = f"""WITH {S.SPINE} SELECT split, company_exit_route, count(*)::BIGINT AS rows,
  count(DISTINCT company_uuid)::BIGINT AS companies FROM panel WHERE label = 1 AND split <> 'exclude' GROUP BY 1, 2"""


def route_priors(spark, sf):
    p = labels.route_priors(D.labelled_spine(spark, sf), SPEC)
    return p.select("route", R(F.col("conditional_probability"), 9).alias("conditional_probability"))


ROUTE_PRIORS = f"""WITH {S.SPINE} SELECT company_exit_route AS route,
  round(count(*) / sum(count(*)) OVER (), 9) AS conditional_probability FROM panel WHERE label = 1 AND split = 'train' GROUP BY 1"""


def split_overlap(spark, sf):
    o = audit.split_overlap(D.labelled_spine(spark, sf), SPEC)
    return o.withColumn("share_of_test_companies_seen_in_train", R(F.col("share_of_test_companies_seen_in_train"), 9))


SPLIT_OVERLAP = f"""WITH {S.SPINE}, sides AS (SELECT company_uuid, max((split = 'train')::INTEGER) AS tr, max((split = 'test')::INTEGER) AS te
  FROM panel WHERE split <> 'exclude' GROUP BY 1) SELECT sum(tr)::BIGINT AS train_companies, sum(te)::BIGINT AS test_companies,
  sum(tr * te)::BIGINT AS overlap_companies, round(sum(tr * te) / sum(te), 9) AS share_of_test_companies_seen_in_train FROM sides"""

_ROUND_COLS = [
    "round_count_asof", "num_investors_last_round", "last_round_amount", "round_q", "age_q", "time_since_last_round_q",
    "last_round_amount_missing", "num_investors_missing", "stage_bucket",
]


def full_panel(spark, sf):
    p = D.panel(spark, sf).panel
    return p.select(
        E, Q, LABEL, "split", *_ROUND_COLS, R(F.col("cum_raised_asof"), 2).alias("cum_raised"),
        R(F.col("log_age_years")).alias("log_age_years"), R(F.col("log_last_round_usd")).alias("log_last_round_usd"),
        R(F.col("round_velocity")).alias("round_velocity"), "preqin_deal_count_asof",
        R(F.col("preqin_deal_size_sum_asof"), 2).alias("deal_size"), "crosswalk_matched_asof",
        "quarters_since_first_preqin_deal", R(F.col("log_enterprise_value_at_entry")).alias("log_ev"),
        "enterprise_value_missing_flag", R(F.col("sponsor_score")).alias("sponsor_score"),
    )


_PANEL_CTE = f"{S.SPINE}, {S.ROUND_Q}, {S.LINKS}, {S.DEAL_Q}, {S.ROUND_FEATURES}"
_ROUND_SQL = """round_count_asof::BIGINT AS round_count_asof, investors AS num_investors_last_round,
  amount AS last_round_amount, round_q, age_q, since AS time_since_last_round_q, (amount IS NULL)::INTEGER AS last_round_amount_missing,
  (investors IS NULL)::INTEGER AS num_investors_missing, stage_bucket"""
FULL_PANEL = f"""WITH {_PANEL_CTE} SELECT pr.company_uuid, quarter_idx, label AS {S.LABEL_NAME}, split, {_ROUND_SQL},
  round(cum_raised_asof, 2) AS cum_raised, round(ln(1 + age_q / 4), 6) AS log_age_years,
  round({S.log1p_clip('amount')}, 6) AS log_last_round_usd, round({S.ratio('round_count_asof', 'age_q / 4')}, 6) AS round_velocity,
  coalesce(d.deals, 0)::BIGINT AS preqin_deal_count_asof, round(coalesce(d.size, 0), 2) AS deal_size,
  (coalesce(d.deals, 0) > 0)::INTEGER AS crosswalk_matched_asof,
  CASE WHEN d.deals > 0 THEN (quarter_idx - first_q)::DOUBLE ELSE 0 END AS quarters_since_first_preqin_deal,
  round(ln(1 + d.ev), 6) AS log_ev, (d.ev IS NULL)::INTEGER AS enterprise_value_missing_flag,
  round((coalesce(d.deals, 0) > 0)::INTEGER + 0.25::DOUBLE * ln(1 + coalesce(investors, 0)), 6) AS sponsor_score
  FROM pr ASOF LEFT JOIN deal_c d ON pr.company_uuid = d.company_uuid AND pr.quarter_idx >= d.vq
  LEFT JOIN links ON pr.company_uuid = links.company_uuid WHERE split <> 'exclude'"""


def default_panel(spark, sf):
    """The panel with nothing overridden but word lists: matched buyouts are the third kind
    of exit, and the data end where the first of six tables ends."""
    inputs = D.inputs(spark, sf)
    latest = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias(E)).agg(F.max("o_orderdate").alias("collected_at"))
    companies = inputs.companies.drop("collected_at").join(latest, E, "left")
    p = P.build_panel(replace(inputs, companies=companies), SPEC, sector=D.sector(), stage=D.stage()).panel
    return p.select(E, Q, LABEL, "split", "exit_q", "company_exit_route", "round_count_asof", "preqin_deal_count_asof", "stage_bucket")


_MATCHED_SALES = f"""{S.LINKS}, sponsor AS (SELECT company_uuid, min(deal_date) AS d FROM pairs WHERE source = 'buyout' AND deal_date IS NOT NULL GROUP BY 1)"""
_SIX_TABLES = """asof_day AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(announced_on) FROM rounds), (SELECT max(d) FROM acq),
  (SELECT max(d) FROM ipos), (SELECT max(deal_date) FROM deals WHERE source = 'vc'), (SELECT max(deal_date) FROM deals WHERE source = 'buyout')) AS data_asof)"""
_TWO_TABLES = "asof_day AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS data_asof)"


def _default_sql() -> str:
    cte = f"{S.SPINE}, {S.ROUND_Q}, {S.DEAL_Q}, {S.ROUND_FEATURES}"
    for old, new in ((S.SPONSOR, _MATCHED_SALES), (_TWO_TABLES, _SIX_TABLES)):
        if old not in cte:
            raise ValueError(f"not part of the panel's SQL: {old}")
        cte = cte.replace(old, new)
    return f"""WITH {cte} SELECT pr.company_uuid, quarter_idx, label AS {S.LABEL_NAME}, split, exit_q, company_exit_route,
  round_count_asof::BIGINT AS round_count_asof, coalesce(d.deals, 0)::BIGINT AS preqin_deal_count_asof, stage_bucket
  FROM pr ASOF LEFT JOIN deal_c d ON pr.company_uuid = d.company_uuid AND pr.quarter_idx >= d.vq WHERE split <> 'exclude'"""


def _rounds_only(spark, sf, mode):
    """Spine and round facts only, in either as-of mode."""
    base = spine.entity_base(D.companies(spark, sf), D.funding_rounds(spark, sf), SPEC, D.sector())
    exits = labels.first_exit(labels.exit_events(D.exit_sources(spark, sf), SPEC), SPEC)
    last = spine.mature_end(D.data_asof(spark, sf), SPEC)
    base = spine.at_risk(base.join(exits, E, "left"), last, SPEC).select(E, "founded_q", "first_stage", "panel_start", "panel_end")
    block = P.round_block(D.funding_rounds(spark, sf), SPEC)
    return asof.asof_panel(base, [block], E, Q, SPEC.lag, mode)


def _asof_out(p):
    return p.select(E, Q, "round_count_asof", R(F.col("cum_raised_asof"), 2).alias("cum_raised"), "last_round_amount", "num_investors_last_round")


def asof_full_history(spark, sf):
    return _asof_out(_rounds_only(spark, sf, "full_history"))


ASOF_FULL = f"""WITH {S.SPINE}, {S.ROUND_Q} SELECT s.company_uuid, quarter_idx, round_count_asof::BIGINT AS round_count_asof,
  round(cum_raised_asof, 2) AS cum_raised, amount AS last_round_amount, investors AS num_investors_last_round
  FROM spine s ASOF LEFT JOIN round_c r ON s.company_uuid = r.company_uuid AND s.quarter_idx >= r.vq"""


def asof_panel_only(spark, sf):
    return _asof_out(_rounds_only(spark, sf, "panel_only"))


ASOF_PANEL_ONLY = f"""WITH {S.SPINE}, {S.ROUND_Q}, merged AS (
  SELECT s.company_uuid, s.quarter_idx, sum(n) OVER f AS c, r2.cum, r.amount, r.investors FROM spine s
  LEFT JOIN round_q r ON s.company_uuid = r.company_uuid AND s.quarter_idx = r.q + 1
  LEFT JOIN (SELECT company_uuid, vq, round_count_asof AS cnt, cum_raised_asof AS cum FROM round_c) r2
    ON s.company_uuid = r2.company_uuid AND s.quarter_idx = r2.vq WINDOW f AS (PARTITION BY s.company_uuid)),
counted AS (SELECT s.company_uuid, s.quarter_idx, rc.round_count_asof, rc.cum_raised_asof, r.amount, r.investors FROM spine s
  LEFT JOIN round_q r ON s.company_uuid = r.company_uuid AND s.quarter_idx = r.q + 1
  LEFT JOIN round_c rc ON s.company_uuid = rc.company_uuid AND s.quarter_idx = rc.vq)
SELECT company_uuid, quarter_idx, (last_value(round_count_asof IGNORE NULLS) OVER w)::BIGINT AS round_count_asof,
  round(last_value(cum_raised_asof IGNORE NULLS) OVER w, 2) AS cum_raised, last_value(amount IGNORE NULLS) OVER w AS last_round_amount,
  last_value(investors IGNORE NULLS) OVER w AS num_investors_last_round
  FROM counted WINDOW w AS (PARTITION BY company_uuid ORDER BY quarter_idx ROWS UNBOUNDED PRECEDING)"""


def merge_then_carry(spark, sf):
    """The two halves of the panel-only mode as separate operators."""
    rows = D.labelled_spine(spark, sf).select(E, Q)
    facts = asof.rounds_by_period(D.funding_rounds(spark, sf), E).select(E, "fact_period", "last_round_amount", "num_investors_last_round")
    merged = asof.merge_visible(rows, facts, E, Q)
    return asof.carry_forward(merged, E, Q, ["last_round_amount", "num_investors_last_round"])


MERGE_THEN_CARRY = f"""WITH {S.SPINE}, {S.ROUND_Q}, merged AS (
  SELECT s.company_uuid, quarter_idx, amount, investors FROM panel s LEFT JOIN round_q r
  ON s.company_uuid = r.company_uuid AND s.quarter_idx = r.q + 1 WHERE split <> 'exclude')
SELECT company_uuid, quarter_idx, last_value(amount IGNORE NULLS) OVER w AS last_round_amount,
  last_value(investors IGNORE NULLS) OVER w AS num_investors_last_round
  FROM merged WINDOW w AS (PARTITION BY company_uuid ORDER BY quarter_idx ROWS UNBOUNDED PRECEDING)"""


def patent_features(spark, sf):
    base = _spine_base(spark, sf)
    p = asof.asof_panel(base, [features.patent_block(D.companies(spark, sf), D.patents(spark, sf), SPEC)], E, Q, SPEC.lag)
    p = features.patent_features(p)
    return p.select(
        E, Q, "patent_grants_asof", R(F.col("backward_cites_mean_at_grant")).alias("cites"), R(F.col("grant_lag_mean")).alias("lag")
    )


def _spine_base(spark, sf):
    base = spine.entity_base(D.companies(spark, sf), D.funding_rounds(spark, sf), SPEC, D.sector())
    exits = labels.first_exit(labels.exit_events(D.exit_sources(spark, sf), SPEC), SPEC)
    last = spine.mature_end(D.data_asof(spark, sf), SPEC)
    return spine.at_risk(base.join(exits, E, "left"), last, SPEC).select(E, "panel_start", "panel_end")


_PAT_C = """pat_c AS (SELECT company_uuid, q + 1 AS vq, sum(grants) OVER w AS grants, sum(cites) OVER w AS cites, sum(lags) OVER w AS lags
  FROM pat_q WINDOW w AS (PARTITION BY company_uuid ORDER BY q ROWS UNBOUNDED PRECEDING))"""
PATENT_FEATURES = f"""WITH {S.SPINE}, {S.PATENT_Q}, {_PAT_C} SELECT s.company_uuid, quarter_idx, coalesce(grants, 0)::BIGINT AS patent_grants_asof,
  round({S.ratio('cites', 'grants')}, 6) AS cites, round({S.ratio('lags', 'grants')}, 6) AS lag
  FROM spine s ASOF LEFT JOIN pat_c p ON s.company_uuid = p.company_uuid AND s.quarter_idx >= p.vq"""


def homepage_features(spark, sf):
    base = _spine_base(spark, sf)
    block = features.homepage_block(D.companies(spark, sf), D.panel_cutoff_rows(spark, sf), SPEC)
    p = features.homepage_features(asof.asof_panel(base, [block], E, Q, SPEC.lag), SPEC)
    return p.select(E, Q, "cc_presence_streak", "cc_first_seen_web_age", "cc_decay_transition_flag", "cc_coverage_missing_flag")


HOMEPAGE_FEATURES = f"""WITH {S.SPINE}, {S.SNAPSHOTS}, {S.ACTIVE_Q} SELECT s.company_uuid, quarter_idx, coalesce(streak, 0) AS cc_presence_streak,
  CASE WHEN first_active_q IS NOT NULL THEN greatest(quarter_idx - first_active_q, 0) END AS cc_first_seen_web_age, coalesce(decay, 0) AS cc_decay_transition_flag,
  (streak IS NULL)::INTEGER AS cc_coverage_missing_flag
  FROM spine s ASOF LEFT JOIN act_c a ON s.company_uuid = a.company_uuid AND s.quarter_idx >= a.vq"""


def partner_features(spark, sf):
    p = features.attach_partner(D.labelled_spine(spark, sf).select(E, Q), D.partner_features(spark, sf), SPEC)
    return p.select(
        E, Q, "first_round_amount_missing", R(F.col("log_first_round_amount_usd")).alias("log_amount"),
        "first_round_investor_count_missing", R(F.col("log_first_round_investor_count")).alias("log_investors"),
        "quarters_since_first_funding", R(F.col("profile_completeness_score")).alias("completeness"),
        R(F.col("preqin_match_quality_score")).alias("quality"), "founder_count_missing",
    )


_SEEN = "coalesce(first_q <= quarter_idx - 1, false)"
PARTNER_FEATURES = f"""WITH {S.SPINE}, {S.PARTNER} SELECT p.company_uuid, quarter_idx,
  (NOT {_SEEN} OR amount IS NULL)::INTEGER AS first_round_amount_missing,
  round(CASE WHEN {_SEEN} THEN {S.log1p_clip('amount')} ELSE 0 END, 6) AS log_amount,
  (NOT {_SEEN} OR inv IS NULL)::INTEGER AS first_round_investor_count_missing,
  round(CASE WHEN {_SEEN} THEN {S.log1p_clip('inv')} ELSE 0 END, 6) AS log_investors,
  CASE WHEN {_SEEN} THEN quarter_idx - first_q END AS quarters_since_first_funding, round(completeness, 6) AS completeness,
  round(score0 + high + accepted - low, 6) AS quality, founder_count_missing
  FROM panel p LEFT JOIN partner t ON p.company_uuid = t.company_uuid WHERE split <> 'exclude'"""


def partner_audit(spark, sf):
    a = features.partner_audit(D.labelled_spine(spark, sf), D.partner_features(spark, sf), SPEC)
    return a.withColumn("matched_panel_company_share", R(F.col("matched_panel_company_share")))


PARTNER_AUDIT = f"""WITH {S.SPINE}, {S.PARTNER}, mine AS (SELECT DISTINCT company_uuid FROM panel WHERE split <> 'exclude')
  SELECT (SELECT count(*) FROM partner)::BIGINT AS partner_rows, (SELECT count(DISTINCT company_uuid) FROM partner)::BIGINT AS partner_companies,
  (SELECT count(*) FROM mine)::BIGINT AS panel_companies,
  (SELECT count(*) FROM mine WHERE company_uuid IN (SELECT company_uuid FROM partner))::BIGINT AS matched_panel_companies,
  round((SELECT count(*) FROM mine WHERE company_uuid IN (SELECT company_uuid FROM partner)) / (SELECT count(*) FROM mine), 6) AS matched_panel_company_share"""


def _since_panel(spark, sf):
    """Spine with rounds as of each quarter, the cohort columns and the split."""
    base = spine.entity_base(D.companies(spark, sf), D.funding_rounds(spark, sf), SPEC, D.sector())
    exits = labels.first_exit(labels.exit_events(D.exit_sources(spark, sf), SPEC), SPEC)
    last = spine.mature_end(D.data_asof(spark, sf), SPEC)
    base = spine.at_risk(base.join(exits, E, "left"), last, SPEC).select(
        E, "founded_q", "sector_bucket", "first_stage", "exit_q", "route_label", "panel_start", "panel_end"
    )
    p = asof.asof_panel(base, [P.round_block(D.funding_rounds(spark, sf), SPEC)], E, Q, SPEC.lag)
    p = P.round_features(p, SPEC, D.stage())
    return labels.split_rows(labels.label_rows(p, SPEC), SPEC)


def cohort_z(spark, sf):
    p = features.cohort_gap(cut(_since_panel(spark, sf), "since"), SPEC)
    return p.select(E, Q, "inter_round_gap_missing", R(F.col("inter_round_gap_vs_cohort_z")).alias("gap_z"))


_SINCE = f"{S.SPINE}, {S.ROUND_Q}, {S.ROUND_FEATURES}, kept AS (SELECT * FROM pr WHERE split <> 'exclude')"
COHORT_Z = f"""WITH {_SINCE}, g AS (
  SELECT sector_bucket, stage_bucket, avg(since) AS m, nullif(stddev_samp(since), 0) AS s FROM kept WHERE split = 'train' GROUP BY 1, 2)
SELECT company_uuid, quarter_idx, (since IS NULL)::INTEGER AS inter_round_gap_missing, round((since - m) / s, 6) AS gap_z
  FROM kept LEFT JOIN g USING (sector_bucket, stage_bucket)"""


def cohort_moments(spark, sf):
    m = cohort.cohort_moments(_since_panel(spark, sf), "time_since_last_round_q", ["sector_bucket", "stage_bucket"], F.col("split") == "train")
    return m.select("sector_bucket", "stage_bucket", R(F.col("cohort_mean")).alias("cohort_mean"), R(F.col("cohort_std")).alias("cohort_std"))


COHORT_MOMENTS = f"""WITH {_SINCE} SELECT sector_bucket, stage_bucket, round(avg(since), 6) AS cohort_mean,
  round(nullif(stddev_samp(since), 0), 6) AS cohort_std FROM kept WHERE split = 'train' GROUP BY 1, 2"""


def residuals(spark, sf):
    # whole amounts: their sums are exact, so both engines divide the same numbers
    c = D.table(spark, sf, "orders").withColumns({"year": F.year("o_orderdate"), "whole": F.floor("o_totalprice").cast("double")})
    out = cohort.residualize(c, "whole", ["o_orderpriority", "year"], ["o_orderkey"], "residual")
    return out.select("o_orderkey", R(F.col("residual"), 4).alias("residual"))


RESIDUALS = """SELECT o_orderkey, round(floor(o_totalprice) - avg(floor(o_totalprice)) OVER (PARTITION BY o_orderpriority, year(o_orderdate)), 4) AS residual FROM orders"""

# What the panel holds before the wider families are attached, as SQL over ``kept``.
_IC_SQL = {
    "log_age_years": "ln(1 + age_q / 4)", "time_since_last_round_q": "since", "log_last_round_usd": S.log1p_clip("amount"),
    "last_round_amount_missing": "(amount IS NULL)::INTEGER",
    "sponsor_score": "(deals > 0)::INTEGER + 0.25::DOUBLE * ln(1 + coalesce(investors, 0))", "quarter_idx": "quarter_idx",
    "num_investors_last_round": "investors", "num_investors_missing": "(investors IS NULL)::INTEGER",
    "round_velocity": S.ratio("round_count_asof", "age_q / 4"), "preqin_institutional_confirmation": "(deals > 0)::INTEGER",
    "preqin_deal_count_asof": "deals", "quarters_since_first_preqin_deal": "CASE WHEN deals > 0 THEN (quarter_idx - first_q)::DOUBLE ELSE 0 END",
    "preqin_deal_size_sum_asof": "size", "crosswalk_matched_asof": "(deals > 0)::INTEGER", "log_enterprise_value_at_entry": "ln(1 + ev)",
    "enterprise_value_missing_flag": "(ev IS NULL)::INTEGER",
}
IC_FAMILIES = {
    family: found
    for family, names in {**features.FAMILIES, "baseline": features.BASELINE_NUMERIC}.items()
    if (found := [f for f in names if f in _IC_SQL])
}


def rank_ic_sweep(spark, sf):
    """Baseline and every family feature that the panel itself holds. Sums of deal sizes are
    rounded, so that equal totals tie whatever the order of their terms."""
    oot = D.panel(spark, sf).panel.filter(F.col("split").isin("validation", "test"))
    oot = cut(oot.withColumn("preqin_deal_size_sum_asof", F.round("preqin_deal_size_sum_asof", 2)), "out-of-time")
    ic = rank_ic.residual_rank_ic_by_family(oot, IC_FAMILIES, LABEL)
    return ic.select("family", "feature", R(F.col("residual_rank_ic"), 8).alias("residual_rank_ic"))


def _ic_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, ({c})::DOUBLE AS v, label AS y, sector_bucket || '|' || stage_bucket || "
        f"{repr('') if f == 'quarter_idx' else chr(39) + '|' + chr(39) + ' || quarter_idx'} AS g "
        f"FROM kept WHERE ({c}) IS NOT NULL"
        for f, c in _IC_SQL.items()
    )
    listed = ", ".join(f"('{family}', '{f}')" for family, names in IC_FAMILIES.items() for f in names)

    def rank(x: str) -> str:
        return (
            f"(rank() OVER (PARTITION BY feature ORDER BY {x}) + (count(*) OVER (PARTITION BY feature, {x}) - 1) / 2)"
        )

    return f"""WITH {_PANEL_CTE}, kept AS (SELECT pr.*, coalesce(d.deals, 0) AS deals, round(coalesce(d.size, 0), 2) AS size, d.ev, first_q
    FROM pr ASOF LEFT JOIN deal_c d ON pr.company_uuid = d.company_uuid AND pr.quarter_idx >= d.vq
    LEFT JOIN links ON pr.company_uuid = links.company_uuid WHERE split IN ('validation', 'test')),
  long AS ({rows}),
  twice AS (SELECT *, (2 * {rank('v')})::HUGEINT AS px, (2 * {rank('y')})::HUGEINT AS py, count(*) OVER (PARTITION BY feature, g) AS n FROM long),
  res AS (SELECT feature, v, y, (px * n - sum(px) OVER (PARTITION BY feature, g)) / n AS rx, (py * n - sum(py) OVER (PARTITION BY feature, g)) / n AS ry FROM twice),
  rk AS (SELECT feature, v, y, {rank('rx')} AS a, {rank('ry')} AS b FROM res),
  ic AS (SELECT feature, round(CASE WHEN count(*) >= 100 AND count(DISTINCT v) >= 3 AND count(DISTINCT y) >= 2 THEN corr(a, b) END, 8) AS residual_rank_ic
    FROM rk GROUP BY 1)
  SELECT family, feature, residual_rank_ic FROM (VALUES {listed}) l(family, feature) LEFT JOIN ic USING (feature)"""


def family_availability(spark, sf):
    frame = features.model_frame(D.inputs(spark, sf, families=True), SPEC, **D.panel_options(spark, sf))
    a = availability.availability(frame.frame, features.FAMILIES, frame.blocked)
    return a.select("family", "feature", "status")


# What the tables at hand must give: the placeholders and constants by construction, the
# rest varies. Names are the registry, so this is a check of the registry against the data.
def _availability_sql() -> str:
    constant = {
        "lead_prior_hard_exit_rate_asof", "syndicate_investor_centrality_max", "insider_only_round_flag",
        "has_lead_investor_flag", "founder_prior_founding_count", "founder_prior_exit_flag", "valuation_step_up_last",
        "log_revenue_at_entry", "ebitda_margin_at_entry", "entry_multiple_vs_vintage_sector_median",
        "buyout_fundamentals_missing_flag", "has_short_description",
    }
    measured = {
        "inter_round_gap_missing": "(since IS NULL)::INTEGER",
        "num_investors_missing": "(investors IS NULL)::INTEGER",
        "first_round_amount_missing": f"(NOT {_SEEN} OR t.amount IS NULL)::INTEGER",
        "first_round_investor_count_missing": f"(NOT {_SEEN} OR inv IS NULL)::INTEGER",
    }
    flags = ", ".join(f"min({x}) < max({x}) AS {n}" for n, x in measured.items())
    rows = []
    for family, names in features.FAMILIES.items():
        for n in names:
            if n in measured:
                status = f"CASE WHEN {n} THEN 'built' ELSE 'present_constant_or_missing' END"
            else:
                status = "'present_constant_or_missing'" if n in constant else "'built'"
            rows.append(f"SELECT '{family}' AS family, '{n}' AS feature, {status} AS status FROM m")
    return f"""WITH {_SINCE}, {S.PARTNER}, m AS (SELECT {flags} FROM kept k LEFT JOIN partner t ON k.company_uuid = t.company_uuid)
  {' UNION ALL '.join(rows)}"""


def feature_ranges(spark, sf):
    p = _since_panel(spark, sf)
    names = ["time_since_last_round_q", "num_investors_last_round", "last_round_amount_missing", "cum_raised_asof"]
    r = availability.feature_ranges(p, names)
    return r.select("feature", R(F.col("low"), 2).alias("low"), R(F.col("high"), 2).alias("high"))


FEATURE_RANGES = f"""WITH {_SINCE} """ + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(min(({c})::DOUBLE), 2) AS low, round(max(({c})::DOUBLE), 2) AS high FROM kept"
    for n, c in {
        "time_since_last_round_q": "since", "num_investors_last_round": "investors",
        "last_round_amount_missing": "(amount IS NULL)::INTEGER", "cum_raised_asof": "cum_raised_asof",
    }.items()
)


def capped_training_rows(spark, sf):
    train = D.labelled_spine(spark, sf).filter(F.col("split") == "train").select(E, Q, LABEL)
    return sampling.cap_training_rows(train, LABEL, [E, Q], max_rows=1500)


CAPPED = f"""WITH {S.SPINE}, d AS (SELECT company_uuid, quarter_idx, label, {S.uniform(S.digest('company_uuid', 'quarter_idx', '42'))} AS u,
  {S.digest('company_uuid', 'quarter_idx')} AS tie FROM panel WHERE split = 'train'),
  n AS (SELECT count(*) FILTER (WHERE label = 1) AS e, count(*) FILTER (WHERE label = 0) AS o FROM d),
  q AS (SELECT *, CASE WHEN e + o <= 1500 THEN e ELSE least(e, 750) END AS take_e,
        CASE WHEN e + o <= 1500 THEN o ELSE least(o, 1500 - least(e, 750)) END AS take_o FROM n)
  SELECT company_uuid, quarter_idx, label AS {S.LABEL_NAME} FROM d, q
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY u, tie, company_uuid, quarter_idx) <= CASE WHEN label = 1 THEN take_e ELSE take_o END"""


QUERIES = {
    "A13_route_support": (route_support, ROUTE_SUPPORT),
    "F3_L4_risk_intervals": (risk_intervals, RISK_INTERVALS),
    "W6_L2_L3_L5_labelled_rows": (labelled_rows, LABELLED_ROWS),
    "F5_split_counts": (split_counts, SPLIT_COUNTS),
    "L5_purged_splits": (purged_splits, PURGED_SPLITS),
    "A12_route_priors": (route_priors, ROUTE_PRIORS),
    "A14_T5_split_overlap": (split_overlap, SPLIT_OVERLAP),
    "W2_asof_full_history": (asof_full_history, ASOF_FULL),
    "W2_asof_panel_only": (asof_panel_only, ASOF_PANEL_ONLY),
    "J6_merge_then_carry": (merge_then_carry, MERGE_THEN_CARRY),
    "L7_full_panel": (full_panel, FULL_PANEL),
    "L1_L7_default_sources": (default_panel, _default_sql()),
    "E20_patent_features": (patent_features, PATENT_FEATURES),
    "E20_homepage_features": (homepage_features, HOMEPAGE_FEATURES),
    "E20_J5_F4_partner_features": (partner_features, PARTNER_FEATURES),
    "E20_partner_audit": (partner_audit, PARTNER_AUDIT),
    "A8_cohort_moments": (cohort_moments, COHORT_MOMENTS),
    "W7_J9_cohort_gap_z": (cohort_z, COHORT_Z),
    "W9_residuals": (residuals, RESIDUALS),
    "E1_feature_ranges": (feature_ranges, FEATURE_RANGES),
    "E2_P19_family_availability": (family_availability, _availability_sql()),
    "E3_E4_residual_rank_ic": (rank_ic_sweep, _ic_sql()),
    "T9_capped_training_rows": (capped_training_rows, CAPPED),
}
