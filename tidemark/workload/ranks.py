"""Global order, metrics, calibration, bootstrap, gates and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit, gates, metrics, prefix, ranking
from tidemark.operators.skew import top_k
from tidemark.sources.sinks import cut
from tidemark.workload import sql as S
from tidemark.workload import standins as D

R = lambda c, n=6: F.round(c, n)
E, Q = "company_uuid", "quarter_idx"
SPEC = D.panel_spec()
LABEL = SPEC.label
KEY = [E, Q]


def _orders(spark, sf):
    """Orders with a smooth and a heavily tied value."""
    return D.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", F.floor(F.col("o_totalprice") / 100000).cast("int").alias("tier")
    )


_TIER = "floor(o_totalprice / 100000)::INTEGER"


def value_prefix(spark, sf):
    p = prefix.value_prefix(_orders(spark, sf), "o_totalprice", ["o_orderpriority"])
    return p.select("o_orderpriority", "o_totalprice", "n", "n_before", "n_total")


VALUE_PREFIX = """SELECT o_orderpriority, o_totalprice, n, (sum(n) OVER w - n)::BIGINT AS n_before,
  (sum(n) OVER (PARTITION BY o_orderpriority))::BIGINT AS n_total
  FROM (SELECT o_orderpriority, o_totalprice, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice ROWS UNBOUNDED PRECEDING)"""


def percent_rank(spark, sf):
    smooth = ranking.percent_rank_ties(_orders(spark, sf), "o_totalprice", ["o_orderkey"], out="pct_price")
    both = ranking.percent_rank_ties(smooth, "tier", ["o_orderkey"], out="pct_tier")
    return both.select("o_orderkey", R(F.col("pct_price"), 9).alias("pct_price"), R(F.col("pct_tier"), 9).alias("pct_tier"))


def _mid(x: str) -> str:
    return f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2) / count(*) OVER ()"


PERCENT_RANK = f"""SELECT o_orderkey, round({_mid('o_totalprice')}, 9) AS pct_price, round({_mid(_TIER)}, 9) AS pct_tier FROM orders"""


def equal_count_bins(spark, sf):
    o = _orders(spark, sf)
    smooth = ranking.equal_count_bins(o, "o_totalprice", ["o_orderkey"], 10, out="price_bin")
    return ranking.equal_count_bins(smooth, "tier", ["o_orderkey"], 7, ["o_orderpriority"], out="tier_bin").select(
        "o_orderkey", "price_bin", "tier_bin"
    )


def _bin(rn: str, n: str, bins: int) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 ELSE greatest(ceil(({rn} - 1) * {bins} / ({n} - 1)) - 1, 0) END::INTEGER"


EQUAL_COUNT_BINS = f"""WITH o AS (SELECT o_orderkey, o_orderpriority,
  row_number() OVER (ORDER BY o_totalprice, md5(o_orderkey::VARCHAR), o_orderkey) AS rp, count(*) OVER () AS np,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_TIER}, md5(o_orderkey::VARCHAR), o_orderkey) AS rt,
  count(*) OVER (PARTITION BY o_orderpriority) AS nt FROM orders)
  SELECT o_orderkey, {_bin('rp', 'np', 10)} AS price_bin, {_bin('rt', 'nt', 7)} AS tier_bin FROM o"""


def quantiles(spark, sf):
    lines = D.table(spark, sf, "lineitem")
    p = prefix.value_prefix(lines, "l_extendedprice", ["l_returnflag"])
    q = prefix.exact_quantiles(p, "l_extendedprice", {"median": 0.5, "p90": 0.9}, ["l_returnflag"])
    return q.select("l_returnflag", R(F.col("median"), 4).alias("median"), R(F.col("p90"), 4).alias("p90"))


QUANTILES = """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1"""


def top_orders(spark, sf):
    o = _orders(spark, sf)
    best = top_k(o, ["o_orderpriority"], 50, [F.desc("tier"), F.asc("o_orderkey")], ["o_orderkey"])
    return best.select("o_orderpriority", "o_orderkey", "tier", "top_rank")


TOP_ORDERS = f"""SELECT o_orderpriority, o_orderkey, {_TIER} AS tier, r::INTEGER AS top_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_TIER} DESC, o_orderkey) AS r FROM orders) WHERE r <= 50"""


def _pred(spark, sf):
    """Predictions as a written table: every metric reads them more than once."""
    return cut(D.predictions(spark, sf), "predictions")


def _rounded(df, keep, digits=8):
    return df.select(*keep, *[R(F.col(c), digits).alias(c) for c in df.columns if c not in keep])


def precision_at(spark, sf):
    p = metrics.precision_at_k(_pred(spark, sf), (100, 1000), LABEL, KEY)
    return _rounded(p, ["model", "variant"])


_TOP = "row_number() OVER (PARTITION BY model, variant ORDER BY score DESC, company_uuid, quarter_idx)"
PRECISION_AT = f"""WITH {S.PREDICTIONS}, r AS (SELECT *, {_TOP} AS rn FROM pred)
  SELECT model, variant, round(avg(label) FILTER (WHERE rn <= 100), 8) AS precision_at_100,
  round(avg(label) FILTER (WHERE rn <= 1000), 8) AS precision_at_1000 FROM r GROUP BY 1, 2"""

_DECILES = f"""dec AS (SELECT *, greatest(least(score, 1), 0) AS s, row_number() OVER (PARTITION BY model, variant
  ORDER BY score, md5(company_uuid || '|' || quarter_idx), company_uuid, quarter_idx) AS rn, count(*) OVER (PARTITION BY model, variant) AS n FROM pred),
  cal AS (SELECT model, variant, {_bin('rn', 'n', 10)} AS decile, avg(s) AS predicted, avg(label) AS realized, count(*)::BIGINT AS rows
  FROM dec GROUP BY 1, 2, 3)"""
_AUC = """ranked AS (SELECT *, rank() OVER (PARTITION BY model, variant ORDER BY score)
    + (count(*) OVER (PARTITION BY model, variant, score) - 1) / 2 AS mid,
    count(*) OVER (PARTITION BY model, variant ORDER BY score DESC) AS taken,
    sum(label) OVER (PARTITION BY model, variant ORDER BY score DESC) AS hits FROM pred),
  auc AS (SELECT model, variant, sum(label) AS p, count(*) AS rows,
    (sum(mid) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS roc_auc,
    sum(hits / taken) FILTER (WHERE label = 1) / sum(label) AS pr_auc,
    avg((greatest(least(score, 1), 0) - label) ** 2) AS brier, quantile_cont(score, 0.9) AS threshold FROM ranked GROUP BY 1, 2)"""


def calibration(spark, sf):
    c = metrics.binned_calibration(_pred(spark, sf), LABEL, KEY)
    return _rounded(c, ["model", "variant", "decile", "rows"])


CALIBRATION = f"""WITH {S.PREDICTIONS}, {_DECILES} SELECT model, variant, decile, rows, round(predicted, 8) AS predicted, round(realized, 8) AS realized FROM cal"""


def pooled_calibration(spark, sf):
    c = metrics.binned_calibration(_pred(spark, sf), LABEL, KEY, pooled=True)
    return _rounded(c, ["model", "variant", "decile", "rows"])


POOLED = f"""WITH {S.PREDICTIONS}, dec AS (SELECT *, row_number() OVER (
  ORDER BY score, md5(model || '|' || variant || '|' || company_uuid || '|' || quarter_idx)) AS rn, count(*) OVER () AS n FROM pred)
  SELECT model, variant, {_bin('rn', 'n', 10)} AS decile, round(avg(score), 8) AS predicted, round(avg(label), 8) AS realized,
  count(*)::BIGINT AS rows FROM dec GROUP BY 1, 2, 3"""


def calibration_error(spark, sf):
    c = metrics.binned_calibration(_pred(spark, sf), LABEL, KEY)
    return _rounded(metrics.expected_calibration_error(c), ["model", "variant"])


CALIBRATION_ERROR = f"""WITH {S.PREDICTIONS}, {_DECILES} SELECT model, variant,
  round(sum(rows * abs(realized - predicted)) / sum(rows), 8) AS ece FROM cal GROUP BY 1, 2"""


def rank_quality(spark, sf):
    return _rounded(metrics.rank_quality(metrics.score_prefix(_pred(spark, sf), LABEL)), ["model", "variant"])


RANK_QUALITY = f"""WITH {S.PREDICTIONS}, {_AUC} SELECT model, variant, round(pr_auc, 8) AS pr_auc, round(roc_auc, 8) AS roc_auc FROM auc"""


def document_labels(spark, sf):
    """Both binary document labels ranked by a score of the document's length."""
    docs = D.table(spark, sf, "documents").select("doc_id", F.round(1 / (1 + F.exp(-(F.col("n_chars") / 1000 - 1))), 4).alias("score"))
    labels = D.table(spark, sf, "labels")
    rows = labels.join(docs, "doc_id").select(
        "score", F.inline(F.array(*[F.struct(F.lit(n).alias("target"), F.col(n).alias("y")) for n in ("quality", "toxic")]))
    )
    quality = metrics.rank_quality(metrics.score_prefix(rows, "y", ["target"]), ["target"])
    return _rounded(quality.join(metrics.brier(rows, "y", ["target"]), "target"), ["target", "rows", "events"])


DOCUMENT_LABELS = """WITH rows AS (SELECT t AS target, CASE WHEN t = 'quality' THEN quality ELSE toxic END AS y,
    round(1 / (1 + exp(-(n_chars / 1000 - 1))), 4) AS score FROM labels JOIN documents USING (doc_id), (SELECT unnest(['quality', 'toxic']) AS t)),
  r AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY score) + (count(*) OVER (PARTITION BY target, score) - 1) / 2 AS mid,
    count(*) OVER (PARTITION BY target ORDER BY score DESC) AS taken, sum(y) OVER (PARTITION BY target ORDER BY score DESC) AS hits FROM rows)
  SELECT target, count(*)::BIGINT AS rows, sum(y)::BIGINT AS events, round(sum(hits / taken) FILTER (WHERE y = 1) / sum(y), 8) AS pr_auc,
  round((sum(mid) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 8) AS roc_auc,
  round(avg((score - y) ** 2), 8) AS brier FROM r GROUP BY 1"""


def brier(spark, sf):
    return _rounded(metrics.brier(_pred(spark, sf), LABEL), ["model", "variant", "rows", "events"])


BRIER = f"""WITH {S.PREDICTIONS} SELECT model, variant, count(*)::BIGINT AS rows, sum(label)::BIGINT AS events,
  round(avg((score - label) ** 2), 8) AS brier FROM pred GROUP BY 1, 2"""


def _threshold_sql(threshold: str) -> str:
    return f"""t AS (SELECT model, variant, {threshold} AS threshold FROM auc),
  c AS (SELECT model, variant, threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp,
    count(*) FILTER (WHERE score >= threshold) AS called, sum(label) AS p, count(*) AS rows FROM pred JOIN t USING (model, variant) GROUP BY ALL),
  cls AS (SELECT model, variant, threshold, (rows - called - p + 2 * tp) / rows AS accuracy, coalesce(tp / nullif(called, 0), 0) AS precision,
    coalesce(tp / nullif(p, 0), 0) AS recall, coalesce(2 * tp / nullif(called + p, 0), 0) AS f1 FROM c)"""


def threshold_quality(spark, sf):
    return _rounded(metrics.threshold_quality(metrics.score_prefix(_pred(spark, sf), LABEL)), ["model", "variant"])


_CLS_OUT = "round(accuracy, 8) AS accuracy, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1"
THRESHOLD_QUALITY = f"""WITH {S.PREDICTIONS}, {_AUC}, {_threshold_sql('threshold')} SELECT model, variant, round(threshold, 8) AS threshold, {_CLS_OUT} FROM cls"""


def given_threshold(spark, sf):
    p = metrics.score_prefix(_pred(spark, sf), LABEL)
    return _rounded(metrics.threshold_quality(p, threshold=0.55), ["model", "variant"])


GIVEN_THRESHOLD = f"""WITH {S.PREDICTIONS}, {_AUC}, {_threshold_sql('0.55::DOUBLE')} SELECT model, variant, threshold, {_CLS_OUT} FROM cls"""


def metric_rows(spark, sf):
    m = metrics.metric_rows(_pred(spark, sf), LABEL, KEY)
    return _rounded(m, ["model", "variant", "split", "rows", "events"])


_METRICS = f"""{S.PREDICTIONS}, {_DECILES}, {_AUC}, {_threshold_sql('threshold')},
  topn AS (SELECT *, {_TOP} AS rn FROM pred),
  prec AS (SELECT model, variant, avg(label) FILTER (WHERE rn <= 500) AS precision_at_500, avg(label) FILTER (WHERE rn <= 5000) AS precision_at_5000 FROM topn GROUP BY 1, 2),
  ece AS (SELECT model, variant, sum(rows * abs(realized - predicted)) / sum(rows) AS ece FROM cal GROUP BY 1, 2),
  mets AS (SELECT * FROM prec JOIN auc USING (model, variant) JOIN ece USING (model, variant) JOIN cls USING (model, variant))"""
METRIC_ROWS = f"""WITH {_METRICS} SELECT model, variant, 'test' AS split, rows::BIGINT AS rows, p::BIGINT AS events,
  {', '.join(f'round({c}, 8) AS {c}' for c in ('precision_at_500', 'precision_at_5000', 'pr_auc', 'roc_auc', 'brier', 'ece', 'accuracy', 'precision', 'recall', 'f1'))} FROM mets"""


def paired(spark, sf):
    p = gates.paired_scores(_pred(spark, sf), LABEL, KEY)
    return p.groupBy("model", "variant").agg(
        F.count(F.lit(1)).alias("rows"), R(F.avg(F.col("cand_score") - F.col("base_score")), 8).alias("mean_gain"),
        F.sum((F.col("cand_score") > F.col("base_score")).cast("int")).alias("higher"),
    )


PAIRED = f"""WITH {S.PREDICTIONS} SELECT model, c.variant, count(*)::BIGINT AS rows, round(avg(c.score - b.score), 8) AS mean_gain,
  sum((c.score > b.score)::INTEGER)::BIGINT AS higher FROM pred c JOIN pred b USING (model, company_uuid, quarter_idx)
  WHERE b.variant = 'baseline' AND c.variant <> 'baseline' GROUP BY 1, 2"""

BOOT_K, BOOT_N = 500, 500


def bootstrap(spark, sf):
    reps = gates.bootstrap_precision(_pred(spark, sf), LABEL, KEY, k=BOOT_K, n_boot=BOOT_N)
    return _rounded(gates.bootstrap_deltas(reps), ["model", "variant"])


# The distribution function of Poisson(1).
_POISSON = [
    0.36787944117144233, 0.73575888234288467, 0.91969860292860584, 0.98101184312384626, 0.99634015317265634, 0.99940581518241836,
    0.99991675885071196, 0.99998975080332537, 0.99999887479740203, 0.99999988857452171,
]
_COPIES = "CASE " + " ".join(f"WHEN u <= {p} THEN {n}" for n, p in enumerate(_POISSON)) + " ELSE 10 END"
_FOUR = S.digest("company_uuid", "quarter_idx", "four", "42")
_BOOT = f"""top_rows AS (SELECT *, {_TOP} AS top_rank FROM pred),
  fours AS (SELECT company_uuid, quarter_idx, four, {_FOUR} AS digest
    FROM (SELECT DISTINCT company_uuid, quarter_idx FROM pred), (SELECT unnest(range({BOOT_N // 4})) AS four)),
  uniforms AS (SELECT company_uuid, quarter_idx, 4 * four + slot AS b, (('0x' || substring(digest, (8 * slot + 1)::INTEGER, 8))::BIGINT + 0.5) / 4294967296.0 AS u
    FROM fours, (SELECT unnest(range(4)) AS slot)),
  draws AS (SELECT company_uuid, quarter_idx, b, {_COPIES} AS w FROM uniforms),
  weights AS (SELECT t.model, t.variant, t.top_rank, t.label, d.b, d.w FROM top_rows t JOIN draws d USING (company_uuid, quarter_idx)),
  upto AS (SELECT *, sum(w) OVER (PARTITION BY model, variant, b ORDER BY top_rank ROWS UNBOUNDED PRECEDING) AS cum FROM weights),
  reps AS (SELECT model, variant, b, sum(greatest(0, least(w, {BOOT_K} - (cum - w))) * label) / sum(greatest(0, least(w, {BOOT_K} - (cum - w)))) AS prec FROM upto GROUP BY 1, 2, 3),
  deltas AS (SELECT c.model, c.variant, avg(c.prec - a.prec) AS delta_vs_baseline, quantile_cont(c.prec - a.prec, 0.025) AS ci_low,
    quantile_cont(c.prec - a.prec, 0.975) AS ci_high FROM reps c JOIN reps a ON c.model = a.model AND c.b = a.b AND a.variant = 'baseline'
    WHERE c.variant <> 'baseline' GROUP BY 1, 2)"""
BOOTSTRAP = f"""WITH {S.PREDICTIONS}, {_BOOT} SELECT model, variant, round(delta_vs_baseline, 8) AS delta_vs_baseline,
  round(ci_low, 8) AS ci_low, round(ci_high, 8) AS ci_high FROM deltas"""


def _gates(spark, sf):
    pred = _pred(spark, sf)
    m = cut(metrics.metric_rows(pred, LABEL, KEY), "metrics")
    deltas = gates.bootstrap_deltas(gates.bootstrap_precision(pred, LABEL, KEY, k=BOOT_K, n_boot=BOOT_N))
    return m, gates.promotion_gates(m, deltas)


def promotion_gates(spark, sf):
    return _rounded(_gates(spark, sf)[1], ["model", "variant", "promotion_pass"])


_GATED = f"""gated AS (SELECT m.*, CASE WHEN m.variant = 'baseline' THEN 0 ELSE d.delta_vs_baseline END AS delta_vs_baseline, ci_low, ci_high,
    m.brier - a.brier AS brier_delta, m.ece - a.ece AS ece_delta,
    coalesce(m.variant <> 'baseline' AND ci_low > 0 AND m.brier - a.brier <= 0.0025 AND m.ece - a.ece <= 0.01, false)::INTEGER AS promotion_pass
  FROM mets m JOIN mets a ON m.model = a.model AND a.variant = 'baseline' LEFT JOIN deltas d ON m.model = d.model AND m.variant = d.variant)"""
PROMOTION_GATES = f"""WITH {_METRICS}, {_BOOT}, {_GATED} SELECT model, variant, promotion_pass,
  {', '.join(f'round({c}, 8) AS {c}' for c in ('precision_at_500', 'delta_vs_baseline', 'ci_low', 'ci_high', 'brier_delta', 'ece_delta'))} FROM gated"""


def final_summary(spark, sf):
    """All 17 columns. Numbers are rounded before they become text, so that a half is not
    decided by the last bit of a sum."""
    m, g = _gates(spark, sf)
    text = ["model", "variant"]
    return gates.final_summary(_rounded(m, [*text, "split", "rows", "events"]), _rounded(g, [*text, "promotion_pass"]))


def _percent(x: str, plus: str = "") -> str:
    """Two decimals, a half going up as in the decimal notation of the rounded number."""
    size = f"(round((abs(round({x}, 8)) * 100)::VARCHAR::DECIMAL(38, 18), 2)::DECIMAL(18, 2))::VARCHAR"
    return f"(CASE WHEN round({x}, 8) < 0 THEN '-' ELSE '{plus}' END || {size} || '%')"


FINAL_SUMMARY = f"""WITH {_METRICS}, {_BOOT}, {_GATED} SELECT model, variant, {_percent('precision_at_500')} AS "Precision@500",
  {_percent('precision_at_5000')} AS "Precision@5000", coalesce({_percent('delta_vs_baseline', '+')}, '') AS "Delta vs baseline",
  coalesce('[' || {_percent('ci_low', '+')} || ', ' || {_percent('ci_high', '+')} || ']', '--') AS "95% bootstrap CI",
  {', '.join(f'round({c}, 8) AS {c}' for c in ('pr_auc', 'roc_auc', 'brier', 'brier_delta', 'ece', 'ece_delta', 'accuracy', 'precision', 'recall', 'f1'))},
  promotion_pass FROM gated"""


def policy_backtest(spark, sf):
    return _rounded(audit.policy_backtest(_pred(spark, sf), SPEC), ["model", "variant", "top_k", "selected_rows", "selected_companies"])


POLICY = f"""WITH {S.PREDICTIONS}, r AS (SELECT *, {_TOP} AS rn FROM pred), rates AS (SELECT model, variant, avg(label) AS rate FROM pred GROUP BY 1, 2)
  SELECT model, variant, k::INTEGER AS top_k, count(*)::BIGINT AS selected_rows, count(DISTINCT company_uuid)::BIGINT AS selected_companies,
  round(avg(label), 8) AS selected_realized_rate, round(any_value(rate), 8) AS test_base_rate, round(avg(label) / any_value(rate), 8) AS lift
  FROM r JOIN rates USING (model, variant), (SELECT unnest([500, 5000]) AS k) WHERE rn <= k GROUP BY 1, 2, 3"""


def _audited(spark, sf):
    """The audited selection over the whole panel, deal columns included."""
    frame = cut(D.panel(spark, sf).panel.select(*KEY, LABEL, "split", "exit_q", "company_exit_route", *audit.AUDIT_MEANS, *audit.AUDIT_MEDIANS), "audit-panel")
    pred = cut(D.predictions(spark, sf, frame), "predictions")
    return audit.audited_top(pred, frame, SPEC)


_AUDITED = f"""{S.LINKS}, {S.DEAL_Q}, seen AS (SELECT DISTINCT company_uuid FROM panel WHERE split = 'train'),
  ranked AS (SELECT * FROM (SELECT *, {_TOP} AS rn FROM pred) WHERE rn <= 5000),
  facts AS (SELECT r.*, (coalesce(d.deals, 0) > 0)::INTEGER AS matched, coalesce(d.deals, 0)::BIGINT AS deals, coalesce(d.size, 0) AS size, d.ev,
      CASE WHEN d.deals > 0 THEN (r.quarter_idx - first_q)::DOUBLE ELSE 0 END AS since
    FROM ranked r ASOF LEFT JOIN deal_c d ON r.company_uuid = d.company_uuid AND r.quarter_idx >= d.vq
    LEFT JOIN links ON r.company_uuid = links.company_uuid),
  top_audit AS (SELECT f.*, k::INTEGER AS top_k, exit_q - quarter_idx AS wait, (company_uuid IN (SELECT company_uuid FROM seen))::INTEGER AS in_train
    FROM facts f, (SELECT unnest([500, 5000]) AS k) WHERE rn <= k)"""


def topk_summary(spark, sf):
    s = audit.topk_summary(_audited(spark, sf), SPEC)
    s = s.withColumn("top_median_preqin_deal_size_sum_asof", R(F.col("top_median_preqin_deal_size_sum_asof"), 2))
    ints = ["model", "variant", "top_k", "top_rows", "top_companies", "duplicate_company_rows", "event_rows", "event_rows_with_exit_q", "high_precision_flag_ge_75pct"]
    return _rounded(s, ints)


TOPK_SUMMARY = f"""WITH {S.PREDICTIONS}, {_AUDITED} SELECT model, variant, top_k, count(*)::BIGINT AS top_rows,
  count(DISTINCT company_uuid)::BIGINT AS top_companies, (count(*) - count(DISTINCT company_uuid))::BIGINT AS duplicate_company_rows,
  round(avg(label), 8) AS top_realized_rate, round(avg(in_train), 8) AS company_seen_in_train_share, sum(label)::BIGINT AS event_rows,
  count(wait) FILTER (WHERE label = 1)::BIGINT AS event_rows_with_exit_q, round(median(wait) FILTER (WHERE label = 1), 8) AS median_quarters_to_exit_among_events,
  round(avg((wait BETWEEN 0 AND 1)::INTEGER) FILTER (WHERE label = 1), 8) AS share_event_rows_exit_within_1q,
  round(avg((wait BETWEEN 0 AND 2)::INTEGER) FILTER (WHERE label = 1), 8) AS share_event_rows_exit_within_2q,
  (avg(label) >= 0.75)::INTEGER AS high_precision_flag_ge_75pct, round(avg(matched), 8) AS top_mean_preqin_institutional_confirmation,
  round(avg(matched), 8) AS top_mean_crosswalk_matched_asof, round(avg((ev IS NULL)::INTEGER), 8) AS top_mean_enterprise_value_missing_flag,
  median(deals) AS top_median_preqin_deal_count_asof, median(since) AS top_median_quarters_since_first_preqin_deal,
  round(median(size), 2) AS top_median_preqin_deal_size_sum_asof, round(median(ln(1 + ev)), 8) AS top_median_log_enterprise_value_at_entry
  FROM top_audit GROUP BY 1, 2, 3"""


def topk_detail(spark, sf):
    d = audit.topk_detail(_audited(spark, sf), SPEC)
    return d.withColumns({c: R(F.col(c), n) for c, n in (("preqin_deal_size_sum_asof", 2), ("log_enterprise_value_at_entry", 8))})


TOPK_DETAIL = f"""WITH {S.PREDICTIONS}, {_AUDITED} SELECT model, variant, top_k, rn::INTEGER AS top_rank, company_uuid, quarter_idx, score,
  label AS {S.LABEL_NAME}, company_exit_route, exit_q, wait AS quarters_to_exit, in_train AS company_seen_in_train,
  matched AS preqin_institutional_confirmation, matched AS crosswalk_matched_asof, deals AS preqin_deal_count_asof,
  since AS quarters_since_first_preqin_deal, round(size, 2) AS preqin_deal_size_sum_asof, round(ln(1 + ev), 8) AS log_enterprise_value_at_entry,
  (ev IS NULL)::INTEGER AS enterprise_value_missing_flag FROM top_audit"""


QUERIES = {
    "G1_value_prefix": (value_prefix, VALUE_PREFIX),
    "W10_percent_rank": (percent_rank, PERCENT_RANK),
    "W11_equal_count_bins": (equal_count_bins, EQUAL_COUNT_BINS),
    "A16_quantiles": (quantiles, QUANTILES),
    "T2_W12_top_k": (top_orders, TOP_ORDERS),
    "E5_precision_at_k": (precision_at, PRECISION_AT),
    "E6_calibration_error": (calibration_error, CALIBRATION_ERROR),
    "E7_E8_rank_quality": (rank_quality, RANK_QUALITY),
    "E7_E8_E9_document_labels": (document_labels, DOCUMENT_LABELS),
    "E9_brier": (brier, BRIER),
    "E10_threshold_quality": (threshold_quality, THRESHOLD_QUALITY),
    "E10_given_threshold": (given_threshold, GIVEN_THRESHOLD),
    "E11_metric_rows": (metric_rows, METRIC_ROWS),
    "E12_bootstrap_deltas": (bootstrap, BOOTSTRAP),
    "E13_promotion_gates": (promotion_gates, PROMOTION_GATES),
    "E15_A15_calibration_deciles": (calibration, CALIBRATION),
    "E15_pooled_deciles": (pooled_calibration, POOLED),
    "E16_policy_backtest": (policy_backtest, POLICY),
    "E17_J12_topk_summary": (topk_summary, TOPK_SUMMARY),
    "E18_topk_detail": (topk_detail, TOPK_DETAIL),
    "E19_J13_final_summary": (final_summary, FINAL_SUMMARY),
    "J10_paired_scores": (paired, PAIRED),
}
