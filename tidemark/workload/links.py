"""Entity links, first events, per-period facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, labels, matching, ordered, spine
from tidemark.operators.runs import activity_runs
from tidemark.operators.skew import spread_join
from tidemark.operators.snapshot_asof import activity_by_period
from tidemark.plans.panel import match_tables
from tidemark.workload import sql as S
from tidemark.workload import standins as D

R = lambda c, n=6: F.round(c, n)
DAY = lambda c: F.date_format(c, "yyyy-MM-dd")
E = "company_uuid"


def _sides(spark, sf):
    tables = match_tables(D.inputs(spark, sf), D.panel_spec())
    return tables.entities, tables.ledger


def _links(keys):
    def run(spark, sf):
        entities, ledger = _sides(spark, sf)
        found = matching.link_summary(entities, ledger, keys, E)
        return found.select(E, "n_deals", DAY("first_date").alias("first_date"), DAY("first_buyout").alias("first_buyout"))

    return run


def _links_sql(method: str) -> str:
    return f"""WITH {S.COMPANIES}, {S.LINKS} SELECT company_uuid, count(*)::BIGINT AS n_deals,
  strftime(min(deal_date), '%Y-%m-%d') AS first_date,
  strftime(min(deal_date) FILTER (WHERE source = 'buyout'), '%Y-%m-%d') AS first_buyout
  FROM pairs WHERE method = '{method}' GROUP BY 1"""


def crosswalk_first(spark, sf):
    entities, ledger = _sides(spark, sf)
    c = matching.crosswalk_first(entities, ledger, E)
    return c.select(
        E, DAY("first_preqin_deal_date").alias("first_date"), F.col("preqin_deal_count_total").alias("n"),
        "match_methods", "first_preqin_deal_q",
    )


CROSSWALK_FIRST = f"""WITH {S.COMPANIES}, {S.LINKS} SELECT company_uuid, strftime(first_date, '%Y-%m-%d') AS first_date, n,
  methods AS match_methods, first_q AS first_preqin_deal_q FROM links"""


def fan_out(spark, sf):
    entities, ledger = _sides(spark, sf)
    return matching.fan_out(entities, ledger, matching.DOMAIN_KEY)


FAN_OUT = f"""WITH {S.COMPANIES}, {S.LINKS} SELECT nd AS norm_domain, e.n AS entities, d.n AS deals, (e.n * d.n)::BIGINT AS pairs
  FROM (SELECT nd, count(*)::BIGINT AS n FROM ek WHERE nd <> '' GROUP BY 1) e
  JOIN (SELECT nd, count(*)::BIGINT AS n FROM dk WHERE nd <> '' GROUP BY 1) d USING (nd)"""


def match_coverage(spark, sf):
    """Matched share and the size of the pair list by method, read off the link sums."""
    entities, ledger = _sides(spark, sf)
    c = matching.crosswalk_first(entities, ledger, E)
    both = entities.select(E).distinct().join(c, E, "left")
    matched = F.count("preqin_deal_count_total")
    return both.agg(
        F.count(F.lit(1)).alias("cb_companies"), matched.alias("matched_companies"),
        R(matched / F.count(F.lit(1))).alias("matched_share"), F.sum("preqin_deal_count_total").alias("crosswalk_rows"),
    )


MATCH_COVERAGE = f"""WITH {S.COMPANIES}, {S.LINKS} SELECT (SELECT count(DISTINCT company_uuid) FROM companies)::BIGINT AS cb_companies,
  count(DISTINCT company_uuid)::BIGINT AS matched_companies,
  round(count(DISTINCT company_uuid) / (SELECT count(DISTINCT company_uuid) FROM companies), 6) AS matched_share,
  count(*)::BIGINT AS crosswalk_rows FROM pairs"""


def method_counts(spark, sf):
    entities, ledger = _sides(spark, sf)
    kinds = {"domain": matching.DOMAIN_KEY, "normalized_name_country": matching.NAME_KEY}
    parts = [
        matching.fan_out(entities, ledger, keys).agg(F.lit(m).alias("match_method"), F.sum("pairs").alias("rows"))
        for m, keys in kinds.items()
    ]
    return parts[0].unionByName(parts[1]).orderBy(F.desc("rows"))


METHOD_COUNTS = f"""WITH {S.COMPANIES}, {S.LINKS} SELECT method AS match_method, count(*)::BIGINT AS rows FROM pairs GROUP BY 1"""


def deals_by_period(spark, sf):
    t = match_tables(D.inputs(spark, sf), D.panel_spec())
    d = matching.deals_by_period(t.entities, t.ledger, E, t.repeated)
    return d.select(
        E, "fact_period", F.col("preqin_deals_in_q").alias("n"), R(F.col("preqin_deal_size_in_q"), 2).alias("size"),
        F.col("buyout_enterprise_value_latest_q").alias("ev"),
    )


DEALS_BY_PERIOD = f"""WITH {S.COMPANIES}, {S.LINKS}, {S.DEAL_Q} SELECT company_uuid, q AS fact_period, n, round(size, 2) AS size, ev FROM deal_q"""


def patents_by_period(spark, sf):
    p = matching.patents_by_period(D.companies(spark, sf), D.patents(spark, sf), E)
    return p.select(
        E, "fact_period", "patent_grants_in_q", R(F.col("backward_cites_sum_in_q"), 2).alias("cites"),
        R(F.col("grant_lag_sum_in_q"), 2).alias("lags"),
    )


PATENTS_BY_PERIOD = f"""WITH {S.COMPANIES}, {S.PATENT_Q} SELECT company_uuid, q AS fact_period, grants AS patent_grants_in_q,
  round(cites, 2) AS cites, round(lags, 2) AS lags FROM pat_q"""


def homepage_activity(spark, sf):
    domains = matching.domain_entities(D.companies(spark, sf), E)
    return activity_by_period(D.panel_cutoff_rows(spark, sf), domains, E)


HOMEPAGE_ACTIVITY = f"""WITH {S.COMPANIES}, {S.SNAPSHOTS}, {S.ACTIVE_Q} SELECT company_uuid, q AS fact_period,
  active AS cc_active_at_cutoff, n AS cc_source_rows FROM act"""


def homepage_runs(spark, sf):
    return activity_runs(homepage_activity(spark, sf), E, "fact_period", "cc_active_at_cutoff")


HOMEPAGE_RUNS = f"""WITH {S.COMPANIES}, {S.SNAPSHOTS}, {S.ACTIVE_Q} SELECT company_uuid, q AS fact_period,
  active AS cc_active_at_cutoff, n AS cc_source_rows, first_active_q, decay AS cc_decay_transition_flag,
  streak AS cc_presence_streak FROM act_c"""


def first_round(spark, sf):
    f = ordered.first_round(D.funding_rounds(spark, sf), E)
    return f.select(
        E, DAY("first_round_date").alias("first_date"), "first_stage", "first_round_amount_usd", "first_round_num_investors"
    )


FIRST_ROUND = f"""WITH {S.ROUNDS}, {S.FIRST_ROUND} SELECT company_uuid, strftime(first_round_date, '%Y-%m-%d') AS first_date,
  first_stage, first_money AS first_round_amount_usd, first_investors AS first_round_num_investors FROM first_round"""


def exit_events(spark, sf):
    events = labels.exit_events(D.exit_sources(spark, sf), D.panel_spec())
    return events.groupBy("route_label", "route_priority").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(E).alias("companies"), R(F.sum("event_value_usd"), 2).alias("value")
    )


EXIT_EVENTS = f"""WITH {S.EXITS} SELECT route AS route_label, pri::INTEGER AS route_priority, count(*)::BIGINT AS rows,
  count(DISTINCT company_uuid)::BIGINT AS companies, round(sum(v), 2) AS value FROM exit_events GROUP BY 1, 2"""


def first_exit(spark, sf):
    spec = D.panel_spec()
    x = labels.first_exit(labels.exit_events(D.exit_sources(spark, sf), spec), spec)
    return x.select(E, DAY("exit_date").alias("exit_date"), "route_label", "event_value_usd", "exit_q")


FIRST_EXIT = f"""WITH {S.EXITS} SELECT company_uuid, strftime(exit_date, '%Y-%m-%d') AS exit_date, route_label,
  event_value_usd, exit_q FROM exits"""


def rounds_by_period(spark, sf):
    r = asof.rounds_by_period(D.funding_rounds(spark, sf), E)
    return r.select(
        E, "fact_period", "round_count_in_q", R(F.col("raised_in_q"), 2).alias("raised"), "last_round_amount",
        "num_investors_last_round", "raw_stage_label",
    )


ROUNDS_BY_PERIOD = f"""WITH {S.ROUNDS}, {S.ROUND_Q} SELECT company_uuid, q AS fact_period, n AS round_count_in_q,
  round(raised, 2) AS raised, amount AS last_round_amount, investors AS num_investors_last_round, stage AS raw_stage_label FROM round_q"""


def running_totals(spark, sf):
    r = asof.rounds_by_period(D.funding_rounds(spark, sf), E)
    t = asof.running_totals(r, E, "fact_period", {"round_count_in_q": "rounds", "raised_in_q": "raised"})
    return t.select(E, "fact_period", "rounds", R(F.col("raised"), 2).alias("raised"))


RUNNING_TOTALS = f"""WITH {S.ROUNDS}, {S.ROUND_Q} SELECT company_uuid, q AS fact_period, round_count_asof::BIGINT AS rounds,
  round(cum_raised_asof, 2) AS raised FROM round_c"""


def data_asof(spark, sf):
    return D.data_asof(spark, sf).select(DAY("data_asof").alias("data_asof"))


DATA_ASOF = "SELECT strftime(least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)), '%Y-%m-%d') AS data_asof"


def entity_base(spark, sf):
    b = spine.entity_base(D.companies(spark, sf), D.funding_rounds(spark, sf), D.panel_spec(), D.sector())
    return b.select(E, "sector_bucket", "first_stage", "entry_q", "founded_q", DAY("start_date").alias("start_date"))


ENTITY_BASE = f"""WITH {S.BASE} SELECT company_uuid, sector_bucket, b.first_stage, entry_q, entry_q AS founded_q,
  strftime(first_round_date, '%Y-%m-%d') AS start_date FROM base b JOIN first_round USING (company_uuid)"""


def seen_elsewhere(spark, sf):
    """Membership flag: customers with an outcome event, spread over their orders."""
    spec = D.panel_spec()
    exited = labels.exit_events(D.exit_sources(spark, sf), spec).select(E).distinct().withColumn("hit", F.lit(1))
    orders = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias(E))
    joined = spread_join(orders, exited, [E], ["o_orderkey"], how="left")
    return joined.select("o_orderkey", F.coalesce("hit", F.lit(0)).alias("exited"))


SEEN_ELSEWHERE = f"""WITH {S.EXITS} SELECT o_orderkey, (o_custkey::VARCHAR IN (SELECT company_uuid FROM exit_events))::INTEGER AS exited FROM orders"""


def daily_purchase_runs(spark, sf):
    """The same run operators on an event stream with the day as its period."""
    from tidemark.functions.periods import period_index

    days = (
        D.table(spark, sf, "events")
        .groupBy("user_id", period_index(F.col("ts"), "day").alias("day_idx"))
        .agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"), F.count(F.lit(1)).alias("events"))
    )
    return activity_runs(days, "user_id", "day_idx", "bought").withColumnsRenamed(
        {"first_active_q": "first_day", "cc_presence_streak": "streak", "cc_decay_transition_flag": "stopped"}
    )


DAILY_PURCHASE_RUNS = """WITH days AS (
  SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS day_idx,
         max((event_type = 'purchase')::INTEGER) AS bought, count(*)::BIGINT AS events FROM events GROUP BY 1, 2),
r AS (SELECT *, min(CASE WHEN bought = 1 THEN day_idx END) OVER w AS first_day, sum(1 - bought) OVER w AS island,
        coalesce(lag(bought) OVER (PARTITION BY user_id ORDER BY day_idx) = 1 AND bought = 0, false)::INTEGER AS stopped
      FROM days WINDOW w AS (PARTITION BY user_id ORDER BY day_idx ROWS UNBOUNDED PRECEDING))
SELECT user_id, day_idx, bought, events, first_day, stopped,
  (sum(bought) OVER (PARTITION BY user_id, island ORDER BY day_idx ROWS UNBOUNDED PRECEDING))::INTEGER AS streak FROM r"""


QUERIES = {
    "J1_domain_links": (_links(matching.DOMAIN_KEY), _links_sql("domain")),
    "J2_name_country_links": (_links(matching.NAME_KEY), _links_sql("normalized_name_country")),
    "J3_A3_crosswalk_first": (crosswalk_first, CROSSWALK_FIRST),
    "J1_fan_out": (fan_out, FAN_OUT),
    "A10_match_coverage": (match_coverage, MATCH_COVERAGE),
    "A11_match_method_counts": (method_counts, METHOD_COUNTS),
    "A5_W8_deals_by_period": (deals_by_period, DEALS_BY_PERIOD),
    "J7_A6_patents_by_period": (patents_by_period, PATENTS_BY_PERIOD),
    "J8_A7_homepage_activity": (homepage_activity, HOMEPAGE_ACTIVITY),
    "W3_W4_W5_homepage_runs": (homepage_runs, HOMEPAGE_RUNS),
    "A1_first_round": (first_round, FIRST_ROUND),
    "L1_T4_exit_events": (exit_events, EXIT_EVENTS),
    "A2_first_exit": (first_exit, FIRST_EXIT),
    "A4_rounds_by_period": (rounds_by_period, ROUNDS_BY_PERIOD),
    "W1_running_totals": (running_totals, RUNNING_TOTALS),
    "A9_data_asof": (data_asof, DATA_ASOF),
    "L6_J4_entity_base": (entity_base, ENTITY_BASE),
    "J14_seen_elsewhere": (seen_elsewhere, SEEN_ELSEWHERE),
    "D5_daily_purchase_runs": (daily_purchase_runs, DAILY_PURCHASE_RUNS),
}
