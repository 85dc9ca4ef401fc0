"""Projections, filters and casts over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import nulls, periods, scores, text
from tidemark.functions.hashing import key_digest
from tidemark.operators import matching
from tidemark.operators.ordered import first_row_per_key, order_key
from tidemark.plans import features
from tidemark.sources.snapshots import listing_url
from tidemark.sources.tabular import table_profile
from tidemark.workload import sql as S
from tidemark.workload import standins as D

R = lambda c, n=6: F.round(c, n)


def tolerant_casts(spark, sf):
    e = D.table(spark, sf, "events")
    stamp = F.when(F.col("event_type") == "error", "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    number = F.when(F.col("event_type") == "click", "x").otherwise(F.regexp_extract("props", r"(\d+)", 1))
    return e.select("event_id", F.date_format(nulls.to_timestamp_utc(stamp), "yyyy-MM-dd HH:mm:ss").alias("seen"), nulls.to_number(number).alias("k"))


TOLERANT_CASTS = r"""SELECT event_id,
  CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS seen,
  CASE WHEN event_type <> 'click' THEN try_cast(regexp_extract(props, '(\d+)', 1) AS DOUBLE) END AS k FROM events"""


def quarter_numbers(spark, sf):
    idx = periods.period_index(F.col("o_orderdate"))
    return D.table(spark, sf, "orders").select(
        "o_orderkey",
        idx.alias("quarter_idx"),
        periods.quarter_label(idx).alias("label"),
        periods.quarter_from_label(periods.quarter_label(idx)).alias("back"),
        periods.visible_from(idx).alias("visible_q"),
        periods.period_index(F.col("o_orderdate"), "month").alias("month_idx"),
        periods.period_index(F.col("o_orderdate"), "week").alias("week_idx"),
        periods.period_index(F.col("o_orderdate"), "day").alias("day_idx"),
    )


QUARTER_NUMBERS = f"""SELECT o_orderkey, {S.quarter('o_orderdate')} AS quarter_idx,
  year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label, {S.quarter('o_orderdate')} AS back,
  {S.quarter('o_orderdate')} + 1 AS visible_q, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INTEGER AS month_idx,
  floor(date_diff('day', DATE '1970-01-05', o_orderdate::DATE) / 7.0)::INTEGER AS week_idx,
  date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS day_idx FROM orders"""


def domain_keys(spark, sf):
    return D.table(spark, sf, "pages").select(
        "page_id",
        text.domain_key(F.col("url")).alias("strict_domain"),
        text.domain_key(F.col("url"), strict=False).alias("lenient_domain"),
    )


DOMAIN_KEYS = f"""SELECT page_id, {S.domain('url')} AS strict_domain, {S.domain('url', False)} AS lenient_domain FROM pages"""


def name_keys(spark, sf):
    key = text.name_key(F.col("text"))
    return D.table(spark, sf, "documents").select("doc_id", F.md5(key.cast("binary")).alias("name_md5"), F.length(key).alias("n"))


NAME_KEYS = f"""SELECT doc_id, md5({S.name('"text"')}) AS name_md5, length({S.name('"text"')})::INTEGER AS n FROM documents"""


def sector_buckets(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", text.sector_bucket(F.col("text")).alias("sector_bucket"))


SECTOR_BUCKETS = f"""SELECT doc_id, {S.sector('"text"')} AS sector_bucket FROM documents"""

# stage wordings by order priority; one priority has none
WORDINGS = {"1-URGENT": "Pre-Seed", "2-HIGH": "Series A", "3-MEDIUM": "series_b", "4-NOT SPECIFIED": "private_equity"}


def stage_buckets(spark, sf):
    wording = None
    for code, words in WORDINGS.items():
        hit = F.col("o_orderpriority") == code
        wording = F.when(hit, words) if wording is None else wording.when(hit, words)
    return D.table(spark, sf, "orders").select("o_orderkey", text.stage_bucket(wording).alias("stage_bucket"))


STAGE_BUCKETS = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'seed' WHEN '2-HIGH' THEN 'series_a'
  WHEN '3-MEDIUM' THEN 'series_b' WHEN '4-NOT SPECIFIED' THEN 'growth' ELSE 'unknown' END AS stage_bucket FROM orders"""


def country_keys(spark, sf):
    country = F.when(F.col("c_nationkey") > 3, F.concat(F.lit(" N"), F.col("c_nationkey").cast("string"), F.lit(" ")))
    return D.table(spark, sf, "customer").select(
        "c_custkey",
        text.country_key(country).alias("country_key"),
        text.country_key(country, missing_matches=True).alias("parity_key"),
    )


COUNTRY_KEYS = """SELECT c_custkey, CASE WHEN c_nationkey > 3 THEN 'n' || c_nationkey END AS country_key,
  CASE WHEN c_nationkey > 3 THEN 'n' || c_nationkey ELSE 'nan' END AS parity_key FROM customer"""


def amount_guards(spark, sf):
    amount = F.when(F.col("c_nationkey") != 5, F.col("c_acctbal"))
    den = F.col("c_nationkey").cast("double")
    then = F.when(F.col("c_nationkey") > 1, F.col("c_nationkey"))
    count = F.when(F.col("c_nationkey") > 2, F.col("c_nationkey"))
    return D.table(spark, sf, "customer").select(
        "c_custkey",
        R(nulls.log1p_clip(amount)).alias("log_filled"),
        R(nulls.log1p_keep_null(amount)).alias("log_kept"),
        nulls.missing_flag(amount).alias("missing"),
        R(nulls.ratio(amount, den)).alias("ratio"),
        R(nulls.clip(nulls.ratio(amount, den * 1000), 0.0, 1.0)).alias("share"),
        nulls.elapsed(F.lit(10), then).alias("elapsed"),
        F.coalesce(count, F.lit(0)).alias("filled_count"),
        (F.coalesce(count, F.lit(0)) > 0).cast("int").alias("matched"),
        R(scores.sponsor_score(nulls.missing_flag(amount), then)).alias("sponsor_score"),
    )


_AMT = "(CASE WHEN c_nationkey <> 5 THEN c_acctbal END)"
AMOUNT_GUARDS = f"""SELECT c_custkey, round({S.log1p_clip(_AMT)}, 6) AS log_filled,
  round(CASE WHEN {_AMT} IS NOT NULL THEN ln(1 + greatest({_AMT}, 0)) END, 6) AS log_kept,
  ({_AMT} IS NULL)::INTEGER AS missing, round({S.ratio(_AMT, 'c_nationkey')}, 6) AS ratio,
  round(CASE WHEN {S.ratio(_AMT, 'c_nationkey')} IS NOT NULL THEN greatest(0, least(1, {_AMT} / (c_nationkey::DOUBLE * 1000))) END, 6) AS share,
  CASE WHEN c_nationkey > 1 THEN greatest(10 - c_nationkey, 0) END AS elapsed,
  CASE WHEN c_nationkey > 2 THEN c_nationkey ELSE 0 END AS filled_count, (c_nationkey > 2)::INTEGER AS matched,
  round(({_AMT} IS NULL)::INTEGER + 0.25::DOUBLE * ln(1 + (CASE WHEN c_nationkey > 1 THEN c_nationkey ELSE 0 END)::DOUBLE), 6) AS sponsor_score
  FROM customer"""


def partner_scores(spark, sf):
    t = features.partner_table(D.partner_features(spark, sf), "company_uuid")
    return t.select(
        "company_uuid", "founder_count", "founder_count_missing", R(F.col("log_founder_count")).alias("log_founder_count"),
        R(F.col("founder_identifier_coverage_ratio")).alias("coverage"),
        R(F.col("log_founder_identifier_count")).alias("log_ids"),
        R(F.col("log_crunchbase_category_count")).alias("log_cats"),
        R(F.col("profile_completeness_score")).alias("completeness"), R(F.col("preqin_match_score")).alias("score"),
        F.col("preqin_match_score_missing").alias("score_missing"), F.col("preqin_confidence_high_flag").alias("high"),
        F.col("preqin_low_confidence_flag").alias("low"), F.col("partner_preqin_accepted_match_flag").alias("accepted"),
        R(F.col("preqin_match_quality_score")).alias("quality"), F.col("first_funding_q_partner").alias("first_q"),
    )


PARTNER_SCORES = f"""WITH {S.PARTNER} SELECT company_uuid, founder_count, founder_count_missing,
  round({S.log1p_clip('founder_count')}, 6) AS log_founder_count, round(coverage, 6) AS coverage,
  round({S.log1p_clip('ids')}, 6) AS log_ids, round(ln(1 + cats), 6) AS log_cats, round(completeness, 6) AS completeness,
  round(score0, 6) AS score, score_missing, high, low, accepted, round(score0 + high + accepted - low, 6) AS quality, first_q FROM partner"""


def placebo(spark, sf):
    return D.table(spark, sf, "orders").select(
        "o_orderkey", R(scores.noise_placebo(F.col("o_orderkey"), F.col("o_custkey"))).alias("noise_placebo")
    )


PLACEBO = f"""SELECT o_orderkey, round({S.gaussian(S.digest('o_orderkey', 'o_custkey', '42'))}, 6) AS noise_placebo FROM orders"""


def grant_lags(spark, sf):
    p = D.patents(spark, sf).withColumn("lag", periods.lag_days(F.col("grantdate"), F.col("appldate")))
    return p.groupBy("ee_name").agg(
        F.count("lag").alias("patents"), F.min("lag").alias("shortest"), F.max("lag").alias("longest"), F.sum("lag").alias("days")
    )


GRANT_LAGS = """SELECT p_name AS ee_name, count(*)::BIGINT AS patents, min(lag)::INTEGER AS shortest, max(lag)::INTEGER AS longest, sum(lag)::BIGINT AS days
  FROM (SELECT p_name, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS lag FROM lineitem
        JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1"""


def unified_deals(spark, sf):
    d = matching.unified_deals(D.vc_deals(spark, sf), D.buyout_deals(spark, sf))
    return d.groupBy("portfolio_company_id", "preqin_deal_source").agg(
        F.count(F.lit(1)).alias("deals"),
        R(F.sum("preqin_deal_size_usd"), 2).alias("size"),
        R(F.sum("enterprisevalue"), 2).alias("value"),
    )


UNIFIED_DEALS = f"""WITH {S.DEALS} SELECT pcid AS portfolio_company_id, source AS preqin_deal_source, count(*)::BIGINT AS deals,
  round(sum(size), 2) AS size, round(sum(ev), 2) AS value FROM deals GROUP BY 1, 2"""


def percent_text(spark, sf):
    share = F.round(F.col("c_acctbal") / 100000, 4)
    known = F.when(F.col("c_nationkey") != 0, share)
    return D.table(spark, sf, "customer").select(
        "c_custkey", text.percent(known).alias("plain"), text.percent(known, signed=True).alias("signed"),
        text.percent_interval(known, share * 2).alias("interval"),
    )


PERCENT_TEXT = """SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN '' ELSE printf('%.2f%%', s * 100) END AS plain,
  CASE WHEN c_nationkey = 0 THEN '' ELSE printf('%+.2f%%', s * 100) END AS signed,
  CASE WHEN c_nationkey = 0 THEN '--' ELSE printf('[%+.2f%%, %+.2f%%]', s * 100, s * 200) END AS interval
  FROM (SELECT *, CASE WHEN abs(c_acctbal) < 5 THEN 0 ELSE round(c_acctbal / 100000, 4) END AS s FROM customer)"""


def listing_urls(spark, sf):
    return D.page_domains(spark, sf).select("website_domain", listing_url(F.col("website_domain")).alias("source_url"))


LISTING_URLS = f"""SELECT DISTINCT d AS website_domain, 'https://web.archive.org/cdx?url=' || url_encode(d || '/')
  || '&matchType=prefix&output=json&fl=timestamp%2Coriginal%2Cstatuscode%2Cmimetype%2Cdigest&filter=statuscode%3A200'
  || '&collapse=timestamp%3A8&from=20100101000000&to=20231231235959&limit=5000' AS source_url
  FROM (SELECT {S.domain('url')} AS d FROM pages) WHERE d <> ''"""


def profile(spark, sf):
    names = ["customer", "orders", "lineitem", "part", "pages", "documents", "events"]
    return table_profile({n: D.table(spark, sf, n) for n in names})


PROFILE = " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", count(*)::BIGINT AS rows FROM {n}"
    for n in ["customer", "orders", "lineitem", "part", "pages", "documents", "events"]
)


def usable_keys(spark, sf):
    e = matching.entity_keys(D.companies(spark, sf))
    kinds = {"domain": matching.DOMAIN_KEY, "name_country": matching.NAME_KEY, "all": matching.FULL_KEY}
    parts = [
        matching.usable(e, keys).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows")) for kind, keys in kinds.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


USABLE_KEYS = f"""WITH {S.COMPANIES}, {S.LINKS}
  SELECT 'domain' AS kind, count(*)::BIGINT AS rows FROM ek WHERE nd <> ''
  UNION ALL SELECT 'name_country', count(*)::BIGINT FROM ek WHERE nn <> '' AND ck IS NOT NULL
  UNION ALL SELECT 'all', count(*)::BIGINT FROM ek WHERE nd <> '' AND nn <> '' AND ck IS NOT NULL"""


def first_rows(spark, sf):
    o = D.table(spark, sf, "orders")
    return first_row_per_key(o, ["o_custkey"], order_key("o_orderdate", "o_orderkey")).select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice"
    )


FIRST_ROWS = """SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"""


def hashed_draws(spark, sf):
    from tidemark.functions.hashing import digest_uniform, poisson_one

    u = digest_uniform(key_digest(F.col("o_orderkey"), 7))
    return D.table(spark, sf, "orders").select("o_orderkey", R(u, 9).alias("draw"), poisson_one(u).alias("copies"))


_U = S.uniform(S.digest("o_orderkey", "7"))
HASHED_DRAWS = f"""SELECT o_orderkey, round({_U}, 9) AS draw, CASE WHEN {_U} <= 0.36787944117144233 THEN 0 WHEN {_U} <= 0.73575888234288467 THEN 1
  WHEN {_U} <= 0.91969860292860584 THEN 2 WHEN {_U} <= 0.98101184312384626 THEN 3 WHEN {_U} <= 0.99634015317265634 THEN 4
  WHEN {_U} <= 0.99940581518241836 THEN 5 WHEN {_U} <= 0.99991675885071196 THEN 6 WHEN {_U} <= 0.99998975080332537 THEN 7
  WHEN {_U} <= 0.99999887479740203 THEN 8 WHEN {_U} <= 0.99999988857452166 THEN 9 WHEN {_U} <= 0.99999998995223363 THEN 10
  WHEN {_U} <= 0.99999999916838922 THEN 11 ELSE 12 END AS copies FROM orders"""


QUERIES = {
    "P1_P2_tolerant_casts": (tolerant_casts, TOLERANT_CASTS),
    "P3_P4_P5_P28_period_numbers": (quarter_numbers, QUARTER_NUMBERS),
    "P6_P7_domain_keys": (domain_keys, DOMAIN_KEYS),
    "P8_name_keys": (name_keys, NAME_KEYS),
    "P9_sector_buckets": (sector_buckets, SECTOR_BUCKETS),
    "P10_stage_buckets": (stage_buckets, STAGE_BUCKETS),
    "P11_country_keys": (country_keys, COUNTRY_KEYS),
    "P12_P13_P14_P15_P16_P26_P27_amount_guards": (amount_guards, AMOUNT_GUARDS),
    "P17_partner_scores": (partner_scores, PARTNER_SCORES),
    "P20_noise_placebo": (placebo, PLACEBO),
    "P21_grant_lags": (grant_lags, GRANT_LAGS),
    "P22_unified_deals": (unified_deals, UNIFIED_DEALS),
    "P23_percent_text": (percent_text, PERCENT_TEXT),
    "P25_listing_urls": (listing_urls, LISTING_URLS),
    "S9_table_profile": (profile, PROFILE),
    "F1_F2_usable_keys": (usable_keys, USABLE_KEYS),
    "J16_A17_first_row_per_key": (first_rows, FIRST_ROWS),
    "hashed_draws": (hashed_draws, HASHED_DRAWS),
}
