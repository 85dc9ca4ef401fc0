"""Reference SQL for the registered queries, written the plain way: joins list all pairs,
windows sort everything. It only has to be right on small tables."""

from __future__ import annotations

from tidemark.workload.standins import CUTOFFS

Q = "quarter_idx"

# Fixed values, stated apart from the code under test so that a fault there shows.
LEGAL_WORDS = ["inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "sa", "sas", "ag"]
SECTOR_KEYWORDS = {
    "software": ["software", "saas", "cloud", "data", "ai ", "artificial intelligence"],
    "healthcare": ["health", "medical", "biotech", "pharma", "therapeutic"],
    "financial": ["financ", "bank", "payment", "insur", "lending", "credit"],
    "energy": ["energy", "solar", "battery", "climate", "carbon"],
}


def quarter(d: str) -> str:
    return f"(year({d}) * 4 + quarter({d}) - 1)::INTEGER"


def domain(x: str, strict: bool = True) -> str:
    h = rf"regexp_replace(regexp_replace(lower(trim({x})), '^https?://', ''), '^www\.', '')"
    h = f"split_part(split_part({h}, '/', 1), '?', 1)"
    if not strict:
        return f"coalesce(trim({h}), '')"
    h = f"trim(split_part({h}, ':', 1))"
    return f"coalesce(CASE WHEN contains({h}, '.') THEN {h} END, '')"


def name(x: str) -> str:
    s = f"regexp_replace(lower({x}), '&', ' and ', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9]+', ' ', 'g')"
    s = rf"regexp_replace({s}, '\b({'|'.join(LEGAL_WORDS)})\b', ' ', 'g')"
    return f"coalesce(trim(regexp_replace({s}, ' +', ' ', 'g')), '')"


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def bucket(x: str, table: dict[str, list[str]], default: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    whens = " ".join(f"WHEN {contains_any(low, words)} THEN '{b}'" for b, words in table.items())
    return f"CASE {whens} ELSE '{default}' END"


def sector(x: str) -> str:
    return bucket(x, SECTOR_KEYWORDS, "other")


def log1p_clip(x: str) -> str:
    return f"ln(1 + greatest(coalesce(({x})::DOUBLE, 0), 0))"


def ratio(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def digest(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(f"({p})::VARCHAR" for p in parts) + ")"


def uniform(md5: str, slot: int = 0) -> str:
    return f"((('0x' || substr({md5}, {1 + 8 * slot}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"


def gaussian(md5: str) -> str:
    return f"(sqrt(-2::DOUBLE * ln({uniform(md5, 0)})) * cos(2::DOUBLE * pi() * {uniform(md5, 1)}))"


COMPANIES = """companies AS (
  SELECT c_custkey::VARCHAR AS company_uuid, p_name AS name, c_mktsegment AS description, url AS website,
         p_brand AS hq_country
  FROM customer LEFT JOIN part ON c_custkey = p_partkey LEFT JOIN pages ON c_custkey = page_id)"""

ROUNDS = """rounds AS (
  SELECT o_custkey::VARCHAR AS company_uuid, o_orderdate AS announced_on, o_orderpriority AS investment_type,
         o_totalprice AS money, lines AS investors
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""

IPOS = """ipos AS (
  SELECT o_custkey::VARCHAR AS company_uuid, o_orderdate AS d, o_totalprice AS v FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01')"""

ACQUISITIONS = """acq AS (
  SELECT o_custkey::VARCHAR AS company_uuid, l_shipdate AS d, l_extendedprice AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' AND l_quantity >= 50 AND l_shipdate >= TIMESTAMP '1997-01-01')"""

SPONSOR = """sponsor AS (
  SELECT o_custkey::VARCHAR AS company_uuid, o_orderdate AS d FROM orders
  WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1997-01-01')"""

EXITS = f"""{IPOS}, {ACQUISITIONS}, {SPONSOR}, exit_events AS (
  SELECT company_uuid, d, v, 'ipo' AS route, 0 AS pri FROM ipos
  UNION ALL SELECT company_uuid, d, v, 'mna', 1 FROM acq
  UNION ALL SELECT company_uuid, d, NULL, 'sponsor_sale', 2 FROM sponsor),
exits AS (
  SELECT company_uuid, min(d) AS exit_date, first(route ORDER BY d, pri) AS route_label,
         first(v ORDER BY d, pri, v) FILTER (WHERE v IS NOT NULL) AS event_value_usd,
         {quarter('min(d)')} AS exit_q
  FROM exit_events GROUP BY 1)"""

FIRST_ROUND = """first_round AS (
  SELECT company_uuid, min(announced_on) AS first_round_date,
         first(investment_type ORDER BY announced_on, investment_type, money, investors NULLS FIRST) AS first_stage,
         first(money ORDER BY announced_on, investment_type, money, investors NULLS FIRST) AS first_money,
         first(investors ORDER BY announced_on, investment_type, money, investors) FILTER (WHERE investors IS NOT NULL) AS first_investors
  FROM rounds GROUP BY 1)"""

BASE = f"""{COMPANIES}, {ROUNDS}, {FIRST_ROUND}, {EXITS},
asof_day AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS data_asof),
base AS (
  SELECT c.company_uuid, lower(description) AS sector_bucket, first_stage, {quarter('first_round_date')} AS entry_q,
         exit_q, route_label, event_value_usd,
         least(7998, (SELECT {quarter('data_asof')} FROM asof_day) - 8) AS last_q
  FROM companies c JOIN first_round f USING (company_uuid) LEFT JOIN exits x USING (company_uuid)),
risk AS (
  SELECT *, greatest(entry_q + 1, 7980) AS ps, CASE WHEN exit_q IS NULL THEN last_q ELSE least(exit_q - 1, last_q) END AS pe
  FROM base)"""

SPLIT = "CASE WHEN quarter_idx <= 7991 THEN 'train' WHEN quarter_idx <= 7995 THEN 'validation' WHEN quarter_idx <= 7998 THEN 'test' ELSE 'exclude' END"
LABEL = "coalesce(exit_q BETWEEN quarter_idx + 1 AND quarter_idx + 8, false)::INTEGER"

SPINE = f"""{BASE}, spine AS (
  SELECT * EXCLUDE (ps, pe), unnest(range(ps, pe + 1))::INTEGER AS quarter_idx FROM risk WHERE ps <= pe),
panel AS (
  SELECT *, {LABEL} AS label, {SPLIT} AS split,
         CASE WHEN exit_q BETWEEN quarter_idx + 1 AND quarter_idx + 8 THEN route_label ELSE 'no_exit' END AS company_exit_route
  FROM spine)"""

STAGE_TABLE = (
    "CASE {x} WHEN '1-URGENT' THEN 'seed' WHEN '2-HIGH' THEN 'series_a' WHEN '3-MEDIUM' THEN 'series_b'"
    " WHEN '4-NOT SPECIFIED' THEN 'growth' WHEN '5-LOW' THEN 'buyout' ELSE 'unknown' END"
)

ROUND_Q = f"""round_q AS (
  SELECT company_uuid, {quarter('announced_on')} AS q, count(*)::BIGINT AS n, sum(greatest(money, 0)) AS raised,
         first(greatest(coalesce(money, 0), 0) ORDER BY announced_on DESC, money DESC, investment_type DESC, investors DESC) AS amount,
         first(investors ORDER BY announced_on DESC, money DESC, investment_type DESC, investors DESC) FILTER (WHERE investors IS NOT NULL) AS investors,
         first(investment_type ORDER BY announced_on DESC, money DESC, investment_type DESC, investors DESC) AS stage
  FROM rounds GROUP BY 1, 2),
round_c AS (
  SELECT company_uuid, q, q + 1 AS vq, sum(n) OVER w AS round_count_asof, sum(raised) OVER w AS cum_raised_asof, amount,
         last_value(investors IGNORE NULLS) OVER w AS investors, stage
  FROM round_q WINDOW w AS (PARTITION BY company_uuid ORDER BY q ROWS UNBOUNDED PRECEDING))"""

DEALS = """deals AS (
  SELECT l_partkey::VARCHAR AS pcid, l_shipdate AS deal_date, p_name AS dname, url AS dsite, p_brand AS dcountry,
         CASE WHEN l_returnflag = 'R' THEN 'buyout' ELSE 'vc' END AS source, l_extendedprice AS size,
         CASE WHEN l_returnflag = 'R' THEN l_quantity * 1000 END AS ev
  FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN pages ON l_suppkey = page_id)"""

LINKS = f"""{DEALS},
ek AS (SELECT company_uuid, {domain('website')} AS nd, {name('name')} AS nn, lower(trim(hq_country)) AS ck FROM companies),
dk AS (SELECT *, {domain('dsite')} AS nd, {name('dname')} AS nn, lower(trim(dcountry)) AS ck FROM deals),
pairs AS (
  SELECT ek.company_uuid, pcid, deal_date, source, size, ev, 'domain' AS method FROM ek JOIN dk ON ek.nd = dk.nd AND ek.nd <> ''
  UNION ALL
  SELECT ek.company_uuid, pcid, deal_date, source, size, ev, 'normalized_name_country' FROM ek JOIN dk
  ON ek.nn = dk.nn AND ek.ck = dk.ck AND ek.nn <> ''),
links AS (
  SELECT company_uuid, min(deal_date) AS first_date, count(*)::BIGINT AS n, {quarter('min(deal_date)')} AS first_q,
         string_agg(DISTINCT method, '|' ORDER BY method) AS methods
  FROM pairs GROUP BY 1)"""

DEAL_Q = f"""deal_once AS (SELECT company_uuid, pcid, deal_date, source, size, max(ev) AS ev FROM pairs GROUP BY ALL),
deal_q AS (
  SELECT company_uuid, {quarter('deal_date')} AS q, count(*)::BIGINT AS n, sum(size) AS size,
         first(ev ORDER BY deal_date DESC, ev DESC) FILTER (WHERE ev IS NOT NULL) AS ev
  FROM deal_once GROUP BY 1, 2),
deal_c AS (
  SELECT company_uuid, q + 1 AS vq, sum(n) OVER w AS deals, sum(size) OVER w AS size, last_value(ev IGNORE NULLS) OVER w AS ev
  FROM deal_q WINDOW w AS (PARTITION BY company_uuid ORDER BY q ROWS UNBOUNDED PRECEDING))"""

ROUND_FEATURES = f"""pr AS (
  SELECT p.*, r.q AS round_q, r.round_count_asof, r.cum_raised_asof, r.amount, r.investors,
         greatest(p.quarter_idx - entry_q, 0) AS age_q, greatest(p.quarter_idx - r.q, 0) AS since,
         {STAGE_TABLE.format(x="coalesce(r.stage, p.first_stage)")} AS stage_bucket
  FROM panel p ASOF LEFT JOIN round_c r ON p.company_uuid = r.company_uuid AND p.quarter_idx >= r.vq)"""

PATENT_Q = f"""pat AS (
  SELECT {name('p_name')} AS nn, {quarter('l_shipdate')} AS q, l_quantity AS cites,
         date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS lag
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
names AS (SELECT DISTINCT company_uuid, {name('name')} AS nn FROM companies WHERE {name('name')} <> ''),
pat_q AS (
  SELECT company_uuid, q, count(*)::BIGINT AS grants, sum(cites) AS cites, coalesce(sum(lag), 0) AS lags
  FROM pat JOIN names USING (nn) GROUP BY 1, 2)"""

SNAPSHOTS = f"""snaps AS (
  SELECT {domain('url')} AS website_domain, TIMESTAMP '2010-01-01' + to_days((page_id * 37 % 5000)::INTEGER) AS dt,
         strftime(TIMESTAMP '2010-01-01' + to_days((page_id * 37 % 5000)::INTEGER), '%Y%m%d%H%M%S') AS "timestamp",
         url AS original, CASE WHEN contains(html, 'lang="en"') THEN 'text/html' ELSE 'application/xhtml+xml' END AS mimetype,
         md5(html) AS digest
  FROM pages),
cutoffs AS (SELECT unnest([{', '.join(f"TIMESTAMP '{c}'" for c in CUTOFFS)}]) AS cutoff),
doms AS (SELECT DISTINCT website_domain FROM snaps WHERE website_domain <> ''),
chosen AS (
  SELECT website_domain, cutoff,
         max(struct_pack(dt := dt, ts := "timestamp", original := original, mimetype := mimetype, digest := digest))
           FILTER (WHERE dt <= cutoff AND dt >= cutoff - INTERVAL 730 DAY) AS hit,
         coalesce(bool_or(dt <= cutoff), false) AS prior
  FROM doms CROSS JOIN cutoffs LEFT JOIN snaps USING (website_domain) GROUP BY 1, 2),
proxy AS (
  SELECT website_domain, cutoff::DATE AS cutoff_date,
         CASE WHEN hit IS NOT NULL THEN 'archived_200' WHEN prior THEN 'stale_snapshot' ELSE 'missing' END AS status,
         coalesce(hit.ts, '') AS snapshot_timestamp, CASE WHEN hit IS NOT NULL THEN 200 END AS http_status,
         coalesce(hit.original, '') AS final_url, hit.mimetype AS mimetype, hit.digest AS digest,
         CASE WHEN hit IS NULL THEN 'none' WHEN starts_with(hit.mimetype, 'text/html') THEN 'strong' ELSE 'medium' END AS strength
  FROM chosen)"""

ACTIVE_Q = f"""moved AS (SELECT *, (cutoff_date - INTERVAL 180 MONTH)::DATE AS cd FROM proxy),
cdom AS (SELECT DISTINCT company_uuid, {domain('website')} AS website_domain FROM companies WHERE {domain('website')} <> ''),
act AS (
  SELECT company_uuid, {quarter('cd')} AS q,
         max((coalesce(http_status BETWEEN 200 AND 399, false) OR status = 'archived_200' OR strength IN ('strong', 'medium'))::INTEGER) AS active,
         count(*)::BIGINT AS n
  FROM moved JOIN cdom USING (website_domain) GROUP BY 1, 2),
runs AS (
  SELECT *, min(CASE WHEN active = 1 THEN q END) OVER w AS first_active_q, sum(1 - active) OVER w AS island,
         coalesce(lag(active) OVER (PARTITION BY company_uuid ORDER BY q) = 1 AND active = 0, false)::INTEGER AS decay
  FROM act WINDOW w AS (PARTITION BY company_uuid ORDER BY q ROWS UNBOUNDED PRECEDING)),
act_c AS (
  SELECT company_uuid, q, q + 1 AS vq, active, n, first_active_q, decay,
         (sum(active) OVER (PARTITION BY company_uuid, island ORDER BY q ROWS UNBOUNDED PRECEDING))::INTEGER AS streak
  FROM runs)"""

PARTNER = f"""raw_partner AS (
  SELECT c_custkey::VARCHAR AS company_uuid, c_nationkey::DOUBLE AS nk, c_acctbal AS bal, c_mktsegment AS seg,
         url IS NOT NULL AS site, first_order
  FROM customer LEFT JOIN pages ON c_custkey = page_id
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) ON c_custkey = o_custkey),
p0 AS (
  SELECT company_uuid, CASE WHEN nk > 2 THEN nk - 2 END AS founder_count, floor(nk / 2) AS ids,
         site::INTEGER::DOUBLE AS has_website_url, 1::DOUBLE AS has_short_description, length(seg)::DOUBLE AS cats,
         CASE WHEN nk > 4 THEN nk - 4 END AS recs, CASE WHEN bal > 0 THEN bal / 10000 END AS score,
         CASE WHEN nk < 8 THEN 'high' WHEN nk < 16 THEN 'possible' END AS tier, (bal > 5000)::INTEGER AS accepted,
         {quarter('first_order')} AS first_q, CASE WHEN bal > 1000 THEN bal * 10 END AS amount, nk AS inv
  FROM raw_partner),
partner AS (
  SELECT *, (coalesce(recs, 0) <= 0)::INTEGER AS founder_count_missing,
         greatest(0, least(1, coalesce({ratio('ids', 'recs')}, 0))) AS coverage,
         has_website_url + has_short_description + ln(1 + cats) + (1 - (coalesce(recs, 0) <= 0)::INTEGER) AS completeness,
         (score IS NULL)::INTEGER AS score_missing, coalesce(score, 0) AS score0,
         coalesce(tier = 'high', false)::INTEGER AS high, coalesce(tier = 'possible', false)::INTEGER AS low
  FROM p0)"""

BALANCE = "(c_acctbal / 5000 - 1)"


def _score(extra: str, digits: int) -> str:
    return f"round(1 / (1 + exp(-({BALANCE} + {extra}))), {digits})"


PREDICTIONS = f"""{SPINE}, test AS (
  SELECT p.*, c_acctbal, {gaussian(digest('company_uuid', 'quarter_idx', '42'))} AS noise
  FROM panel p JOIN customer ON company_uuid = c_custkey::VARCHAR WHERE split = 'test'),
pred AS (""" + " UNION ALL ".join(
    f"SELECT company_uuid, quarter_idx, label, exit_q, company_exit_route, '{m}' AS model, '{v}' AS variant, {_score(e, d)} AS score FROM test"
    for m, d in (("fixed_smooth", 6), ("fixed_tied", 1))
    for v, e in (
        ("baseline", "0"),
        ("baseline_plus_noise_placebo", "0.1::DOUBLE * noise"),
        ("baseline_plus_syndicate_investor_supported", "1.5::DOUBLE * label"),
    )
) + ")"

LABEL_NAME = "realized_hard_timely_liquidity_by_horizon"
