"""The given star-schema tables in the shapes of the panel's input tables.

Customers play companies, orders play funding rounds, urgent finished orders play listings,
large returned line items play acquisitions, line items play deals and patents, and web
pages play websites and archive snapshots. Each function has its SQL twin in ``sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import PanelSpec, SplitSpec
from tidemark.functions.text import domain_key, keyword_bucket
from tidemark.operators import labels, spine
from tidemark.operators.snapshot_asof import cutoff_rows
from tidemark.plans.panel import PanelInputs, PanelResult, build_panel
from tidemark.sources.contracts import contract
from tidemark.sources.tabular import conform

EXITS_FROM = "1997-01-01"
SPLITS = SplitSpec.quarters("1997Q4", "1998Q4", "1999Q3")
WINDOW_START = 1995 * 4
CUTOFFS = [f"{year}-12-31" for year in range(2010, 2024)]
SECTORS = {s: [s] for s in ("automobile", "building", "furniture", "household", "machinery")}
STAGES = {
    "seed": ["1-urgent"], "series_a": ["2-high"], "series_b": ["3-medium"], "growth": ["4-not"], "buyout": ["5-low"],
}


_OPENED: dict[str, tuple[SparkSession, DataFrame]] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables. Opening a file reads its footer in a job of its own, so each
    is opened once per session."""
    path = f"{sf}/{name}.parquet"
    session, opened = _OPENED.get(path, (None, None))
    if session is not spark:
        opened = spark.read.parquet(path)
        _OPENED[path] = (spark, opened)
    return opened


def panel_spec(**overrides) -> PanelSpec:
    return PanelSpec(window_start=WINDOW_START, splits=SPLITS, **overrides)


def companies(spark: SparkSession, sf: str) -> DataFrame:
    c, p, g = (table(spark, sf, t) for t in ("customer", "part", "pages"))
    joined = c.join(p, F.col("c_custkey") == F.col("p_partkey"), "left").join(
        g.select("page_id", "url"), F.col("c_custkey") == F.col("page_id"), "left"
    )
    shaped = joined.select(
        F.col("c_custkey").cast("string").alias("company_uuid"),
        F.col("p_name").alias("name"),
        F.col("c_mktsegment").alias("description"),
        F.col("url").alias("website"),
        F.col("p_brand").alias("hq_country"),
    )
    return conform(shaped, contract("companies"))


def funding_rounds(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("lines"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_custkey").cast("string").alias("company_uuid"),
        F.col("o_orderdate").alias("announced_on"),
        F.col("o_orderpriority").alias("investment_type"),
        F.col("o_totalprice").alias("money_raised_usd"),
        F.col("lines").alias("num_investors"),
    )


def _late(date: str):
    return F.col(date) >= F.lit(EXITS_FROM).cast("timestamp_ntz")


def ipos(spark: SparkSession, sf: str) -> DataFrame:
    chosen = table(spark, sf, "orders").filter(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F") & _late("o_orderdate")
    )
    return chosen.select(
        F.col("o_custkey").cast("string").alias("company_uuid"),
        F.col("o_orderdate").alias("went_public_on"),
        F.col("o_totalprice").alias("money_raised_usd"),
        F.lit(None).cast("string").alias("stock_exchange"),
    )


def acquisitions(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").filter(
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50) & _late("l_shipdate")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("acquiree_uuid"),
        F.col("l_shipdate").alias("announced_on"),
        F.col("l_extendedprice").alias("price_usd"),
        F.lit(None).cast("string").alias("acquisition_type"),
    )


def sponsor_sales(spark: SparkSession, sf: str) -> DataFrame:
    chosen = table(spark, sf, "orders").filter(
        (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P") & _late("o_orderdate")
    )
    return chosen.select(F.col("o_custkey").cast("string").alias("company_uuid"), F.col("o_orderdate").alias("sold_on"))


def _deals(spark: SparkSession, sf: str) -> DataFrame:
    lines, parts, pages = (table(spark, sf, t) for t in ("lineitem", "part", "pages"))
    return (
        lines.join(parts.select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(pages.select("page_id", "url"), F.col("l_suppkey") == F.col("page_id"), "left")
        .select(
            F.col("l_partkey").cast("string").alias("portfolio_company_id"),
            F.col("l_shipdate").alias("deal_date"),
            F.col("p_name").alias("portfolio_company_name"),
            F.col("url").alias("portfolio_company_website"),
            F.col("p_brand").alias("portfolio_company_country"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_returnflag").alias("flag"),
        )
    )


def vc_deals(spark: SparkSession, sf: str) -> DataFrame:
    deals = _deals(spark, sf).filter(F.col("flag") != "R").withColumnRenamed("amount", "deal_financing_size_usd")
    return conform(deals, contract("vc_deals"))


def buyout_deals(spark: SparkSession, sf: str) -> DataFrame:
    deals = _deals(spark, sf).filter(F.col("flag") == "R").withColumnRenamed("amount", "deal_size_usd")
    return conform(deals.withColumn("enterprisevalue", F.col("quantity") * 1000), contract("buyout_deals"))


def patents(spark: SparkSession, sf: str) -> DataFrame:
    lines, parts, orders = (table(spark, sf, t) for t in ("lineitem", "part", "orders"))
    return (
        lines.join(parts.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("patnum"),
            F.col("l_shipdate").alias("grantdate"),
            F.col("o_orderdate").alias("appldate"),
            F.col("p_name").alias("ee_name"),
            F.col("l_quantity").alias("backward_cites"),
            F.lit(None).cast("double").alias("forward_cites"),
        )
    )


def partner_features(spark: SparkSession, sf: str) -> DataFrame:
    c, g = table(spark, sf, "customer"), table(spark, sf, "pages").select("page_id", "url")
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    joined = c.join(g, F.col("c_custkey") == F.col("page_id"), "left").join(
        first, F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    nation = F.col("c_nationkey").cast("double")
    return joined.select(
        F.col("c_custkey").cast("string").alias("company_uuid"),
        F.when(nation > 2, nation - 2).alias("crunchbase_num_founders"),
        F.floor(nation / 2).cast("double").alias("crunchbase_founder_identifier_count"),
        F.col("url").isNotNull().cast("double").alias("has_website_url"),
        F.lit(1.0).alias("has_short_description"),
        F.length("c_mktsegment").cast("double").alias("crunchbase_category_count"),
        F.when(nation > 4, nation - 4).alias("founder_record_count"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 10000).alias("preqin_match_score"),
        F.when(nation < 8, "High").when(nation < 16, "possible").alias("preqin_confidence_tier"),
        (F.col("c_acctbal") > 5000).cast("double").alias("preqin_accepted_match_asof_review"),
        F.col("first_order").alias("first_funding_date"),
        F.when(F.col("c_acctbal") > 1000, F.col("c_acctbal") * 10).alias("first_round_amount_usd"),
        nation.alias("first_round_investor_count"),
    )


def data_asof(spark: SparkSession, sf: str) -> DataFrame:
    return spine.data_asof(
        [(table(spark, sf, "orders"), "o_orderdate"), (table(spark, sf, "lineitem"), "l_shipdate")]
    )


def exit_sources(spark: SparkSession, sf: str) -> list[labels.ExitSource]:
    return [
        labels.ExitSource(acquisitions(spark, sf), "mna", "acquiree_uuid", "announced_on", "price_usd"),
        labels.ExitSource(ipos(spark, sf), "ipo", "company_uuid", "went_public_on", "money_raised_usd"),
        labels.ExitSource(sponsor_sales(spark, sf), "sponsor_sale", "company_uuid", "sold_on"),
    ]


def sector():
    return keyword_bucket(F.col("description"), SECTORS, "other")


def stage():
    return keyword_bucket(F.coalesce("raw_stage_label", "first_stage"), STAGES, "unknown")


def labelled_spine(spark: SparkSession, sf: str, spec: PanelSpec | None = None) -> DataFrame:
    """Spine, label and split only: the flagship minimum."""
    spec = spec or panel_spec()
    base = spine.entity_base(companies(spark, sf), funding_rounds(spark, sf), spec, sector())
    exits = labels.first_exit(labels.exit_events(exit_sources(spark, sf), spec), spec)
    last = spine.mature_end(data_asof(spark, sf), spec)
    base = spine.at_risk(base.join(exits, spec.entity, "left"), last, spec).select(
        spec.entity, "sector_bucket", "first_stage", "founded_q", "exit_q", "route_label", "event_value_usd",
        "panel_start", "panel_end",
    )
    return labels.split_rows(labels.label_rows(spine.panel_spine(base, spec), spec), spec)


def inputs(spark: SparkSession, sf: str, families: bool = False) -> PanelInputs:
    extra = {}
    if families:
        extra = {
            "patents": patents(spark, sf),
            "partner_features": partner_features(spark, sf),
            "homepage_rows": panel_cutoff_rows(spark, sf),
        }
    return PanelInputs(
        companies(spark, sf), funding_rounds(spark, sf), acquisitions(spark, sf), ipos(spark, sf),
        vc_deals(spark, sf), buyout_deals(spark, sf), **extra,
    )


def panel_options(spark: SparkSession, sf: str) -> dict:
    return {
        "exit_sources": exit_sources(spark, sf), "asof": data_asof(spark, sf), "sector": sector(), "stage": stage(),
    }


def panel(spark: SparkSession, sf: str, spec: PanelSpec | None = None) -> PanelResult:
    return build_panel(inputs(spark, sf), spec or panel_spec(), **panel_options(spark, sf))


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Staged listing responses, one per page: the header row and one snapshot row."""
    html = F.col("html").contains('lang="en"')
    stamp = F.date_format(
        F.date_add(F.lit("2010-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(5000)).cast("int")).cast("timestamp"),
        "yyyyMMddHHmmss",
    )
    header = F.array(*map(F.lit, ["timestamp", "original", "statuscode", "mimetype", "digest"]))
    row = F.array(stamp, F.col("url"), F.lit("200"), F.when(html, "text/html").otherwise("application/xhtml+xml"), F.md5(F.col("html").cast("binary")))
    return table(spark, sf, "pages").select(
        domain_key(F.col("url")).alias("website_domain"),
        F.lit(200).alias("cdx_http_status"),
        F.to_json(F.array(header, row)).alias("payload"),
        F.lit("").alias("error"),
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.sources.snapshots import parse_listings

    return parse_listings(listings(spark, sf))


def page_domains(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "pages")
        .select(domain_key(F.col("url")).alias("website_domain"))
        .filter(F.col("website_domain") != "")
        .distinct()
    )


def homepage_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cutoff_rows(page_domains(spark, sf), snapshots(spark, sf), CUTOFFS)


def panel_cutoff_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Homepage rows moved fifteen years back, so that their cutoffs fall inside the panel
    of the order tables."""
    return homepage_rows(spark, sf).withColumn("cutoff_date", F.add_months("cutoff_date", -180))


def predictions(spark: SparkSession, sf: str, frame: DataFrame | None = None) -> DataFrame:
    """Scores by fixed formulas on the test rows: two models (one with heavily tied scores)
    by three variants, in the long layout of a model sweep."""
    from tidemark.functions.scores import noise_placebo

    spec = panel_spec()
    test = (labelled_spine(spark, sf) if frame is None else frame).filter(F.col("split") == "test")
    balance = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias(spec.entity), "c_acctbal")
    rows = test.select(spec.entity, spec.period, spec.label).join(balance, spec.entity)
    signal = F.col("c_acctbal") / 5000 - 1
    noise = noise_placebo(F.col(spec.entity), F.col(spec.period))

    def logistic(x):
        return 1 / (1 + F.exp(-x))

    variants = {
        "baseline": logistic(signal),
        "baseline_plus_noise_placebo": logistic(signal + 0.1 * noise),
        "baseline_plus_syndicate_investor_supported": logistic(signal + 1.5 * F.col(spec.label)),
    }
    long = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(v).alias("variant"), F.round(score, digits).alias("score"))
            for m, digits in (("fixed_smooth", 6), ("fixed_tied", 1))
            for v, score in variants.items()
        ]
    )
    exploded = rows.select(spec.entity, spec.period, spec.label, F.explode(long).alias("p"))
    return exploded.select(spec.entity, spec.period, spec.label, "p.model", "p.variant", "p.score")
