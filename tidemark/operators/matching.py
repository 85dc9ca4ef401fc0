"""Linking two entity tables by domain and by name and country.

The link is many-to-many: a shared hosting domain or a common name ties every entity that
has it to every deal that has it. Listing those pairs grows with the product of the two
groups, so nothing downstream reads the list. Deals are summed up per match key first, and
the sums are joined to entities, which keeps the work linear in both tables. A deal found
by both keys is counted once by subtracting what the two keys have in common.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nulls import to_number
from tidemark.functions.periods import period_index
from tidemark.functions.text import country_key, domain_key, name_key
from tidemark.operators.ordered import last_known, order_key, require_keys
from tidemark.operators.skew import ENTITIES_PER_SORT, fan_join, fan_parts, spread_join

DEAL_COLUMNS = [
    "portfolio_company_id", "portfolio_company_name", "portfolio_company_website",
    "portfolio_company_country", "deal_date",
]
NAME_KEY = ["norm_name", "country_key"]
DOMAIN_KEY = ["norm_domain"]
FULL_KEY = [*DOMAIN_KEY, *NAME_KEY]
# Two deals that agree in all of these are one deal.
DEAL_IDENTITY = ["portfolio_company_id", "deal_date", "preqin_deal_source", "preqin_deal_size_usd"]


def unified_deals(vc_deals: DataFrame, buyout_deals: DataFrame) -> DataFrame:
    """Venture and buyout deals in one shape, tagged by source. Only buyouts state an
    enterprise value."""
    vc = vc_deals.select(
        *DEAL_COLUMNS,
        F.lit("vc").alias("preqin_deal_source"),
        to_number(F.col("deal_financing_size_usd")).alias("preqin_deal_size_usd"),
        F.lit(None).cast("double").alias("enterprisevalue"),
    )
    buyout = buyout_deals.select(
        *DEAL_COLUMNS,
        F.lit("buyout").alias("preqin_deal_source"),
        to_number(F.col("deal_size_usd")).alias("preqin_deal_size_usd"),
        to_number(F.col("enterprisevalue")).alias("enterprisevalue"),
    )
    return vc.unionByName(buyout)


def _keys(df: DataFrame, website: str, name: str, country: str, missing_country: bool, strict: bool) -> DataFrame:
    return df.withColumns(
        {
            "norm_domain": domain_key(F.col(website), strict),
            "norm_name": name_key(F.col(name)),
            "country_key": country_key(F.col(country), missing_country),
        }
    )


def deal_keys(deals: DataFrame, match_missing_country: bool = False, strict: bool = True) -> DataFrame:
    return _keys(
        deals, "portfolio_company_website", "portfolio_company_name", "portfolio_company_country",
        match_missing_country, strict,
    )


def entity_keys(
    companies: DataFrame, entity: str = "company_uuid", match_missing_country: bool = False, strict: bool = True
) -> DataFrame:
    slim = companies.select(entity, "name", "website", "hq_country").na.drop(subset=[entity])
    return _keys(slim, "website", "name", "hq_country", match_missing_country, strict)


def usable(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose match key is neither blank nor missing."""
    keep: Column = F.lit(True)
    for key in keys:
        keep = keep & F.col(key).isNotNull()
        if key != "country_key":
            keep = keep & (F.col(key) != "")
    return df.filter(keep)


def deal_ledger(deals: DataFrame, unit: str = "quarter") -> DataFrame:
    """Identified deals with copies collapsed to a count: one row per match keys and deal
    identity. Copies are combined on the map side, so a deal that fills a third of the table
    is one row from here on. Written once, it serves every sum over deals."""
    identified = require_keys(deals, "portfolio_company_id").withColumns(
        {
            "preqin_deal_size_usd": F.coalesce("preqin_deal_size_usd", F.lit(0.0)),
            "fact_period": period_index(F.col("deal_date"), unit),
        }
    )
    return identified.groupBy(*FULL_KEY, *DEAL_IDENTITY, "fact_period").agg(
        F.count(F.lit(1)).alias("copies"), F.max("enterprisevalue").alias("enterprisevalue")
    )


def listed_twice(ledger: DataFrame) -> DataFrame:
    """Deal identities that stand in the ledger under more than one set of keys: usually
    none or few. Their deals need care not to be counted once per listing."""
    counted = ledger.groupBy(*DEAL_IDENTITY).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col("_n") > 1).select(*DEAL_IDENTITY)


def fan_out(entities: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Entities, deals and the number of pairs that each shared key stands for."""
    e = usable(entities, keys).select(*keys, F.lit(1).cast("long").alias("e"), F.lit(0).cast("long").alias("d"))
    d = usable(ledger, keys).select(*keys, F.lit(0).cast("long").alias("e"), F.col("copies").alias("d"))
    counted = e.unionByName(d).groupBy(*keys).agg(F.sum("e").alias("entities"), F.sum("d").alias("deals"))
    return counted.filter((F.col("entities") > 0) & (F.col("deals") > 0)).withColumn(
        "pairs", F.col("entities") * F.col("deals")
    )


def link_summary(entities: DataFrame, ledger: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Deals each entity reaches through one kind of key: how many, and the earliest.
    The same rows as grouping the pair list by entity, without building it."""
    totals = usable(ledger, keys).groupBy(*keys).agg(
        F.sum("copies").alias("n_deals"),
        F.min("deal_date").alias("first_date"),
        F.min(F.when(F.col("preqin_deal_source") == "buyout", F.col("deal_date"))).alias("first_buyout"),
    )
    left = usable(entities, keys).select(entity, *keys)
    return spread_join(left, totals, keys, [entity])


def crosswalk_first(entities: DataFrame, ledger: DataFrame, entity: str = "company_uuid", unit: str = "quarter") -> DataFrame:
    """Per linked entity: first deal date, number of links and the methods that found them.
    A deal found both ways counts twice and undated deals count too."""
    found = [
        link_summary(entities, ledger, keys, entity).select(
            entity, "n_deals", "first_date", "first_buyout", F.lit(flag).alias("by_domain")
        )
        for keys, flag in ((DOMAIN_KEY, 1), (NAME_KEY, 0))
    ]
    methods = F.concat_ws(
        "|",
        F.when(F.max("by_domain") == 1, "domain"),
        F.when(F.min("by_domain") == 0, "normalized_name_country"),
    )
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy(entity)
        .agg(
            F.min("first_date").alias("first_preqin_deal_date"),
            F.sum("n_deals").alias("preqin_deal_count_total"),
            methods.alias("match_methods"),
            F.min("first_buyout").alias("first_buyout_date"),
        )
        .withColumn("first_preqin_deal_q", period_index(F.col("first_preqin_deal_date"), unit))
    )


def _per_key_period(deals: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """Deals per match key and period, as signed counts and sums."""
    newest = order_key("deal_date", "enterprisevalue")
    return usable(deals, keys).groupBy(*keys, "fact_period").agg(
        (F.count(F.lit(1)) * sign).alias("deals"),
        (F.sum("preqin_deal_size_usd") * sign).alias("size"),
        F.max(F.when(F.col("enterprisevalue").isNotNull(), newest)).alias("newest_value"),
    )


def deals_by_period(
    entities: DataFrame, ledger: DataFrame, entity: str = "company_uuid", repeated: DataFrame | None = None
) -> DataFrame:
    """Matched deals per (entity, period), each deal once however it was found:
    deals by domain + deals by name and country - deals that both keys of the entity reach.

    A deal listed under one set of keys is a single ledger row and is summed as it stands.
    Deals in ``repeated`` (see :func:`listed_twice`) are first reduced to one row per key.
    Entities are counted at once, as each stands for a row per period.
    """
    dated = ledger.filter(F.col("fact_period").isNotNull())
    repeated = listed_twice(ledger) if repeated is None else repeated
    plain = dated.join(repeated, DEAL_IDENTITY, "left_anti")
    several = dated.join(repeated, DEAL_IDENTITY, "left_semi")
    both = usable(entities, FULL_KEY).select(entity, *FULL_KEY).distinct()
    n, parts = entities.count(), []
    for keys in (DOMAIN_KEY, NAME_KEY):
        left = usable(entities, keys).select(entity, *keys).distinct()
        once = several.groupBy(*keys, *DEAL_IDENTITY, "fact_period").agg(F.max("enterprisevalue").alias("enterprisevalue"))
        sums = _per_key_period(plain, keys, 1).unionByName(_per_key_period(once, keys, 1))
        parts.append(fan_join(left, sums, keys, [entity], n))
    shared = _per_key_period(plain, FULL_KEY, -1).unionByName(
        _per_key_period(_reached_by_all_keys(several, both), FULL_KEY, -1)
    )
    parts.append(fan_join(both, shared, FULL_KEY, [entity], n))
    rows = [p.select(entity, "fact_period", "deals", "size", "newest_value") for p in parts]
    # Entities of one name have equal rows, which travel small: tasks go by entities, not bytes.
    return (
        reduce(DataFrame.unionByName, rows)
        .repartition(fan_parts(entities, n, ENTITIES_PER_SORT), entity, "fact_period")
        .groupBy(entity, "fact_period")
        .agg(
            F.sum("deals").alias("preqin_deals_in_q"),
            F.sum("size").alias("preqin_deal_size_in_q"),
            F.max("newest_value")["enterprisevalue"].alias("buyout_enterprise_value_latest_q"),
        )
    )


def _reached_by_all_keys(several: DataFrame, both: DataFrame) -> DataFrame:
    """Distinct (deal identity, domain, name, country) where a deal listed several times
    carries the domain on some row and the name and country on some row, for domains and
    names that entities use."""
    identity = [*DEAL_IDENTITY, "fact_period"]
    domains = several.join(both.select(*DOMAIN_KEY).distinct(), DOMAIN_KEY, "left_semi")
    names = several.join(both.select(*NAME_KEY).distinct(), NAME_KEY, "left_semi")
    recombined = domains.select(*identity, *DOMAIN_KEY).distinct().join(
        names.select(*identity, *NAME_KEY).distinct(), identity
    )
    return recombined.withColumn("enterprisevalue", F.lit(None).cast("double"))


def domain_entities(companies: DataFrame, entity: str, strict: bool = True) -> DataFrame:
    """Distinct (entity, domain) pairs with a usable domain."""
    return (
        companies.select(entity, domain_key(F.col("website"), strict).alias("website_domain"))
        .filter(F.col("website_domain") != "")
        .distinct()
    )


def name_entities(companies: DataFrame, entity: str) -> DataFrame:
    """Distinct (entity, name key) pairs with a usable name."""
    return (
        companies.select(entity, name_key(F.col("name")).alias("norm_name"))
        .filter(F.col("norm_name") != "")
        .distinct()
    )


def patents_by_period(companies: DataFrame, patents: DataFrame, entity: str, unit: str = "quarter") -> DataFrame:
    """Granted patents per (entity, period) by assignee name. One patent counts for every
    entity of that name; patents are summed per name before the join. An unknown lag adds
    nothing to the sum but its patent is still counted (``stated_lags`` counts the rest)."""
    per_name = (
        patents.select(
            name_key(F.col("ee_name")).alias("norm_name"),
            period_index(F.col("grantdate"), unit).alias("fact_period"),
            F.coalesce(to_number(F.col("backward_cites")), F.lit(0.0)).alias("cites"),
            F.datediff("grantdate", "appldate").cast("double").alias("lag"),
        )
        .filter((F.col("norm_name") != "") & F.col("fact_period").isNotNull())
        .groupBy("norm_name", "fact_period")
        .agg(
            F.count(F.lit(1)).alias("patents"),
            F.sum("cites").alias("cites"),
            F.coalesce(F.sum("lag"), F.lit(0.0)).alias("lags"),
            F.count("lag").alias("stated"),
        )
    )
    named = name_entities(companies, entity)
    joined = fan_join(named, per_name, ["norm_name"], [entity], companies.count())
    return joined.groupBy(entity, "fact_period").agg(
        F.sum("patents").alias("patent_grants_in_q"),
        F.sum("cites").alias("backward_cites_sum_in_q"),
        F.sum("lags").alias("grant_lag_sum_in_q"),
        F.sum("stated").alias("stated_lags_in_q"),
    )
