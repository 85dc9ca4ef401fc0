"""The labelled panel: entities x periods at risk, as-of facts, outcome label, split."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import PanelSpec
from tidemark.functions.nulls import elapsed, log1p_clip, log1p_keep_null, missing_flag, ratio
from tidemark.functions.scores import sponsor_score
from tidemark.functions.text import stage_bucket
from tidemark.operators import labels, matching, spine
from tidemark.operators.asof import FactBlock, asof_panel, rounds_by_period
from tidemark.sources.sinks import cut
from tidemark.sources.tabular import files_size

# Bytes of a file that one task reads.
SPLIT_BYTES = 16 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"
# Shuffled bytes that one task reads: rows take some thirty times as many where they are
# joined, sorted and added up in one stage.
READ_BYTES = 8 << 20
_READ = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# Bytes of the input files for each partition of a shuffle, before small ones are merged.
INPUT_PER_PART = 1 << 20
_PARTS, _PARTS_ELSE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.shuffle.partitions"


@dataclass
class PanelInputs:
    """The input tables, in the shapes of ``sources.contracts``."""

    companies: DataFrame
    funding_rounds: DataFrame
    acquisitions: DataFrame
    ipos: DataFrame
    vc_deals: DataFrame
    buyout_deals: DataFrame
    patents: DataFrame | None = None
    partner_features: DataFrame | None = None
    homepage_rows: DataFrame | None = None


@dataclass
class PanelResult:
    panel: DataFrame
    exits: DataFrame
    data_asof: DataFrame
    last_period: int


@dataclass
class MatchTables:
    """Written once and read by every sum over matched deals."""

    entities: DataFrame
    ledger: DataFrame
    repeated: DataFrame


def _in_bytes(size: str) -> int:
    """``134217728b``, ``128m`` or ``128MB`` in bytes."""
    number = size.lower().rstrip("b")
    return int(number.rstrip("kmgtp")) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(number[-1], 0)


def _bounded_tasks(inputs: PanelInputs) -> None:
    """Session settings by which the tasks grow in number, not in size, with the input.

    A task that adds up deals holds about as many groups as its split has rows, so splits are
    kept small wherever they may be larger. Shuffles get partitions by the size of the input
    files, and small ones are merged up to a bound."""
    conf = inputs.companies.sparkSession.conf
    for name, most in ((_SPLIT, SPLIT_BYTES), (_READ, READ_BYTES)):
        if _in_bytes(conf.get(name)) > most:
            conf.set(name, str(most))
    read = [inputs.companies, inputs.funding_rounds, inputs.acquisitions, inputs.ipos, inputs.vc_deals, inputs.buyout_deals]
    extra = [inputs.patents, inputs.partner_features, inputs.homepage_rows]
    parts = -(-files_size(*read, *(df for df in extra if df is not None)) // INPUT_PER_PART)
    if parts > int(conf.get(_PARTS, None) or conf.get(_PARTS_ELSE)):
        conf.set(_PARTS, str(parts))


def match_tables(inputs: PanelInputs, spec: PanelSpec) -> MatchTables:
    """Entities with their match keys, the ledger of deals, and the deals listed twice."""
    _bounded_tasks(inputs)
    deals = matching.unified_deals(inputs.vc_deals, inputs.buyout_deals)
    keyed = matching.deal_keys(deals, spec.match_missing_country)
    entities = cut(matching.entity_keys(inputs.companies, spec.entity, spec.match_missing_country), "entity-keys")
    ledger = cut(matching.deal_ledger(keyed, spec.unit), "deal-ledger")
    return MatchTables(entities, ledger, cut(matching.listed_twice(ledger), "deals-listed-twice"))


def default_exit_sources(inputs: PanelInputs, links: DataFrame, spec: PanelSpec) -> list[labels.ExitSource]:
    """Acquisitions, listings and matched buyouts. Of an entity's buyouts only the first
    can be its first exit, and their amounts are not used."""
    return [
        labels.ExitSource(inputs.acquisitions, "mna", "acquiree_uuid", "announced_on", "price_usd"),
        labels.ExitSource(inputs.ipos, "ipo", "company_uuid", "went_public_on", "money_raised_usd"),
        labels.ExitSource(links, "sponsor_sale", spec.entity, "first_buyout_date"),
    ]


def default_asof(inputs: PanelInputs) -> DataFrame:
    """The date up to which all six dated tables are complete."""
    return spine.data_asof(
        [
            (inputs.companies, "collected_at"),
            (inputs.funding_rounds, "announced_on"),
            (inputs.acquisitions, "announced_on"),
            (inputs.ipos, "went_public_on"),
            (inputs.vc_deals, "deal_date"),
            (inputs.buyout_deals, "deal_date"),
        ]
    )


def round_block(rounds: DataFrame, spec: PanelSpec) -> FactBlock:
    facts = rounds_by_period(rounds, spec.entity, spec.unit).withColumn("round_q", F.col("fact_period"))
    return FactBlock(
        facts,
        totals={"round_count_in_q": "round_count_asof", "raised_in_q": "cum_raised_asof"},
        latest=["round_q", "last_round_amount", "num_investors_last_round", "raw_stage_label", "largest_stated_amount"],
    )


def deal_block(match: MatchTables, spec: PanelSpec) -> FactBlock:
    return FactBlock(
        matching.deals_by_period(match.entities, match.ledger, spec.entity, match.repeated),
        totals={
            "preqin_deals_in_q": "preqin_deal_count_asof",
            "preqin_deal_size_in_q": "preqin_deal_size_sum_asof",
        },
        latest=["buyout_enterprise_value_latest_q"],
    )


def round_features(panel: DataFrame, spec: PanelSpec, stage: Column | None = None) -> DataFrame:
    """``last_round_amount_missing`` marks "no round visible"; ``last_amount_unstated`` marks
    a visible round history without any stated amount."""
    now = F.col(spec.period)
    age = F.greatest(now - F.col("founded_q"), F.lit(0))
    stage = stage_bucket(F.coalesce("raw_stage_label", "first_stage")) if stage is None else stage
    return panel.withColumns(
        {
            "age_q": age,
            "log_age_years": F.log1p(age / 4),
            "time_since_last_round_q": elapsed(now, F.col("round_q")),
            "last_round_amount_missing": missing_flag(F.col("last_round_amount")),
            "last_amount_unstated": missing_flag(F.col("largest_stated_amount")),
            "log_last_round_usd": log1p_clip(F.col("last_round_amount")),
            "num_investors_missing": missing_flag(F.col("num_investors_last_round")),
            "log_num_investors_last_round": log1p_clip(F.col("num_investors_last_round")),
            "log_cum_raised_asof": log1p_clip(F.col("cum_raised_asof")),
            "round_velocity": ratio(F.col("round_count_asof"), age / 4),
            "stage_bucket": stage,
            "last_stage": stage,
        }
    ).drop("largest_stated_amount")


def deal_features(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    count = F.coalesce(F.col("preqin_deal_count_asof"), F.lit(0))
    matched = (count > 0).cast("int")
    waited = F.col(spec.period) - F.col("first_preqin_deal_q")
    return panel.withColumns(
        {
            "preqin_deal_count_asof": count,
            "preqin_deal_size_sum_asof": F.coalesce("preqin_deal_size_sum_asof", F.lit(0.0)),
            "crosswalk_matched_asof": matched,
            "preqin_institutional_confirmation": matched,
            "quarters_since_first_preqin_deal": F.when(matched == 1, waited.cast("double")).otherwise(0.0),
            "log_enterprise_value_at_entry": log1p_keep_null(F.col("buyout_enterprise_value_latest_q")),
            "enterprise_value_missing_flag": missing_flag(F.col("buyout_enterprise_value_latest_q")),
            "sponsor_score": sponsor_score(matched, F.col("num_investors_last_round")),
        }
    )


def build_panel(
    inputs: PanelInputs,
    spec: PanelSpec,
    exit_sources: list[labels.ExitSource] | None = None,
    asof: DataFrame | None = None,
    extra_blocks: list[FactBlock] | None = None,
    sector: Column | None = None,
    stage: Column | None = None,
    write_facts: bool = False,
) -> PanelResult:
    """Compose the panel. Lazy but for the match stage tables and the one-row data date.
    With ``write_facts`` the matched deals are summed and written first, so that their
    shuffle files are gone before the expansion writes its own.

    Blocks of other feature families may ride along in ``extra_blocks``, so that the panel
    is expanded and windowed once for all of them.
    """
    match = match_tables(inputs, spec)
    links = matching.crosswalk_first(match.entities, match.ledger, spec.entity, spec.unit)
    sources = default_exit_sources(inputs, links, spec) if exit_sources is None else exit_sources
    exits = labels.first_exit(labels.exit_events(sources, spec), spec)
    asof = default_asof(inputs) if asof is None else asof
    last_period = spine.mature_end(asof, spec)

    base = spine.entity_base(inputs.companies, inputs.funding_rounds, spec, sector)
    base = base.join(exits.drop("exit_date"), spec.entity, "left")
    base = base.join(links.select(spec.entity, "first_preqin_deal_q"), spec.entity, "left")
    base = spine.at_risk(base, last_period, spec).select(
        spec.entity, *spec.carry, "founded_q", "sector_bucket", "first_stage", "exit_q", "route_label",
        "event_value_usd", "first_preqin_deal_q", "panel_start", "panel_end",
    )
    deals = deal_block(match, spec)
    if write_facts:
        deals = replace(deals, facts=cut(deals.facts, "deal-facts"))
    blocks = [round_block(inputs.funding_rounds, spec), deals, *(extra_blocks or [])]
    panel = asof_panel(base, blocks, spec.entity, spec.period, spec.lag, spec.asof_mode, match.entities.count())
    panel = deal_features(round_features(panel, spec, stage), spec)
    panel = labels.split_rows(labels.label_rows(panel, spec), spec)
    return PanelResult(panel, exits, asof, last_period)
