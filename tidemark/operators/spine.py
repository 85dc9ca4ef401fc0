"""Who is at risk, and from when to when."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import PanelSpec
from tidemark.functions.periods import period_index
from tidemark.functions.text import sector_bucket
from tidemark.operators.ordered import first_round, require_keys


def entity_base(companies: DataFrame, rounds: DataFrame, spec: PanelSpec, sector: Column | None = None) -> DataFrame:
    """One row per entity with its entry and founding period. The start is the first round,
    else the founding date; an entity with neither is left out."""
    sector = sector_bucket(F.col("description")) if sector is None else sector
    start = F.coalesce("first_round_date", "founded_on")
    joined = companies.join(first_round(rounds, spec.entity), spec.entity, "left")
    base = joined.withColumns(
        {
            "start_date": start,
            "entry_q": period_index(start, spec.unit),
            "founded_q": period_index(F.coalesce("founded_on", start), spec.unit),
            "sector_bucket": sector,
        }
    )
    return require_keys(base, spec.entity, "entry_q")


def data_asof(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """The date up to which every source is complete: the earliest of their latest dates.
    One row; a source without any date does not count."""
    latest = [df.agg(F.max(col).cast("timestamp_ntz").alias("latest")) for df, col in sources]
    return reduce(DataFrame.unionByName, latest).agg(F.min("latest").alias("data_asof"))


def mature_end(asof: DataFrame, spec: PanelSpec) -> int:
    """Last period whose whole label horizon is observed. Reads one row."""
    row = asof.select((period_index(F.col("data_asof"), spec.unit) - spec.horizon).alias("end")).first()
    if row is None or row["end"] is None:
        raise ValueError("no source has a usable date")
    return min(spec.splits.test_end, row["end"])


def at_risk(base: DataFrame, last_period: int, spec: PanelSpec) -> DataFrame:
    """Risk interval of each entity: after entry, before exit, inside the window."""
    cap = F.lit(last_period)
    bounded = base.withColumns(
        {
            "panel_start": F.greatest(F.col("entry_q") + 1, F.lit(spec.window_start)),
            "panel_end": F.when(F.col("exit_q").isNull(), cap).otherwise(F.least(F.col("exit_q") - 1, cap)),
        }
    )
    return bounded.filter(F.col("panel_start") <= F.col("panel_end"))


def panel_spine(base: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per entity and period at risk."""
    valid = base.filter(F.col("panel_start") <= F.col("panel_end"))
    return valid.withColumn(spec.period, F.explode(F.sequence("panel_start", "panel_end"))).drop(
        "panel_start", "panel_end"
    )
