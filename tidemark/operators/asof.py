"""Facts as a later observer could have seen them.

A fact dated in period ``p`` is visible from ``p + lag``. Facts are first reduced to one
row per (entity, period), which bounds every entity's share by the number of periods; the
running windows below therefore never see an unbounded group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import zero_if_null
from tidemark.functions.periods import period_index, visible_from
from tidemark.operators.ordered import last_known, order_key, require_keys
from tidemark.operators.skew import ENTITIES_PER_SORT, fan_parts


@dataclass
class FactBlock:
    """Facts at one row per (entity, period). ``totals`` maps a per-period column to the
    name of its running total; ``latest`` columns carry their last known value; ``first``
    columns carry their running minimum."""

    facts: DataFrame
    totals: dict[str, str] = field(default_factory=dict)
    latest: Sequence[str] = ()
    first: Sequence[str] = ()

    @property
    def inputs(self) -> list[str]:
        return [*self.totals, *self.latest, *self.first]


def rounds_by_period(rounds: DataFrame, entity: str, unit: str = "quarter") -> DataFrame:
    """Funding rounds per (entity, period): count, sum and the last known value of each
    attribute. An unknown amount counts as 0."""
    dated = require_keys(rounds, entity, "announced_on").withColumns(
        {
            "fact_period": period_index(F.col("announced_on"), unit),
            "amount": F.greatest(zero_if_null(F.col("money_raised_usd")), F.lit(0.0)),
        }
    )
    order = order_key("announced_on", "amount", "investment_type", "num_investors")
    return dated.groupBy(entity, "fact_period").agg(
        F.count(F.lit(1)).alias("round_count_in_q"),
        F.sum("amount").alias("raised_in_q"),
        last_known(F.col("amount"), order).alias("last_round_amount"),
        last_known(F.col("num_investors"), order).alias("num_investors_last_round"),
        last_known(F.col("investment_type"), order).alias("raw_stage_label"),
        F.max(F.when(F.col("money_raised_usd").isNotNull(), F.col("amount"))).alias("largest_stated_amount"),
    )


def running_totals(facts: DataFrame, entity: str, period: str, totals: dict[str, str]) -> DataFrame:
    """As-of cumulative sums over one row per (entity, period)."""
    upto = Window.partitionBy(entity).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return facts.withColumns({out: F.sum(col).over(upto) for col, out in totals.items()})


def merge_visible(panel: DataFrame, facts: DataFrame, entity: str, period: str, lag: int = 1) -> DataFrame:
    """Facts on the one panel row where they first become visible, nothing elsewhere."""
    seen = facts.withColumn(period, visible_from(F.col("fact_period"), lag)).drop("fact_period")
    return panel.join(seen, [entity, period], "left")


def carry_forward(panel: DataFrame, entity: str, period: str, cols: Sequence[str]) -> DataFrame:
    """Last known value of each column down an entity's rows."""
    upto = Window.partitionBy(entity).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in cols})


def asof_panel(
    base: DataFrame,
    blocks: Sequence[FactBlock],
    entity: str,
    period: str,
    lag: int = 1,
    mode: str = "full_history",
    entities: int | None = None,
) -> DataFrame:
    """Expand entities into one row per period at risk and attach every block as of then.

    ``base`` has one row per entity with ``panel_start`` and ``panel_end``. Base rows and
    facts are brought together *before* the expansion, so the shuffle moves one row per
    entity instead of one per (entity, period); the expansion and one window for all
    blocks then run inside that partitioning. What a task sorts is many times what it reads,
    so a caller that knows the number of ``entities`` sets the number of tasks by it.

    ``full_history`` sees every earlier fact. ``panel_only`` ignores facts that became
    visible before the entity's first row, as an exact merge with forward fill does.
    """
    if mode not in ("full_history", "panel_only"):
        raise ValueError(f"unknown as-of mode: {mode}")
    payload = [c for c in base.columns if c not in (entity, "panel_start", "panel_end")]
    spans = base.filter(F.col("panel_start") <= F.col("panel_end")).select(
        entity,
        F.sequence("panel_start", "panel_end").alias("_periods"),
        F.lit(1).alias("_spine"),
        F.struct(*payload).alias("_base") if payload else F.lit(None).cast("struct<x:int>").alias("_base"),
    )
    facts = [
        block.facts.select(
            entity,
            F.array(visible_from(F.col("fact_period"), lag)).alias("_periods"),
            F.lit(0).alias("_spine"),
            *block.inputs,
        )
        for block in blocks
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spans, *facts])
    tasks = [] if entities is None else [fan_parts(base, entities, ENTITIES_PER_SORT)]
    rows = stacked.repartition(*tasks, entity).withColumn(period, F.explode("_periods")).drop("_periods")

    by_entity = Window.partitionBy(entity)
    upto = by_entity.orderBy(period, "_spine").rowsBetween(Window.unboundedPreceding, 0)
    totals = {col: out for block in blocks for col, out in block.totals.items()}
    latest = [c for block in blocks for c in block.latest]
    first = [c for block in blocks for c in block.first]
    carried = [*totals.values(), *latest, *first]

    rows = rows.withColumns(
        {
            **{out: F.sum(col).over(upto) for col, out in totals.items()},
            **{c: F.min(c).over(upto) for c in first},
        }
    )
    if mode == "full_history":
        rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in latest})
    else:
        opens = F.min(F.when(F.col("_spine") == 1, F.col(period))).over(by_entity)
        on_panel = (F.col("_spine") == 0) & (F.col(period) >= F.col("_opens"))
        rows = rows.withColumn("_opens", opens)
        rows = rows.withColumns({c: F.last(F.when(on_panel, F.col(c)), ignorenulls=True).over(upto) for c in carried})
    on_spine = rows.filter(F.col("_spine") == 1)
    return on_spine.select(entity, period, *[F.col("_base")[c].alias(c) for c in payload], *carried)
