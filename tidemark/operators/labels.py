"""Outcome events, horizon labels and temporal splits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import PanelSpec
from tidemark.functions.periods import period_index
from tidemark.operators.ordered import first_known, order_key, require_keys

# On one date the route with the lower number wins.
ROUTE_PRIORITY = {"ipo": 0, "mna": 1, "sponsor_sale": 2}


@dataclass
class ExitSource:
    """One source of outcome events. ``value=None`` means its amounts are not used."""

    events: DataFrame
    route: str
    entity: str
    date: str
    value: str | None = None


def exit_events(sources: list[ExitSource], spec: PanelSpec) -> DataFrame:
    """All dated outcome events of all sources in one shape."""
    shaped = [
        require_keys(s.events, s.entity, s.date).select(
            F.col(s.entity).alias(spec.entity),
            F.col(s.date).cast("timestamp_ntz").alias("event_date"),
            (F.col(s.value) if s.value else F.lit(None)).cast("double").alias("event_value_usd"),
            F.lit(s.route).alias("route_label"),
            F.lit(ROUTE_PRIORITY.get(s.route, 9)).alias("route_priority"),
        )
        for s in sources
    ]
    return reduce(DataFrame.unionByName, shaped)


def first_exit(events: DataFrame, spec: PanelSpec) -> DataFrame:
    """Earliest event of each entity by date, then route priority. The amount is the first
    one known in that order, so it may come from a later event."""
    order = order_key("event_date", "route_priority", "event_value_usd")
    return (
        events.groupBy(spec.entity)
        .agg(
            F.min("event_date").alias("exit_date"),
            F.min_by("route_label", order).alias("route_label"),
            first_known(F.col("event_value_usd"), order).alias("event_value_usd"),
        )
        .withColumn("exit_q", period_index(F.col("exit_date"), spec.unit))
    )


def within_horizon(exit_period: Column, now: Column, horizon: int) -> Column:
    """1 if the exit falls in ``[now + 1, now + horizon]``, else 0."""
    return F.coalesce(exit_period.between(now + 1, now + horizon), F.lit(False)).cast("int")


def label_rows(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    hit = within_horizon(F.col("exit_q"), F.col(spec.period), spec.horizon)
    return panel.withColumn(spec.label, hit).withColumn(
        "company_exit_route", F.when(F.col(spec.label) == 1, F.col("route_label")).otherwise("no_exit")
    )


def split_of(period: Column, spec: PanelSpec) -> Column:
    """``train``, ``validation``, ``test`` or ``exclude``."""
    s = spec.splits
    out = (
        F.when(period <= s.train_end - s.purge, "train")
        .when(period <= s.train_end, "exclude")
        .when(period <= s.validation_end - s.purge, "validation")
        .when(period <= s.validation_end, "exclude")
        .when(period <= s.test_end, "test")
    )
    return out.otherwise("exclude")


def split_rows(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    return panel.withColumn("split", split_of(F.col(spec.period), spec)).filter(F.col("split") != "exclude")


def route_support(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Positive rows and distinct entities per split and route."""
    return (
        panel.filter(F.col(spec.label) == 1)
        .groupBy("split", "company_exit_route")
        .agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(spec.entity).alias("companies"))
    )


def route_priors(panel: DataFrame, spec: PanelSpec, split: str = "train") -> DataFrame:
    """Share of each route among the positive rows of one split. The window runs over the
    handful of route rows left after the count."""
    counted = (
        panel.filter((F.col("split") == split) & (F.col(spec.label) == 1))
        .groupBy("split", F.col("company_exit_route").alias("route"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("split"))
    return counted.select("route", (F.col("n") / total).alias("conditional_probability"))
