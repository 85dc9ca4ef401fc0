"""Order-sensitive picks written as aggregates.

``min_by``/``max_by`` combine on the map side, so a key that owns most of the rows reaches
its reducer as one partial row per task. A ``row_number() = 1`` window would instead sort
all of the key's rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_key(*cols: Column | str) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])


def first_known(value: Column, order: Column) -> Column:
    """Value of the earliest row that has one."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def last_known(value: Column, order: Column) -> Column:
    """Value of the latest row that has one."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def first_row_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One whole row per key, the lowest by ``order``. NULL keys count as equal."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def require_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows that lack a key or a date."""
    return df.na.drop(subset=list(keys))


def first_round(rounds: DataFrame, entity: str = "company_uuid") -> DataFrame:
    """Earliest round of each entity, each column from the earliest row that knows it."""
    dated = require_keys(rounds, entity, "announced_on")
    order = order_key("announced_on", "investment_type", "money_raised_usd", "num_investors")
    return dated.groupBy(entity).agg(
        F.min("announced_on").alias("first_round_date"),
        first_known(F.col("investment_type"), order).alias("first_stage"),
        first_known(F.col("money_raised_usd"), order).alias("first_round_amount_usd"),
        first_known(F.col("num_investors"), order).alias("first_round_num_investors"),
    )
