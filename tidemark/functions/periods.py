"""Integer period numbers. A quarter is ``year * 4 + quarter - 1``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_index(date: Column, unit: str = "quarter") -> Column:
    if unit == "quarter":
        out = F.year(date) * 4 + F.quarter(date) - 1
    elif unit == "month":
        out = F.year(date) * 12 + F.month(date) - 1
    elif unit == "week":
        # 1970-01-05 was a Monday
        out = F.floor(F.datediff(date, F.lit("1970-01-05").cast("date")) / 7)
    elif unit == "day":
        out = F.datediff(date, F.lit("1970-01-01").cast("date"))
    else:
        raise ValueError(f"unknown period unit: {unit}")
    return out.cast("int")


def parse_quarter(label: str) -> int:
    """``2018Q4`` to 8075, for constants on the driver."""
    found = re.fullmatch(r"\s*(\d{4})Q([1-4])\s*", str(label))
    if found is None:
        raise ValueError(f"not a quarter label: {label!r}")
    return int(found[1]) * 4 + int(found[2]) - 1


def quarter_from_label(col: Column) -> Column:
    """Column form of :func:`parse_quarter`; a bad label fails the query, NULL stays NULL."""
    text = F.trim(col)
    pattern = r"^(\d{4})Q([1-4])$"
    value = (
        F.regexp_extract(text, pattern, 1).try_cast("int") * 4
        + F.regexp_extract(text, pattern, 2).try_cast("int")
        - 1
    )
    return (
        F.when(text.isNull(), F.lit(None).cast("int"))
        .when(text.rlike(pattern), value)
        .otherwise(F.raise_error(F.concat(F.lit("not a quarter label: "), text)).cast("int"))
    )


def quarter_label(idx: Column) -> Column:
    year = F.floor(idx / 4).cast("int")
    return F.concat(year.cast("string"), F.lit("Q"), (F.pmod(idx, F.lit(4)) + 1).cast("string"))


def visible_from(period: Column, lag: int = 1) -> Column:
    """First period that may use a fact dated ``period``: the leakage control of the package."""
    return (period + F.lit(lag)).cast("int")


def lag_days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)
