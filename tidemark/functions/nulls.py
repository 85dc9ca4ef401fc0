"""One missing marker (NULL), tolerant casts and the numeric guards built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def scrub_nans(df: DataFrame) -> DataFrame:
    """NaN sorts above every number in Spark and equals itself; make it NULL at the scan."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def to_number(col: Column) -> Column:
    """Bad text becomes NULL instead of an ANSI error."""
    return nan_to_null(col.try_cast("double"))


def to_timestamp_utc(col: Column) -> Column:
    """Text in the accepted layouts to a zone-free UTC timestamp, bad text to NULL.

    The session zone must be UTC, as everywhere in this package.
    """
    text = F.trim(col.cast("string"))
    parsed = F.coalesce(
        text.try_cast("timestamp"),
        F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")),
        F.try_to_timestamp(text, F.lit("MM/dd/yyyy")),
    )
    return parsed.cast("timestamp_ntz")


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0))


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Like ``greatest``/``least`` but NULL stays NULL."""
    out = col
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(col.isNotNull(), out)


def missing_flag(col: Column) -> Column:
    return col.isNull().cast("int")


def log1p_clip(col: Column) -> Column:
    """For skewed amounts and counts: missing and negative both count as 0."""
    return F.log1p(F.greatest(zero_if_null(col), F.lit(0.0)))


def log1p_keep_null(col: Column) -> Column:
    return F.log1p(clip(col.cast("double"), low=0.0))


def ratio(num: Column, den: Column) -> Column:
    """NULL where the denominator is 0 or missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def elapsed(now: Column, then: Column) -> Column:
    """Periods since ``then``, never below 0; NULL if ``then`` is unknown."""
    return F.when(then.isNotNull(), F.greatest(now - then, F.lit(0)))
