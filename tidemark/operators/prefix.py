"""Global order without a one-task sort.

Ranks, quantiles, AUC and average precision need, for each value, how many rows lie below
it. Values are collapsed to counts, cut into ranges of about equal weight, ordered inside
each range in parallel, and shifted by the totals of the ranges before. The cut points are
plain numbers in the plan: any cut points give the same answer, they only decide balance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import key_digest

# Ranges at least, and rows that one range may hold before there are more.
RANGES = 256
ROWS_PER_RANGE = 2_000_000


def cut_points(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """Approximate quantiles of ``value``, repeated where one value is heavy: at least
    ``ranges`` of them, and as many as the number of rows asks for. One row comes back to
    the driver, a number per range."""
    if ranges < 2:
        return []

    def sketch(n: int):
        steps = F.array(*[F.lit(i / n) for i in range(1, n)])
        return F.percentile_approx(F.col(value).cast("double"), steps, 20 * n).alias("q")

    row = df.agg(sketch(ranges), F.count(F.lit(1)).alias("n")).first()
    wanted = -(-row["n"] // ROWS_PER_RANGE)
    if wanted > ranges:
        row = df.agg(sketch(wanted)).first()
    return list(row["q"] or [])


def into_ranges(df: DataFrame, value: str, cuts: Sequence[float], out: str) -> DataFrame:
    edges = [-math.inf, *sorted(set(cuts)), math.inf]
    typed = df.withColumn("_value", F.col(value).cast("double"))
    if len(edges) < 3:
        return typed.withColumn(out, F.lit(0)).drop("_value")
    cutter = Bucketizer(splits=edges, inputCol="_value", outputCol=out)
    return cutter.transform(typed).withColumn(out, F.col(out).cast("int")).drop("_value")


def value_prefix(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    weights: dict[str, Column] | None = None,
    ranges: int = RANGES,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """One row per (group, value): weights of the value, of all smaller values in its group
    (``<w>_before``) and of the group (``<w>_total``). ``n`` counts rows. NULL values are
    left out. ``cuts`` reuses cut points found before.
    """
    groups = list(groups)
    measures = {"n": F.lit(1), **(weights or {})}
    known = df.filter(F.col(value).isNotNull())
    cuts = cut_points(known, value, ranges) if cuts is None else cuts
    cells = known.groupBy(*groups, value).agg(*[F.sum(w).alias(m) for m, w in measures.items()])
    cells = into_ranges(cells, value, cuts, "_range")

    per_range = cells.groupBy(*groups, "_range").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *groups,
        "_range",
        *[F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_total") for m in measures],
    )
    smaller = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.join(offsets, [*groups, "_range"]).withColumns(
        {f"{m}_before": F.col(f"_{m}_offset") + F.coalesce(F.sum(m).over(smaller), F.lit(0)) for m in measures}
    )
    return placed.select(
        *groups, value, *measures, *[f"{m}_before" for m in measures], *[f"{m}_total" for m in measures]
    )


def exact_quantiles(prefix: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles from a value prefix, one column per entry of
    ``probs``. Reads the two neighbouring order statistics of each."""
    aggs = []
    v = F.col(value).cast("double")
    for name, p in probs.items():
        at = (F.col("n_total") - 1) * p
        low, high = F.floor(at), F.ceil(at)
        holds = lambda pos: (F.col("n_before") <= pos) & (pos < F.col("n_before") + F.col("n"))
        a, b = F.max(F.when(holds(low), v)), F.max(F.when(holds(high), v))
        part = F.max(at - low)
        aggs.append((a + (b - a) * part).alias(name))
    return prefix.groupBy(*groups).agg(*aggs)


def row_positions(
    df: DataFrame,
    value: str,
    key: Sequence[str],
    groups: Sequence[str] = (),
    ranges: int = RANGES,
    position: str = "position",
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Number rows 1..N within each group by (value, md5 of the key, key) and add ``n_rows``.

    A value that fills whole ranges gets its own range, cut further by the leading hex
    digits of the md5, so a score shared by a third of all rows is still ordered by many
    tasks. Hash order among ties favours no entity.
    """
    groups, key = list(groups), list(key)
    known = df.filter(F.col(value).isNotNull())
    cuts = cut_points(known, value, ranges) if cuts is None else cuts
    heavy = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    edges = [*cuts, *[math.nextafter(v, math.inf) for v in heavy]]
    digest = key_digest(*[F.col(c) for c in key])
    placed = into_ranges(known.withColumn("_tie", digest), value, edges, "_range")
    is_heavy = F.col(value).cast("double").isin(heavy) if heavy else F.lit(False)
    digits = 2 if len(cuts) < 1000 else 4
    slice_of = F.conv(F.substring("_tie", 1, digits), 16, 10).cast("int")
    placed = placed.withColumn("_slice", F.when(is_heavy, slice_of).otherwise(0))

    cell = [*groups, "_range", "_slice"]
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_range", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *cell,
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(whole).alias("n_rows"),
        )
    )
    inside = Window.partitionBy(*cell).orderBy(value, "_tie", *key)
    numbered = placed.join(offsets, cell).withColumn(position, F.col("_offset") + F.row_number().over(inside))
    return numbered.drop("_range", "_slice", "_tie", "_offset")
