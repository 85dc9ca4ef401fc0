"""Joins and top-k selections that stay balanced when one key owns a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that one reducer takes. A key with more is spread over as many reducers as
# its count asks for.
ROWS_PER_SALT = 1_000_000
# Left rows that one reducer takes where each meets a row per period.
ROWS_PER_FAN = 20_000
# Entities whose rows by period one task sorts.
ENTITIES_PER_SORT = 10_000
# Keys that can be spread; a key that is not among them holds less than this share of rows.
HOT_KEYS = 10_000
# Parts into which each group is cut before the last cut of a top-k selection.
SALTS = 64
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def hot_keys(df: DataFrame, on: Sequence[str], per_salt: int = ROWS_PER_SALT, limit: int = HOT_KEYS) -> DataFrame:
    """Keys with more than ``per_salt`` rows and the ``_salts`` they need, the ``limit`` most
    frequent at most. NULL keys match nothing and are not listed."""
    known = df.filter(" and ".join(f"`{c}` is not null" for c in on))
    return salts_of(known.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), on, per_salt, limit)


def salts_of(counted: DataFrame, on: Sequence[str], per_salt: int = ROWS_PER_SALT, limit: int = HOT_KEYS) -> DataFrame:
    """The same from a table of one row per known key with its count ``n``."""
    needed = F.ceil(F.col("n") / per_salt).cast("int")
    hot = counted.filter(F.col("n") > per_salt).orderBy(F.desc("n"), *on).limit(limit)
    return hot.select(*on, needed.alias("_salts"))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    per_salt: int = ROWS_PER_SALT,
    limit: int = HOT_KEYS,
    counted: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Equi-join whose frequent left keys are spread over reducers in proportion to their
    rows, and whose left rows with a NULL key are spread over all.

    ``right`` must hold few rows per key (one, or one per period): its rows for hot keys
    are repeated once per salt. ``spread_by`` names left columns that differ within a key;
    the salt is their hash, so a recomputed task salts its rows the same way again.
    Every pair of the plain join is produced exactly once. ``counted`` gives the rows ``n``
    per known key of ``left`` where the caller has them, which saves a pass over ``left``.
    ``parts`` fixes the number of reducers, which are then not merged by the size of what they read.
    """
    on = list(on)
    # At most `limit` small rows by construction.
    hot = F.broadcast(hot_keys(left, on, per_salt, limit) if counted is None else salts_of(counted, on, per_salt, limit))
    unknown = F.lit(False)
    for c in on:
        unknown = unknown | F.col(c).isNull()
    spread = F.xxhash64(*spread_by)
    salt = F.when(unknown, -1 - F.pmod(spread, F.lit(1 << 20))).otherwise(F.coalesce(F.pmod(spread, F.col("_salts")), F.lit(0)))
    repeat = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    salted_left = left.join(hot, on, "left").withColumn("_salt", salt.cast("long")).drop("_salts")
    salted_right = right.join(hot, on, "left").withColumn("_salt", F.explode(repeat.cast("array<bigint>"))).drop("_salts")
    if parts is not None:
        # Merged, or a small left side would be sent to the few reducers of the right one.
        salted_left, salted_right = salted_left.repartition(parts, *on, "_salt"), salted_right.hint("merge")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def fan_parts(df: DataFrame, rows: int, per_task: int = ROWS_PER_FAN) -> int:
    """Tasks for what gives a row per period of each of ``rows`` rows: at least as many as
    there are, and none with many more than ``per_task`` of them."""
    return max(-(-rows // per_task), df.sparkSession.sparkContext.defaultParallelism)


def fan_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str], rows: int, per_task: int = ROWS_PER_FAN) -> DataFrame:
    """Inner :func:`spread_join` whose right side holds a row per period, so that the result
    is many times what its reducers read. Their number follows the left ``rows`` (at least
    as many as there are), and a key with more than ``per_task`` of them is spread."""
    return spread_join(left, right, on, spread_by, per_salt=per_task, parts=fan_parts(left, rows, per_task))


def top_k(
    df: DataFrame,
    groups: Sequence[str],
    k: int,
    order: Sequence[Column],
    spread_by: Sequence[str],
    rank: str = "top_rank",
    salts: int = SALTS,
) -> DataFrame:
    """First ``k`` rows of each group by a total order, numbered from 1.

    Each group is cut to ``k`` inside every task that reads it, then within every salt, so
    neither a shuffle nor the task of the last cut sees a whole group. Spark cuts inside the
    reading tasks only up to a session limit on ``k``, which is raised here if need be.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_GROUP_LIMIT)) < k:
        conf.set(_GROUP_LIMIT, str(k))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    near = Window.partitionBy(*groups, "_salt").orderBy(*order)
    final = Window.partitionBy(*groups).orderBy(*order)
    short = salted.withColumn("_near", F.row_number().over(near)).filter(F.col("_near") <= k)
    ranked = short.drop("_near", "_salt").withColumn(rank, F.row_number().over(final))
    return ranked.filter(F.col(rank) <= k)
