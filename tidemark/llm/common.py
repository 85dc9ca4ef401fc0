"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import cut

__all__ = ["cut", "row_id", "number_in_groups", "portions", "read", "slices_for", "word_count", "WORD"]

# Words of most contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_id(*cols: str) -> Column:
    """Key that joins what was derived from a row back to it. Equal rows share it, which is
    harmless as they have equal results."""
    return F.xxhash64(*[F.struct(F.col(c), F.col(c).isNull()) for c in cols])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def portions(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in small slices, so that few texts at a time become Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices_for(rows: int, per_slice: int = 10_000) -> int:
    """Number of key slices so that one slice holds about ``per_slice`` rows at any size."""
    return max(1, -(-rows // per_slice))


def number_in_groups(df: DataFrame, groups: Sequence[str], order: Sequence[str], rows: int, name: str = "rank") -> DataFrame:
    """Number rows from 0 within each group, in any but a fixed order.

    A group is numbered slice by slice (a slice is a hash range of ``order``) and the counts
    of the slices before are added, so a group that holds most rows still spreads over many
    tasks. ``df`` is read twice: pass a written table.
    """
    slices = slices_for(rows)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    keys = [*groups, "_slice"]
    counts = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return sliced.withColumn(name, local).join(starts, keys).withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_slice", "_start")
