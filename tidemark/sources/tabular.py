"""Readers that survive absent files and absent columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.nulls import scrub_nans, to_number, to_timestamp_utc


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(glob_paths(spark, path))


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths on whatever file system the pattern names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(at)
    return sorted(s.getPath().toString() for s in found) if found is not None else []


def files_size(*frames: DataFrame) -> int:
    """Bytes of the files that the frames read, each file once; 0 for frames without files."""
    total = 0
    for name in sorted({file for df in frames for file in df.inputFiles()}):
        spark = frames[0].sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        total += at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    return total


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The wanted columns in the wanted order: present ones cast tolerantly, absent ones
    NULL, others dropped."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for field in schema.fields:
        if field.name not in have:
            col = F.lit(None).cast(field.dataType)
        elif have[field.name] == field.dataType:
            col = F.col(field.name)
        elif isinstance(field.dataType, T.TimestampNTZType):
            col = to_timestamp_utc(F.col(field.name))
        elif isinstance(field.dataType, T.DoubleType):
            col = to_number(F.col(field.name))
        else:
            col = F.col(field.name).try_cast(field.dataType)
        out.append(col.alias(field.name))
    return scrub_nans(df.select(*out))


def read_csv_optional(
    spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = False
) -> DataFrame:
    """CSV with a header; a missing file is an empty table of the same shape.

    Spark splits a file over many tasks. Cells that contain line breaks need
    ``line_breaks=True``, and then one task reads the whole file."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    # as text first: which columns exist is decided by the header, not by position
    raw = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
    return conform(raw, schema)


def read_csv_directory(
    spark: SparkSession, directory: str, schema: T.StructType, line_breaks: bool = False
) -> DataFrame:
    """All CSV parts of a directory, which may differ in their columns."""
    parts = glob_paths(spark, directory.rstrip("/") + "/*.csv")
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [read_csv_optional(spark, p, schema, line_breaks) for p in parts])


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
