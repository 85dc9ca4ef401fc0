"""Homepage proxy files: discovery, reading, lineage and conformance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import domain_key
from tidemark.operators.skew import spread_join
from tidemark.sources.contracts import PROXY_READ, PROXY_REQUIRED
from tidemark.sources.tabular import glob_paths

FILE_STEM = "homepage_domain_archive_proxy"


def logical_file(path: Column) -> Column:
    """The proxy file a physical file belongs to: itself, or the folder of parts around it."""
    found = F.regexp_extract(path, rf"^(.*/{FILE_STEM}\.(?:parquet|csv))(?:/|$)", 1)
    return F.when(found != "", found)


def proxy_files(spark: SparkSession, roots: list[str]) -> list[str]:
    """Distinct proxy files under any of the roots, sorted. Absent roots are skipped.

    File names are listed by a Spark scan that never opens the files; only the distinct
    names come to the driver.
    """
    found: list[str] = []
    for root in roots:
        if glob_paths(spark, root):
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            names = listed.select(logical_file(F.col("path")).alias("f")).filter("f is not null").distinct()
            found += [r["f"] for r in names.collect()]
    return sorted(dict.fromkeys(found))


def cutoff_from_path(path: Column) -> Column:
    """Value of a ``cutoff=<date>_crawl=...`` directory, NULL if there is none."""
    value = F.regexp_extract(path, "/cutoff=([^/]*?)(_crawl=[^/]*)?/", 1)
    return F.when(value != "", value)


def fill_cutoff(rows: DataFrame) -> DataFrame:
    """Take the cutoff from the path for files where every row lacks one. The decision is
    one counted row per file, joined back with large files spread."""
    per_file = rows.groupBy("source_path").agg(F.count("cutoff_date").alias("_stated"))
    joined = spread_join(rows, per_file, ["source_path"], ["website_domain"], how="left")
    from_path = F.when(F.col("_stated") == 0, cutoff_from_path(F.col("source_path")))
    return joined.withColumn("cutoff_date", F.coalesce("cutoff_date", from_path)).drop("_stated")


def read_proxy_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of all files with the wanted columns as text, the ``source_path`` and the
    ``source_columns`` that the file itself has. Files of one format and header are one
    scan. A file that cannot be read fails the query; nothing of it is left out silently."""
    same: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for path in paths:
        suffix = path.rsplit(".", 1)[-1]
        if suffix in ("csv", "parquet"):
            same.setdefault((suffix, tuple(_open(spark, suffix, [path]).columns)), []).append(path)
    if not same:
        return spark.createDataFrame([], ", ".join([*(f"{c} string" for c in [*PROXY_READ, "source_path"]), "source_columns array<string>"]))
    frames = [_shape(_open(spark, suffix, group), columns) for (suffix, columns), group in same.items()]
    return fill_cutoff(reduce(DataFrame.unionByName, frames))


def _open(spark: SparkSession, suffix: str, paths: list[str]) -> DataFrame:
    """A header or a footer is all that opening reads."""
    return spark.read.option("header", True).csv(paths) if suffix == "csv" else spark.read.parquet(*paths)


def _shape(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    cols = [(F.col(c).cast("string") if c in columns else F.lit(None).cast("string")).alias(c) for c in PROXY_READ]
    own = F.array(*map(F.lit, columns)).cast("array<string>").alias("source_columns")
    return df.select(*cols, logical_file(F.col("_metadata.file_path")).alias("source_path"), own)


def source_audit(rows: DataFrame, domain_map: DataFrame, entity: str) -> DataFrame:
    """Per source file: type, rows loaded, and the entities and domains it matches.

    Rows are counted per (file, domain) before they meet the entities of a domain, of which
    a shared domain may have very many.
    """
    keyed = rows.withColumn("website_domain", domain_key(F.col("website_domain")))
    per_domain = keyed.groupBy("source_path", "website_domain").agg(F.count(F.lit(1)).alias("_rows"))
    matched = spread_join(domain_map.select(entity, "website_domain"), per_domain, ["website_domain"], [entity])
    reach = matched.groupBy("source_path").agg(
        F.countDistinct(entity).alias("matched_companies"), F.countDistinct("website_domain").alias("matched_domains")
    )
    loaded = per_domain.groupBy("source_path").agg(F.sum("_rows").alias("rows_loaded"))
    return loaded.join(reach, "source_path", "left").select(
        "source_path",
        F.lower(F.regexp_extract("source_path", r"\.([A-Za-z0-9]+)$", 1)).alias("source_type"),
        "rows_loaded",
        F.coalesce("matched_companies", F.lit(0)).alias("matched_companies"),
        F.coalesce("matched_domains", F.lit(0)).alias("matched_domains"),
    )


def conformance(rows: DataFrame, group: str, required: list[str] | None = None) -> DataFrame:
    """Per file (or cutoff): rows, required columns that are missing, distinct domains and
    the share of archived pages. Rows read from files carry their file's own columns; a
    group lacks what any of its files lacks. Other rows are judged by the table's columns."""
    wanted = PROXY_REQUIRED if required is None else required
    if "source_columns" in rows.columns:
        lacking = F.array_except(F.array(*map(F.lit, wanted)), "source_columns")
        found = F.array_distinct(F.flatten(F.collect_set(lacking)))
        missing = F.array_join(F.filter(F.array(*map(F.lit, wanted)), lambda c: F.array_contains(found, c)), ", ")
    else:
        missing = F.lit(", ".join(c for c in wanted if c not in rows.columns))
    aggs = [F.count(F.lit(1)).alias("rows"), missing.alias("missing_required_columns")]
    if "website_domain" in rows.columns:
        aggs.append(F.countDistinct("website_domain").alias("unique_domains"))
    else:
        aggs.append(F.lit(0).cast("long").alias("unique_domains"))
    if "homepage_archive_status" in rows.columns:
        hit = (F.coalesce(F.col("homepage_archive_status"), F.lit("")) == "archived_200").cast("int")
        aggs.append(F.avg(hit).alias("archived_200_share"))
    else:
        aggs.append(F.lit(None).cast("double").alias("archived_200_share"))
    return rows.groupBy(group).agg(*aggs)
