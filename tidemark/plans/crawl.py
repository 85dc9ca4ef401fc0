"""From company websites and staged listings to homepage proxy tables."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import domain_key
from tidemark.operators.ordered import first_row_per_key, order_key
from tidemark.operators.snapshot_asof import crawl_summary, cutoff_rows, domain_queue, domains_to_do
from tidemark.sources.proxy import conformance
from tidemark.sources.sinks import cut, write_crawl_tree
from tidemark.sources.snapshots import parse_listings, query_log
from tidemark.sources.tabular import path_exists

# One cutoff at the end of each year of the published crawl.
ANNUAL_CUTOFFS = tuple(f"{year}-12-31" for year in range(2010, 2024))


@dataclass
class Crawl:
    rows: DataFrame
    summary: DataFrame
    validation: DataFrame
    remaining: DataFrame


def domain_company_mapping(companies: DataFrame, entity: str = "company_uuid") -> DataFrame:
    """Distinct entities with a usable domain and what is known of their website."""
    keyed = companies.withColumn("website_domain", domain_key(F.col("website")))
    return keyed.filter(F.col("website_domain") != "").select(entity, "website_domain", "website", "founded_on").distinct()


def build_proxy(
    spark: SparkSession, companies: DataFrame, listings: DataFrame, root: str,
    cutoffs: Sequence[str] = ANNUAL_CUTOFFS,
) -> Crawl:
    """Rows for every queued domain that has a listing and every cutoff it has no row for
    yet, added to those already under ``root``. Domains that have all ``cutoffs`` are not
    taken again; those still without a listing remain in the queue."""
    queue = domain_queue(companies)
    done = posixpath.join(root, "proxy")
    earlier = spark.read.parquet(done) if path_exists(spark, posixpath.join(done, "_SUCCESS")) else None
    todo = queue if earlier is None else domains_to_do(queue, earlier, cutoffs)
    once = first_row_per_key(
        listings.join(todo, "website_domain", "left_semi"), ["website_domain"], order_key("error", F.md5(F.col("payload").cast("binary")), "cdx_http_status")
    )
    taken = cut(once, "listings")
    log = query_log(taken)
    rows = cutoff_rows(log, parse_listings(taken), cutoffs, log=log)
    if earlier is not None:
        rows = rows.join(earlier.select("website_domain", "cutoff_date"), ["website_domain", "cutoff_date"], "left_anti")
        # written apart first: the folder that is added to is one of the inputs
        rows = cut(rows, "proxy-rows")
    write_crawl_tree(rows, domain_company_mapping(companies), root, append=earlier is not None)
    rows = spark.read.parquet(done)
    return Crawl(rows, crawl_summary(rows), conformance(rows, "cutoff_date"), domains_to_do(queue, rows, cutoffs))
