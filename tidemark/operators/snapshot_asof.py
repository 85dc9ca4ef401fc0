"""Latest archive snapshot before each cutoff, if it is fresh enough.

A snapshot in the look-back window exists exactly when the *latest* snapshot up to the
cutoff lies in it. So each snapshot is filed under the first cutoff it precedes, the latest
of each file is kept (combined on the map side), and a running maximum over at most one
row per cutoff answers every cutoff. Nothing joins snapshots to cutoffs by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import evidence_strength
from tidemark.sources.snapshots import listing_url

DETAIL = ["timestamp", "original", "statuscode", "mimetype", "digest"]


def cutoff_array(cutoffs: Sequence[str]) -> Column:
    """Sorted cutoff midnights as an array literal."""
    return F.array(*[F.lit(c).cast("timestamp_ntz") for c in sorted(cutoffs)])


def latest_by_cutoff(snapshots: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Latest snapshot per (domain, first cutoff at or after it); snapshots after the last
    cutoff share a NULL cutoff, which no cutoff reads."""
    filed = F.array_min(F.filter(cutoff_array(cutoffs), lambda c: c >= F.col("snapshot_dt")))
    order = F.struct("snapshot_dt", *[F.coalesce(F.col(c), F.lit("")) for c in DETAIL])
    return (
        snapshots.withColumn("cutoff_ts", filed)
        .groupBy("website_domain", "cutoff_ts")
        .agg(F.max_by(F.struct("snapshot_dt", *DETAIL), order).alias("latest"))
    )


def cutoff_rows(
    domains: DataFrame,
    snapshots: DataFrame,
    cutoffs: Sequence[str],
    lookback_days: int = 730,
    log: DataFrame | None = None,
) -> DataFrame:
    """One row per queued domain and cutoff: the chosen snapshot, a stale mark, or a miss.

    ``domains`` has distinct ``website_domain``; ``log`` optionally has one row per domain
    with ``cdx_http_status`` and ``error``, and an error marks all cutoffs of its domain.
    """
    queue = domains.select("website_domain")
    if log is None:
        log_cols = [F.lit(200).alias("cdx_http_status"), F.lit("").alias("error")]
        queue = queue.select("website_domain", *log_cols)
    else:
        queue = queue.join(log.select("website_domain", "cdx_http_status", "error"), "website_domain", "left")
    # at most one file per cutoff, kept as one array so the queue stays at one row per domain
    files = (
        latest_by_cutoff(snapshots, cutoffs)
        .groupBy("website_domain")
        .agg(F.collect_list(F.struct("cutoff_ts", "latest")).alias("_files"))
    )
    grid = (
        queue.join(files, "website_domain", "left")
        .withColumn("_any", F.col("_files").isNotNull())
        .withColumn("cutoff_ts", F.explode(cutoff_array(cutoffs)))
    )
    upto = F.filter("_files", lambda f: f["cutoff_ts"] <= F.col("cutoff_ts"))
    latest = F.array_max(F.transform(upto, lambda f: f["latest"]))
    grid = grid.withColumn("latest", latest).drop("_files")
    fresh = F.col("latest.snapshot_dt") >= F.col("cutoff_ts") - F.expr(f"INTERVAL {int(lookback_days)} DAYS")
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    outcome = (
        F.when(failed, "request_error")
        .when(F.coalesce(fresh, F.lit(False)), "archived_200")
        .when(F.col("latest").isNotNull(), "stale_snapshot")
        .otherwise("missing")
    )
    return proxy_rows(grid.withColumn("homepage_archive_status", outcome), lookback_days)


def proxy_rows(grid: DataFrame, lookback_days: int) -> DataFrame:
    """The uniform record for hits and misses. A miss always needs validation, and a code
    that is not a number becomes NULL."""
    status = F.col("homepage_archive_status")
    hit = status == "archived_200"
    reason = (
        F.when(hit, "")
        .when(status == "request_error", F.col("error"))
        .when(status == "stale_snapshot", f"no_snapshot_within_{int(lookback_days)}_days_before_cutoff")
        .when(F.col("_any"), "no_cdx_snapshot_before_cutoff")
        .otherwise("no_cdx_snapshot_in_query_window")
    )
    failure = (
        F.when(hit, "")
        .when(status == "request_error", "request_error")
        .when(status == "stale_snapshot", "stale_archive")
        .otherwise("no_archive_hit")
    )
    strength = F.when(hit, evidence_strength(F.col("latest.mimetype"))).otherwise("none")
    code = F.when(F.col("latest.statuscode").rlike("^[0-9]+$"), F.col("latest.statuscode").try_cast("int"))

    def shown(field: str) -> Column:
        return F.when(hit, F.coalesce(F.col(f"latest.{field}"), F.lit(""))).otherwise("")

    return grid.select(
        "website_domain",
        F.col("cutoff_ts").cast("date").alias("cutoff_date"),
        listing_url(F.col("website_domain")).alias("source_url"),
        "homepage_archive_status",
        shown("timestamp").alias("snapshot_timestamp"),
        F.when(hit, code).alias("http_status"),
        shown("original").alias("final_url"),
        reason.alias("failure_reason"),
        F.lit("wayback_cdx_list").alias("archive_method"),
        strength.alias("evidence_strength"),
        failure.alias("failure_class"),
        F.lit("homepage_or_domain_prefix").alias("evidence_scope"),
        (strength != "strong").alias("needs_homepage_validation"),
        F.coalesce(F.col("cdx_http_status"), F.lit(0)).alias("cdx_http_status"),
        F.when(hit, F.col("latest.mimetype")).alias("mimetype"),
        F.when(hit, F.col("latest.digest")).alias("digest"),
    )


def crawl_summary(rows: DataFrame) -> DataFrame:
    hit = F.col("homepage_archive_status") == "archived_200"
    return rows.groupBy("cutoff_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("archived_200_rows"), F.count_if(~hit).alias("missing_rows")
    )


def domain_queue(companies: DataFrame) -> DataFrame:
    """Distinct usable domains in order."""
    from tidemark.functions.text import domain_key

    queue = (
        companies.select(domain_key(F.col("website")).alias("website_domain"))
        .filter(F.col("website_domain") != "")
        .distinct()
    )
    return queue.orderBy("website_domain")


def domains_done(rows: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Domains with a row for each of the cutoffs; rows for others do not count, error rows
    do."""
    wanted = rows.filter(F.col("cutoff_date").cast("date").isin([F.lit(c).cast("date") for c in cutoffs]))
    counted = wanted.groupBy("website_domain").agg(F.countDistinct("cutoff_date").alias("n"))
    return counted.filter(F.col("n") == len(set(cutoffs))).select("website_domain")


def domains_to_do(queue: DataFrame, rows: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    return queue.join(domains_done(rows, cutoffs), "website_domain", "left_anti")


def activity_by_period(
    rows: DataFrame, domain_map: DataFrame, entity: str, unit: str = "quarter", domain: Column | None = None
) -> DataFrame:
    """Homepage activity per (entity, period): any live domain, and how many source rows.
    Rows are reduced per (domain, period) before they meet the entities of the domain."""
    from tidemark.functions.periods import period_index
    from tidemark.functions.scores import homepage_active
    from tidemark.functions.text import domain_key
    from tidemark.operators.skew import fan_join

    key = domain_key(F.col("website_domain")) if domain is None else domain
    active = homepage_active(
        F.col("homepage_archive_status"), F.col("evidence_strength"), F.col("failure_class"), F.col("http_status")
    )
    per_domain = (
        rows.select(
            key.alias("website_domain"),
            period_index(F.col("cutoff_date"), unit).alias("fact_period"),
            active.alias("active"),
        )
        .filter((F.col("website_domain") != "") & F.col("fact_period").isNotNull())
        .groupBy("website_domain", "fact_period")
        .agg(F.max("active").alias("active"), F.count(F.lit(1)).alias("source_rows"))
    )
    joined = fan_join(domain_map, per_domain, ["website_domain"], [entity], domain_map.count())
    return joined.groupBy(entity, "fact_period").agg(
        F.max("active").alias("cc_active_at_cutoff"), F.sum("source_rows").alias("cc_source_rows")
    )
