"""Archive snapshot listings: staged response files to rows, and the query URL as a column.

Nothing here opens a connection. Listings are fetched elsewhere and staged as files with
one row per domain: ``website_domain``, ``cdx_http_status``, ``error`` and the response
``payload`` (a JSON array of arrays whose first entry is the header).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTING_SCHEMA = "website_domain string, cdx_http_status int, payload string, error string"

# The listing query of the archive.
LISTING_BASE = "https://web.archive.org/cdx?"
LISTING_FIELDS = ["timestamp", "original", "statuscode", "mimetype", "digest"]
LISTING_FROM = "20100101000000"
LISTING_TO = "20231231235959"
LISTING_LIMIT = 5000


def listing_url(domain: Column) -> Column:
    """URL that lists the snapshots of a domain; lineage only."""
    fixed = [
        ("matchType", "prefix"),
        ("output", "json"),
        ("fl", ",".join(LISTING_FIELDS)),
        ("filter", "statuscode:200"),
        ("collapse", "timestamp:8"),
        ("from", LISTING_FROM),
        ("to", LISTING_TO),
        ("limit", str(LISTING_LIMIT)),
    ]
    tail = [F.concat(F.lit(f"&{name}="), F.url_encode(F.lit(value))) for name, value in fixed]
    return F.concat(F.lit(LISTING_BASE + "url="), F.url_encode(F.concat(domain, F.lit("/"))), *tail)


def snapshot_time(stamp: Column) -> Column:
    """``yyyyMMddHHmmss`` text as a timestamp, anything else as NULL."""
    digits = F.when(stamp.rlike("^[0-9]{14}$"), stamp)
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def parse_listings(listings: DataFrame) -> DataFrame:
    """One row per snapshot. The header row names the columns of the rows below it; rows
    whose timestamp does not parse are dropped."""
    grid = F.from_json("payload", "array<array<string>>")
    rows = listings.withColumn("_grid", grid).filter(F.size("_grid") > 1)
    flat = rows.select(
        "website_domain",
        F.col("_grid")[0].alias("_header"),
        F.explode(F.slice("_grid", 2, F.size("_grid") - 1)).alias("_row"),
    ).filter(F.col("_row").isNotNull())

    def field(name: str) -> Column:
        at = F.array_position("_header", name).cast("int")
        return F.when(at > 0, F.try_element_at("_row", at)).alias(name)

    named = flat.select("website_domain", *[field(name) for name in LISTING_FIELDS])
    return named.withColumn("snapshot_dt", snapshot_time(F.col("timestamp"))).filter(F.col("snapshot_dt").isNotNull())


def listing_error() -> Column:
    """What is wrong with a response: the stated error, a status that is not a success, or a
    body that is not a listing. Empty for a listing, also for one without snapshots."""
    status, body = F.col("cdx_http_status"), F.trim(F.coalesce("payload", F.lit("")))
    failed = status.isNotNull() & ~status.between(200, 299)
    grid = F.from_json("payload", "array<array<string>>")
    return (
        F.when(F.coalesce("error", F.lit("")) != "", F.col("error"))
        .when(failed, F.concat(F.lit("http_status_"), status.cast("string")))
        .when((body != "") & grid.isNull(), "unreadable_listing")
        .otherwise("")
    )


def query_log(listings: DataFrame) -> DataFrame:
    """One row per queried domain: status, usable snapshots in the response, whether the
    listing reached its limit and so may lack snapshots, error."""
    grid = F.from_json("payload", "array<array<string>>")

    def usable(grid: Column) -> Column:
        at = F.array_position(grid[0], "timestamp").cast("int")
        return F.filter(
            F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))),
            lambda row: (at > 0) & snapshot_time(F.try_element_at(row, F.greatest(at, F.lit(1)))).isNotNull(),
        )

    # The parsed listing is bound once: an expression over it would parse it again per row.
    counted = F.transform(F.array(grid), lambda g: F.when(F.size(g) > 1, F.size(usable(g))).otherwise(0))[0]
    return listings.select(
        "website_domain",
        listing_url(F.col("website_domain")).alias("source_url"),
        F.coalesce("cdx_http_status", F.lit(0)).alias("cdx_http_status"),
        counted.alias("snapshot_rows"),
        listing_error().alias("error"),
        (F.coalesce(F.size(grid), F.lit(0)) > LISTING_LIMIT).alias("truncated"),
    )
