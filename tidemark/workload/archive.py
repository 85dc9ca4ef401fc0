"""Archive snapshots: listings, cutoffs, crawl reports and the file tree."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators import matching
from tidemark.operators import snapshot_asof as A
from tidemark.sources import proxy, snapshots, tabular
from tidemark.sources.sinks import cut, stage_root, write_table
from tidemark.workload import sql as S
from tidemark.workload import standins as D

E = "company_uuid"
DAY = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
DAY_SQL = "strftime(cutoff_date, '%Y-%m-%d') AS cutoff_date"


def _days(df):
    """Dates as text, so that any client shows them alike."""
    return df.withColumn("cutoff_date", DAY("cutoff_date"))


def parse_listings(spark, sf):
    return D.snapshots(spark, sf).select(
        "website_domain", "timestamp", "original", "statuscode", "mimetype", "digest",
        F.date_format("snapshot_dt", "yyyy-MM-dd HH:mm:ss").alias("snapshot_dt"),
    )


PARSE_LISTINGS = f"""WITH {S.SNAPSHOTS} SELECT website_domain, "timestamp", original, '200' AS statuscode, mimetype, digest, strftime(dt, '%Y-%m-%d %H:%M:%S') AS snapshot_dt FROM snaps"""


def query_log(spark, sf):
    return snapshots.query_log(D.listings(spark, sf)).drop("source_url")


QUERY_LOG = f"""SELECT {S.domain('url')} AS website_domain, 200 AS cdx_http_status, 1 AS snapshot_rows, '' AS error, false AS truncated FROM pages"""


def cutoff_rows(spark, sf):
    return _days(D.homepage_rows(spark, sf).drop("source_url"))


CUTOFF_ROWS = f"""WITH {S.SNAPSHOTS} SELECT website_domain, {DAY_SQL}, status AS homepage_archive_status, snapshot_timestamp, http_status,
  final_url, CASE status WHEN 'archived_200' THEN '' WHEN 'stale_snapshot' THEN 'no_snapshot_within_730_days_before_cutoff'
    ELSE 'no_cdx_snapshot_before_cutoff' END AS failure_reason, 'wayback_cdx_list' AS archive_method, strength AS evidence_strength,
  CASE status WHEN 'archived_200' THEN '' WHEN 'stale_snapshot' THEN 'stale_archive' ELSE 'no_archive_hit' END AS failure_class,
  'homepage_or_domain_prefix' AS evidence_scope, strength <> 'strong' AS needs_homepage_validation, 200 AS cdx_http_status, mimetype, digest FROM proxy"""


def crawl_summary(spark, sf):
    return _days(A.crawl_summary(D.homepage_rows(spark, sf)))


CRAWL_SUMMARY = f"""WITH {S.SNAPSHOTS} SELECT {DAY_SQL}, count(*)::BIGINT AS rows, count(*) FILTER (WHERE status = 'archived_200')::BIGINT AS archived_200_rows,
  count(*) FILTER (WHERE status <> 'archived_200')::BIGINT AS missing_rows FROM proxy GROUP BY 1"""


def conformance(spark, sf):
    """The rows as two proxy files, of which that of the even years lacks a column."""
    root = posixpath.join(stage_root(spark), "conformance-" + uuid.uuid4().hex)
    rows = D.homepage_rows(spark, sf)
    even = F.year(F.col("cutoff_date").cast("date")) % 2 == 0
    for name, part in (("even", rows.filter(even).drop("final_url")), ("odd", rows.filter(~even))):
        part.write.parquet(posixpath.join(root, name, f"{proxy.FILE_STEM}.parquet"))
    read = proxy.read_proxy_files(spark, proxy.proxy_files(spark, [root]))
    c = proxy.conformance(read.withColumn("cutoff_date", F.col("cutoff_date").cast("date")), "cutoff_date")
    return _days(c.withColumn("archived_200_share", F.round("archived_200_share", 8)))


CONFORMANCE = f"""WITH {S.SNAPSHOTS} SELECT {DAY_SQL}, count(*)::BIGINT AS rows, CASE WHEN year(any_value(proxy.cutoff_date)) % 2 = 0 THEN 'final_url' ELSE '' END AS missing_required_columns,
  count(DISTINCT website_domain)::BIGINT AS unique_domains, round(avg((status = 'archived_200')::INTEGER), 8) AS archived_200_share FROM proxy GROUP BY 1"""


def homepage_flags(spark, sf):
    rows = D.homepage_rows(spark, sf)
    flag = scores.homepage_active(
        F.col("homepage_archive_status"), F.col("evidence_strength"), F.col("failure_class"), F.col("http_status")
    )
    return rows.select("website_domain", DAY("cutoff_date"), flag.alias("active"), scores.evidence_strength(F.col("mimetype")).alias("by_type"))


HOMEPAGE_FLAGS = f"""WITH {S.SNAPSHOTS} SELECT website_domain, {DAY_SQL}, (status = 'archived_200')::INTEGER AS active,
  CASE WHEN coalesce(starts_with(mimetype, 'text/html'), false) THEN 'strong' ELSE 'medium' END AS by_type FROM proxy"""


def domain_queue(spark, sf):
    return A.domain_queue(D.companies(spark, sf))


DOMAIN_QUEUE = f"""WITH {S.COMPANIES} SELECT DISTINCT {S.domain('website')} AS website_domain FROM companies WHERE {S.domain('website')} <> ''"""


def domains_to_do(spark, sf):
    """If cutoffs without any snapshot had been left out, which domains would lack rows."""
    finished = D.homepage_rows(spark, sf).filter(F.col("homepage_archive_status") != "missing")
    return A.domains_to_do(D.page_domains(spark, sf), finished, D.CUTOFFS)


DOMAINS_TO_DO = f"""WITH {S.SNAPSHOTS} SELECT website_domain FROM doms WHERE website_domain NOT IN (
  SELECT website_domain FROM proxy WHERE status <> 'missing' GROUP BY 1 HAVING count(DISTINCT cutoff_date) = 14)"""


def _tree(spark, sf):
    """Proxy files without their cutoff column, one folder per cutoff, as a crawl leaves
    them; the first half of the cutoffs as CSV."""
    root = posixpath.join(stage_root(spark), "proxy-tree-" + uuid.uuid4().hex)
    stamped = D.homepage_rows(spark, sf).withColumn("stamp", F.date_format("cutoff_date", "yyyy-MM-dd"))
    rows = cut(stamped, "crawl-rows")
    for i, cutoff in enumerate(D.CUTOFFS):
        fmt = "csv" if i < len(D.CUTOFFS) // 2 else "parquet"
        part = rows.filter(F.col("stamp") == cutoff).drop("cutoff_date", "stamp")
        write_table(part, f"{root}/cutoff={cutoff}_crawl=wayback_cdx/{proxy.FILE_STEM}.{fmt}", fmt)
    return root


def proxy_files(spark, sf):
    root = _tree(spark, sf)
    rows = proxy.read_proxy_files(spark, proxy.proxy_files(spark, [root, root + "-absent"]))
    return rows.groupBy("cutoff_date").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("source_path").alias("files"), F.countDistinct("website_domain").alias("domains"),
        F.sum(F.col("http_status").try_cast("int")).alias("codes"),
    )


PROXY_FILES = f"""WITH {S.SNAPSHOTS} SELECT strftime(cutoff_date, '%Y-%m-%d') AS cutoff_date, count(*)::BIGINT AS rows, 1::BIGINT AS files,
  count(DISTINCT website_domain)::BIGINT AS domains, sum(http_status)::BIGINT AS codes FROM proxy GROUP BY 1"""


def source_audit(spark, sf):
    root = _tree(spark, sf)
    rows = proxy.read_proxy_files(spark, proxy.proxy_files(spark, [root]))
    audit = proxy.source_audit(rows, matching.domain_entities(D.companies(spark, sf), E), E)
    return audit.withColumn("cutoff", F.regexp_extract("source_path", "cutoff=([^_/]+)", 1)).drop("source_path")


SOURCE_AUDIT = f"""WITH {S.COMPANIES}, {S.SNAPSHOTS}, cdom AS (SELECT DISTINCT company_uuid, {S.domain('website')} AS website_domain FROM companies)
  SELECT strftime(cutoff_date, '%Y-%m-%d') AS cutoff, CASE WHEN year(cutoff_date) < 2017 THEN 'csv' ELSE 'parquet' END AS source_type,
  count(DISTINCT website_domain)::BIGINT AS rows_loaded, count(DISTINCT company_uuid)::BIGINT AS matched_companies,
  count(DISTINCT CASE WHEN company_uuid IS NOT NULL THEN website_domain END)::BIGINT AS matched_domains
  FROM proxy LEFT JOIN cdom USING (website_domain) GROUP BY 1, 2"""


def csv_round_trip(spark, sf):
    """Write a table as CSV, read it back through a contract that renames nothing, asks for
    one column the file lacks and leaves out another."""
    from pyspark.sql import types as T

    root = posixpath.join(stage_root(spark), "csv-" + uuid.uuid4().hex)
    write_table(D.table(spark, sf, "orders").drop("o_orderstatus"), root, "csv")
    wanted = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.TimestampNTZType()),
            T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_clerk", T.StringType()),
        ]
    )
    back = tabular.read_csv_optional(spark, root, wanted)
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


CSV_ROUND_TRIP = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_totalprice, NULL::VARCHAR AS o_clerk FROM orders"


QUERIES = {
    "S1_S7_csv_round_trip": (csv_round_trip, CSV_ROUND_TRIP),
    "S4_S5_S6_proxy_files": (proxy_files, PROXY_FILES),
    "S10_source_audit": (source_audit, SOURCE_AUDIT),
    "S11_crawl_summary": (crawl_summary, CRAWL_SUMMARY),
    "S12_conformance": (conformance, CONFORMANCE),
    "S13_parse_listings": (parse_listings, PARSE_LISTINGS),
    "ST2_query_log": (query_log, QUERY_LOG),
    "J11_F6_P24_P29_cutoff_rows": (cutoff_rows, CUTOFF_ROWS),
    "P18_homepage_flags": (homepage_flags, HOMEPAGE_FLAGS),
    "T8_domain_queue": (domain_queue, DOMAIN_QUEUE),
    "J15_T6_domains_to_do": (domains_to_do, DOMAINS_TO_DO),
}
