import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import proxy, sinks, snapshots, tabular
from tidemark.sources.contracts import TABLES, contract
from tidemark.streaming import ingest

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("d", T.TimestampNTZType())])


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_contracts_name_each_column_once():
    assert len(TABLES) == 8
    for table in TABLES:
        names = contract(table).fieldNames()
        assert len(names) == len(set(names)) > 3


def test_csv_optional(spark, tmp_path):
    missing = tabular.read_csv_optional(spark, str(tmp_path / "none.csv"), SCHEMA)
    assert missing.schema == SCHEMA and missing.count() == 0
    put(str(tmp_path / "x.csv"), 'extra,n,a\n1,2.5,"one\ntwo"\n2,bad,b\n')
    got = tabular.read_csv_optional(spark, str(tmp_path / "x.csv"), SCHEMA, line_breaks=True)
    assert got.columns == ["a", "n", "d"]
    assert sorted(map(tuple, got.collect())) == [("b", None, None), ("one\ntwo", 2.5, None)]


def test_csv_directory(spark, tmp_path):
    put(str(tmp_path / "p" / "1.csv"), "a,n\nx,1\n")
    put(str(tmp_path / "p" / "2.csv"), "d,a\n2011-01-01,y\n")
    all_parts = tabular.read_csv_directory(spark, str(tmp_path / "p"), SCHEMA)
    assert sorted(r.a for r in all_parts.collect()) == ["x", "y"]
    assert tabular.read_csv_directory(spark, str(tmp_path / "q"), SCHEMA).count() == 0


def test_failed_listings_are_errors(spark):
    rows = [("a.com", 503, None, ""), ("b.com", 200, "<html>", ""), ("c.com", 200, "[]", ""), ("d.com", 200, None, "timeout"), ("e.com", None, None, "")]
    log = snapshots.query_log(spark.createDataFrame(rows, snapshots.LISTING_SCHEMA))
    assert {r.website_domain: r.error for r in log.collect()} == {
        "a.com": "http_status_503", "b.com": "unreadable_listing", "c.com": "", "d.com": "timeout", "e.com": "",
    }


def test_stage_is_built_once_per_key(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for key in ("k1", "k1", "k2"):
        assert sinks.stage(spark, "t", key, build, root=str(tmp_path)).count() == 3
    assert len(calls) == 2


def test_crawl_tree_and_proxy_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.com", "2011-12-31", "archived_200"), ("b.com", "2012-12-31", "missing")], "website_domain string, cutoff_date string, homepage_archive_status string")
    mapping = rows.select("website_domain", F.lit("c1").alias("company_uuid"))
    sinks.write_crawl_tree(rows, mapping, str(tmp_path / "tree"))
    back = spark.read.parquet(str(tmp_path / "tree" / "proxy"))
    assert back.count() == 2 and "cutoff_date" in back.columns
    assert spark.read.parquet(str(tmp_path / "tree" / "domains")).count() == 2

    stem = "homepage_domain_archive_proxy"
    put(str(tmp_path / "r" / "cutoff=2011-12-31_crawl=x" / f"{stem}.csv"), "website_domain,http_status\na.com,200\nb.com,\n")
    put(str(tmp_path / "r" / "deep" / "cutoff=2012-12-31_crawl=x" / f"{stem}.csv"), "cutoff_date,website_domain\n2013-01-01,a.com\n,b.com\n")
    put(str(tmp_path / "r" / "deep" / "other.csv"), "website_domain\nz.com\n")
    files = proxy.proxy_files(spark, [str(tmp_path / "r"), str(tmp_path / "r" / "deep"), str(tmp_path / "absent")])
    assert len(files) == 2
    got = proxy.read_proxy_files(spark, files).select("website_domain", "cutoff_date", "http_status")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        ("a.com", "2011-12-31", "200"), ("b.com", "2011-12-31", None), ("a.com", "2013-01-01", None), ("b.com", None, None),
    ]))
    assert proxy.read_proxy_files(spark, []).count() == 0
    per_file = proxy.conformance(proxy.read_proxy_files(spark, files), "source_path", ["website_domain", "cutoff_date", "http_status"])
    assert sorted(r.missing_required_columns for r in per_file.collect()) == ["cutoff_date", "http_status"]
    report = proxy.conformance(rows, "cutoff_date").first()
    assert "http_status" in report.missing_required_columns and "website_domain" not in report.missing_required_columns


def listing(*stamps):
    return json.dumps([["timestamp", "original", "statuscode", "mimetype", "digest"], *[[s, "u", "200", "text/html", "d"] for s in stamps]])


def test_listings(spark):
    reordered = json.dumps([["digest", "timestamp"], ["d1", "20110101000000"], ["d2", "bad"]])
    df = spark.createDataFrame(
        [("a.com", 200, listing("20110101000000", "2011"), ""), ("b.com", 200, reordered, ""), ("c.com", 200, "[]", ""), ("d.com", 0, None, "timeout")],
        snapshots.LISTING_SCHEMA,
    )
    got = {(r.website_domain, r.timestamp, r.digest, r.original) for r in snapshots.parse_listings(df).collect()}
    assert got == {("a.com", "20110101000000", "d", "u"), ("b.com", "20110101000000", "d1", None)}
    log = {r.website_domain: (r.snapshot_rows, r.error) for r in snapshots.query_log(df).collect()}
    assert log == {"a.com": (1, ""), "b.com": (1, ""), "c.com": (0, ""), "d.com": (0, "timeout")}


def test_streamed_ingest_resumes_and_skips_finished_domains(spark, tmp_path):
    staged, out, ck = (str(tmp_path / n) for n in ("staged", "out", "ck"))

    def drop(name, *records):
        put(f"{staged}/{name}.json", "\n".join(json.dumps(dict(zip(["website_domain", "cdx_http_status", "payload", "error"], r))) for r in records))

    drop("1", ("a.com", 200, listing("20110601000000"), ""), ("b.com", 0, None, "timeout"))
    ingest.ingest_listings(spark, staged, out, ck)
    drop("2", ("a.com", 200, listing("20120601000000"), ""), ("c.com", 200, listing("20120601000000", "20120701000000"), ""))
    ingest.ingest_listings(spark, staged, out, ck)
    ingest.ingest_listings(spark, staged, out, ck)
    assert sorted(r.website_domain for r in ingest.taken_log(spark, out).collect()) == ["a.com", "b.com", "c.com"]
    assert sorted(r.timestamp for r in ingest.taken_snapshots(spark, out).collect()) == ["20110601000000", "20120601000000", "20120701000000"]
    final = {(r.website_domain, str(r.cutoff_date)): r.homepage_archive_status for r in ingest.rows_so_far(spark, out, ["2011-12-31", "2012-12-31"]).collect()}
    assert final == {
        ("a.com", "2011-12-31"): "archived_200", ("a.com", "2012-12-31"): "archived_200", ("b.com", "2011-12-31"): "request_error",
        ("b.com", "2012-12-31"): "request_error", ("c.com", "2011-12-31"): "missing", ("c.com", "2012-12-31"): "archived_200",
    }


def test_taken_domains_are_state_not_log(spark, tmp_path):
    """A batch does not read earlier ones: with another folder for its tables it still skips."""
    staged, out, later, ck = (str(tmp_path / n) for n in ("staged", "out", "later", "ck"))
    fields = ["website_domain", "cdx_http_status", "payload", "error"]

    def drop(name, *records):
        put(f"{staged}/{name}.json", "\n".join(json.dumps(dict(zip(fields, r))) for r in records))

    answers = [("a.com", 200, listing("20110601000000"), ""), ("a.com", 0, None, "timeout"), ("a.com", 200, None, "")]
    drop("1", *answers, *answers, (None, 200, "[]", ""), ("", 200, "[]", ""))
    ingest.ingest_listings(spark, staged, out, ck)
    log = {r.website_domain: (r.cdx_http_status, r.snapshot_rows, r.error) for r in ingest.taken_log(spark, out).collect()}
    assert log == {"a.com": (200, 1, ""), "": (200, 0, "")}
    before = spark.conf.get(ingest.STATE_STORE)
    drop("2", *answers, ("b.com", 200, listing("20120601000000"), None), ("b.com", 200, listing("20120601000000"), ""))
    ingest.ingest_listings(spark, staged, later, ck)
    assert spark.conf.get(ingest.STATE_STORE) == before
    assert [tuple(r)[:1] for r in ingest.taken_log(spark, later).collect()] == [("b.com",)]
    assert [r.timestamp for r in ingest.taken_snapshots(spark, later).collect()] == ["20120601000000"]
    with pytest.raises(ValueError, match="no progress"):
        ingest.ingest_listings(spark, staged, out, str(tmp_path / "other"))


def test_crawl_takes_up_where_it_stopped(spark, tmp_path):
    from tidemark.plans.crawl import build_proxy

    companies = spark.createDataFrame(
        [("c1", "http://a.com", None), ("c2", "www.a.com/x", None), ("c3", "b.com", None), ("c4", "none", None)],
        "company_uuid string, website string, founded_on timestamp_ntz",
    )
    schema = snapshots.LISTING_SCHEMA
    first = spark.createDataFrame([("a.com", 200, listing("20110601000000"), "")], schema)
    later = spark.createDataFrame([("a.com", 200, listing("20120601000000"), ""), ("b.com", 200, "[]", ""), ("z.com", 200, "[]", "")], schema)
    cutoffs = ["2011-12-31", "2014-12-31"]
    a = build_proxy(spark, companies, first, str(tmp_path / "t"), cutoffs)
    assert [r.website_domain for r in a.remaining.collect()] == ["b.com"]
    b = build_proxy(spark, companies, later, str(tmp_path / "t"), cutoffs)
    got = {(r.website_domain, str(r.cutoff_date)): r.homepage_archive_status for r in b.rows.collect()}
    assert got == {
        ("a.com", "2011-12-31"): "archived_200", ("a.com", "2014-12-31"): "stale_snapshot",
        ("b.com", "2011-12-31"): "missing", ("b.com", "2014-12-31"): "missing",
    }
    assert b.remaining.count() == 0
    # other cutoffs later: rows only for what is not there yet, none twice
    c = build_proxy(spark, companies, later, str(tmp_path / "t"), [*cutoffs, "2012-12-31"])
    again = build_proxy(spark, companies, later, str(tmp_path / "t"), cutoffs[:1])
    assert c.remaining.count() == 0 and again.remaining.count() == 0
    assert again.rows.count() == again.rows.select("website_domain", "cutoff_date").distinct().count() == 6
    assert {(str(r.cutoff_date), r.rows, r.archived_200_rows) for r in b.summary.collect()} == {("2011-12-31", 2, 1), ("2014-12-31", 2, 0)}
    assert {r.missing_required_columns for r in b.validation.collect()} == {""}
    assert spark.read.parquet(str(tmp_path / "t" / "domain_company_mapping")).count() == 3


def test_entry_points_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0


def test_a_listing_is_parsed_once_to_count_its_snapshots(spark):
    from tidemark.sources.snapshots import LISTING_SCHEMA, query_log

    payloads = ['[["timestamp"],["20200101000000"],["x"],null,["20210101000000"]]', '[["digest"],["a"]]', '[["timestamp"]]', "oops", "", None]
    rows = query_log(spark.createDataFrame([(str(i), 200, p, "") for i, p in enumerate(payloads)], LISTING_SCHEMA))
    assert [r.snapshot_rows for r in rows.orderBy("website_domain").collect()] == [2, 0, 0, 0, 0, 0]
    plan = rows.select("snapshot_rows")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def _shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {name for name in names if "shuffle_" in name}


def test_a_write_leaves_no_shuffle_files(spark):
    """Shuffles of a written table end with the write, not when the driver collects garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.range(1000).repartition(5).persist()
    assert kept.count() == 1000
    before, was = _shuffle_files(spark), spark.conf.get(setting, None)
    table = sinks.cut(spark.range(1000).repartition(7).groupBy((F.col("id") % 9).alias("k")).count(), "released")
    left = set()
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(setting, None) == was
    assert table.count() == 9 and kept.count() == 1000
    kept.unpersist()
