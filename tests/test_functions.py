import pytest
from pyspark.sql import functions as F

from tidemark.functions import nulls, periods, scores, text


def values(spark, cells, col, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    return [r[0] for r in df.select(col.alias("v"), "i").orderBy("i").select("v").collect()]


def test_tolerant_timestamps_and_numbers(spark):
    got = values(
        spark, ["2010-12-31", "2010-12-31T23:30:00+02:00", "bad", "", None],
        F.date_format(nulls.to_timestamp_utc(F.col("x")), "yyyy-MM-dd HH:mm"),
    )
    assert got == ["2010-12-31 00:00", "2010-12-31 21:30", None, None, None]
    assert values(spark, ["1e3", "x", "NaN", None, "7"], nulls.to_number(F.col("x"))) == [1000.0, None, None, None, 7.0]


def test_quarters(spark):
    assert periods.parse_quarter("2018Q4") == 8075
    with pytest.raises(ValueError):
        periods.parse_quarter("2018Q5")
    idx = periods.period_index(F.col("x").cast("date"))
    assert values(spark, ["2018-12-31", "2018-01-01", None], idx) == [8075, 8072, None]
    assert values(spark, [8075, 8072], periods.quarter_label(F.col("x")), "int") == ["2018Q4", "2018Q1"]
    assert values(spark, ["2018Q4", None], periods.quarter_from_label(F.col("x"))) == [8075, None]
    with pytest.raises(Exception, match="not a quarter label"):
        values(spark, ["2018Q5"], periods.quarter_from_label(F.col("x")))


def test_domains(spark):
    cells = ["HTTPS://www.A.com/x?y", "a.com:80", "localhost", "a.com?x", None, "  http://b.org ", ""]
    assert values(spark, cells, text.domain_key(F.col("x"))) == ["a.com", "a.com", "", "a.com", "", "b.org", ""]
    assert values(spark, cells, text.domain_key(F.col("x"), strict=False)) == [
        "a.com", "a.com:80", "localhost", "a.com", "", "b.org", "",
    ]


def test_names(spark):
    cells = ["A&B Co., Inc.", "Inc", None, "Société Générale SA", "Incline  Data"]
    assert values(spark, cells, text.name_key(F.col("x"))) == ["a and b", "", "", "soci t g n rale", "incline data"]


def test_buckets(spark):
    cells = ["health software", "BioTech", "lending club", "carbon", None, "shoes", "AI tools"]
    assert values(spark, cells, text.sector_bucket(F.col("x"))) == [
        "software", "healthcare", "financial", "energy", "other", "other", "software",
    ]
    stages = ["Pre-Seed", "private_equity", None, "Series B", "series_a", "buyout", "angel"]
    assert values(spark, stages, text.stage_bucket(F.col("x"))) == [
        "seed", "growth", "unknown", "series_b", "series_a", "buyout", "seed",
    ]


def test_country_keys(spark):
    assert values(spark, [" US ", None], text.country_key(F.col("x"))) == ["us", None]
    assert values(spark, [" US ", None], text.country_key(F.col("x"), missing_matches=True)) == ["us", "nan"]


@pytest.mark.parametrize(
    ("status", "strength", "failure", "http", "want"),
    [
        ("not_found", None, None, 404, 0), ("inactive", None, None, None, 0), ("archived_200", None, None, None, 1),
        ("stale_snapshot", "none", "stale_archive", None, 0), ("x", None, None, 399, 1), ("x", None, None, 400, 0),
        ("x", "strong", "none", None, 1), ("x", "strong", "timeout", None, 0), ("x", "strong", None, None, 1),
    ],
)
def test_homepage_active(spark, status, strength, failure, http, want):
    df = spark.createDataFrame([(status, strength, failure, http)], "a string, b string, c string, d int")
    assert df.select(scores.homepage_active(*map(F.col, "abcd"))).first()[0] == want


def test_guards(spark):
    assert values(spark, [-1.0, None, 0.0], nulls.log1p_clip(F.col("x")), "double") == [0.0, 0.0, 0.0]
    assert values(spark, [-1.0, None], nulls.log1p_keep_null(F.col("x")), "double") == [0.0, None]
    assert values(spark, [2.0, 0.0, None], nulls.ratio(F.lit(1), F.col("x")), "double") == [0.5, None, None]
    assert values(spark, [3, 9, None], nulls.elapsed(F.lit(5), F.col("x")), "int") == [2, 0, None]


def test_percent_text(spark):
    assert values(spark, [0.298, None, -0.01], text.percent(F.col("x")), "double") == ["29.80%", "", "-1.00%"]
    assert values(spark, [0.0], text.percent(F.col("x"), signed=True), "double") == ["+0.00%"]
    assert values(spark, [0.01, None], text.percent_interval(F.col("x"), F.col("x") * 2), "double") == ["[+1.00%, +2.00%]", "--"]


def test_placebo_depends_on_key_alone(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("e"), (F.col("id") % 7).alias("q"))
    noise = scores.noise_placebo(F.col("e"), F.col("q")).alias("z")
    a = {(r.e, r.q): r.z for r in df.select("e", "q", noise).collect()}
    b = {(r.e, r.q): r.z for r in df.repartition(13).select("e", "q", noise).collect()}
    assert a == b
    mean = sum(a.values()) / len(a)
    assert abs(mean) < 0.1 and 0.9 < sum(v * v for v in a.values()) / len(a) < 1.1
