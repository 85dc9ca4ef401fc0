import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import PanelSpec, SplitSpec
from tidemark.operators import asof, gates, labels, matching, metrics, ordered, prefix, rank_ic, ranking, runs, sampling, skew, spine
from tidemark.operators.snapshot_asof import cutoff_rows

SPEC = PanelSpec(window_start=10, splits=SplitSpec(20, 24, 28), entity="e", period="q", label="y", horizon=8)
DAY = lambda s: dt.datetime.strptime(s, "%Y-%m-%d")


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def test_first_round_takes_each_column_from_its_first_known_row(spark):
    r = spark.createDataFrame(
        [("a", DAY("2010-01-01"), "Seed", None, 1.0), ("a", DAY("2011-01-01"), "A", 5.0, 2.0), (None, DAY("2011-01-01"), "A", 5.0, 2.0), ("b", None, "A", 5.0, 2.0)],
        "company_uuid string, announced_on timestamp_ntz, investment_type string, money_raised_usd double, num_investors double",
    )
    assert rows(ordered.first_round(r)) == [("a", DAY("2010-01-01"), "Seed", 5.0, 1.0)]


def test_first_exit_prefers_route_then_later_value(spark):
    schema = "e string, d timestamp_ntz, v double"
    mna = spark.createDataFrame([("a", DAY("2012-05-01"), 7.0), ("b", DAY("2012-05-01"), 9.0)], schema)
    ipo = spark.createDataFrame([("a", DAY("2012-05-01"), None)], schema)
    sold = spark.createDataFrame([("b", DAY("2011-05-01"), 1.0)], schema)
    events = labels.exit_events(
        [labels.ExitSource(mna, "mna", "e", "d", "v"), labels.ExitSource(ipo, "ipo", "e", "d", "v"), labels.ExitSource(sold, "sponsor_sale", "e", "d")],
        SPEC,
    )
    got = labels.first_exit(events, SPEC).select("e", "route_label", "event_value_usd", "exit_q")
    assert rows(got, "e") == [("a", "ipo", 7.0, 2012 * 4 + 1), ("b", "sponsor_sale", 9.0, 2011 * 4 + 1)]


def test_horizon_is_open_below_and_closed_above(spark):
    df = spark.createDataFrame([(10,), (11,), (18,), (19,), (None,)], "x int")
    got = [r[0] for r in df.select(labels.within_horizon(F.col("x"), F.lit(10), 8)).collect()]
    assert got == [0, 1, 1, 0, 0]


def test_risk_interval_and_spine(spark):
    base = spark.createDataFrame(
        [("early", 1, 9), ("at_start", 1, 10), ("one", 1, 11), ("never", 1, None), ("late", 30, None)], "e string, entry_q int, exit_q int"
    )
    risk = spine.at_risk(base, 12, SPEC)
    assert rows(risk.select("e", "panel_start", "panel_end"), "e") == [("never", 10, 12), ("one", 10, 10)]
    assert rows(spine.panel_spine(risk, SPEC).select("e", "q"), "e", "q") == [("never", 10), ("never", 11), ("never", 12), ("one", 10)]


def test_asof_modes_differ_before_the_first_row(spark):
    base = spark.createDataFrame([("a", 10, 13, "x")], "e string, panel_start int, panel_end int, note string")
    facts = spark.createDataFrame([("a", 7, 1, 3.0), ("a", 10, 1, None), ("a", 11, 2, 5.0), ("b", 9, 1, 1.0)], "e string, fact_period int, n int, v double")

    def run(mode):
        return rows(asof.asof_panel(base, [asof.FactBlock(facts, {"n": "total"}, ["v"])], "e", "q", 1, mode).select("q", "total", "v", "note"), "q")

    assert run("full_history") == [(10, 1, 3.0, "x"), (11, 2, 3.0, "x"), (12, 4, 5.0, "x"), (13, 4, 5.0, "x")]
    assert run("panel_only") == [(10, None, None, "x"), (11, 2, None, "x"), (12, 4, 5.0, "x"), (13, 4, 5.0, "x")]


def test_runs(spark):
    data = [("a", i, v) for i, v in enumerate([1, 1, 0, None, 0, 1])]
    got = runs.activity_runs(spark.createDataFrame(data, "e string, p int, on int"), "e", "p", "on")
    assert [r[:3] for r in rows(got.select("p", "cc_presence_streak", "cc_decay_transition_flag", "first_active_q"), "p")] == [
        (0, 1, 0), (1, 2, 0), (2, 0, 1), (3, 0, 0), (4, 0, 0), (5, 1, 0),
    ]


@pytest.fixture(scope="module")
def linked(spark):
    """A hot domain, a common name, copies, a deal listed under two names and two domains,
    blank keys and unknown countries."""
    rng = random.Random(1)
    companies = [(f"c{i}", rng.choice(["Acme Inc", "Beta", "Gamma", None]), rng.choice(["hot.com", "hot.com", "b.com", "", None]), rng.choice(["US", "de", None])) for i in range(60)]
    deals = []
    for i in range(150):
        date = rng.choice(["2011-02-01", "2011-03-05", "2012-07-01", None])
        deals.append((
            f"p{rng.randrange(12)}", date, rng.choice(["ACME", "beta co", "Gamma", ""]), rng.choice(["http://www.hot.com/x", "b.com", None]),
            rng.choice(["us", "DE", None]), rng.choice([None, 1.0, 2.0]), rng.choice(["vc", "buyout"]),
        ))
    c = spark.createDataFrame(companies, "company_uuid string, name string, website string, hq_country string")
    d = spark.createDataFrame(deals, "portfolio_company_id string, d string, portfolio_company_name string, portfolio_company_website string, portfolio_company_country string, size double, kind string")
    d = d.withColumn("deal_date", F.col("d").cast("timestamp_ntz"))
    vc = d.filter("kind = 'vc'").withColumn("deal_financing_size_usd", F.col("size"))
    bo = d.filter("kind = 'buyout'").withColumns({"deal_size_usd": F.col("size"), "enterprisevalue": F.col("size") * 10})
    return c, matching.unified_deals(vc, bo)

def _pairs(entities, deals):
    """Every (entity, deal) pair; what the operators must agree with without building it."""
    out = []
    for keys, method in ((matching.DOMAIN_KEY, "domain"), (matching.NAME_KEY, "normalized_name_country")):
        right = matching.usable(matching.require_keys(deals, "portfolio_company_id"), keys)
        right = right.drop(*[c for c in matching.FULL_KEY if c not in keys])
        out.append(matching.usable(entities, keys).select("company_uuid", *keys).join(right, keys).withColumn("match_method", F.lit(method)))
    return out[0].unionByName(out[1], allowMissingColumns=True)



@pytest.mark.parametrize("missing_country", [False, True])
def test_sums_over_keys_equal_sums_over_pairs(spark, linked, missing_country):
    companies, deals = linked
    e = matching.entity_keys(companies, match_missing_country=missing_country)
    d = matching.deal_keys(deals, missing_country)
    ledger = matching.deal_ledger(d)
    pairs = _pairs(e, d).toPandas()
    assert (pairs.match_method == "normalized_name_country").any() and (pairs.match_method == "domain").any()

    first = {r.company_uuid: r for r in matching.crosswalk_first(e, ledger).collect()}
    assert set(first) == set(pairs.company_uuid)
    for uuid, group in pairs.groupby("company_uuid"):
        assert first[uuid].preqin_deal_count_total == len(group)
        assert first[uuid].match_methods == "|".join(sorted(set(group.match_method)))
        assert first[uuid].first_preqin_deal_date == group.deal_date.min()

    once = pairs[pairs.deal_date.notna()].copy()
    once["size"] = once.preqin_deal_size_usd.fillna(0)
    once["q"] = once.deal_date.dt.year * 4 + once.deal_date.dt.quarter - 1
    once = once.drop_duplicates(["company_uuid", "portfolio_company_id", "deal_date", "preqin_deal_source", "size"])
    want = {(u, q): (len(g), g["size"].sum()) for (u, q), g in once.groupby(["company_uuid", "q"])}
    got = {(r.company_uuid, r.fact_period): (r.preqin_deals_in_q, r.preqin_deal_size_in_q) for r in matching.deals_by_period(e, ledger).collect()}
    assert got == want
    assert matching.listed_twice(ledger).count() > 0

    report = matching.fan_out(e, ledger, matching.DOMAIN_KEY).agg(F.sum("pairs")).first()[0]
    assert report == (pairs.match_method == "domain").sum()


def test_unknown_countries_match_only_on_request(spark):
    c = spark.createDataFrame([("a", "Acme", None, None)], "company_uuid string, name string, website string, hq_country string")
    d = spark.createDataFrame(
        [("p", "acme", None, None, DAY("2011-01-01"), "vc", 1.0, None)],
        "portfolio_company_id string, portfolio_company_name string, portfolio_company_website string, portfolio_company_country string,"
        " deal_date timestamp_ntz, preqin_deal_source string, preqin_deal_size_usd double, enterprisevalue double",
    )
    for flag, want in ((False, 0), (True, 1)):
        e, k = matching.entity_keys(c, match_missing_country=flag), matching.deal_keys(d, flag)
        assert matching.crosswalk_first(e, matching.deal_ledger(k)).count() == want


def test_spread_join_and_top_k_with_a_hot_key(spark):
    left = spark.range(3000).select(F.col("id").alias("r"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("int").alias("k"))
    right = spark.range(400).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        assert rows(skew.spread_join(left, right, ["k"], ["r"], how, per_salt=50, limit=3)) == rows(left.join(right, "k", how).select("k", "r", "v"))
    blank = left.withColumn("k", F.when(F.col("r") % 10 == 0, F.col("k")))
    assert rows(skew.spread_join(blank, right, ["k"], ["r"], "left", per_salt=50)) == rows(blank.join(right, "k", "left").select("k", "r", "v"))
    counted = blank.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert rows(skew.spread_join(blank, right, ["k"], ["r"], "left", per_salt=50, counted=counted)) == rows(blank.join(right, "k", "left").select("k", "r", "v"))
    got = skew.top_k(left, ["k"], 4, [F.desc("r")], ["r"], salts=6)
    want = {}
    for r, k in sorted(((r.r, r.k) for r in left.collect()), reverse=True):
        want.setdefault(k, []).append(r)
    assert {(r.k, r.top_rank): r.r for r in got.collect()} == {(k, i + 1): r for k, rs in want.items() for i, r in enumerate(rs[:4])}


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    data = [(f"e{i % 90}", i, int(rng.random() < 0.3), rng.choice(["m1", "m2"]), "v", 0.5 if rng.random() < 0.4 else round(rng.random(), 2)) for i in range(1500)]
    return spark.createDataFrame(data, "e string, q int, y int, model string, variant string, score double").cache(), data


def test_prefix_and_positions_with_a_heavy_tie(spark, scored):
    df, data = scored
    for ranges in (1, 7, 64):
        got = {(r.model, r.score): (r.n, r.n_before, r.n_total) for r in prefix.value_prefix(df, "score", ["model"], ranges=ranges).collect()}
        for m in ("m1", "m2"):
            mine = [d[5] for d in data if d[3] == m]
            for s in set(mine):
                assert got[m, s] == (mine.count(s), sum(v < s for v in mine), len(mine))
        numbered = prefix.row_positions(df, "score", ["e", "q"], ["model"], ranges).collect()
        for m in ("m1", "m2"):
            ordered_rows = sorted((r.position, r.score) for r in numbered if r.model == m)
            assert [p for p, _ in ordered_rows] == list(range(1, len(ordered_rows) + 1))
            assert [s for _, s in ordered_rows] == sorted(s for _, s in ordered_rows)


def test_equal_count_bins_follow_the_quantile_edges(spark):
    def bins(n, k):
        df = spark.range(1, n + 1).select(ranking.equal_count_bin(F.col("id"), F.lit(n), k).alias("b"))
        return [r.b for r in df.collect()]

    assert sorted(bins(11, 10)) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert bins(1, 10) == [0]
    assert len(set(bins(4, 10))) == 4


def test_metrics_against_direct_formulas(spark, scored):
    df, data = scored
    got = {r.model: r for r in metrics.metric_rows(df, "y", ["e", "q"], ks=(100, 500)).collect()}
    for m in ("m1", "m2"):
        mine = [(d[5], d[2]) for d in data if d[3] == m]
        pos, neg = [s for s, y in mine if y], [s for s, y in mine if not y]
        auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        ap, seen = 0.0, 0
        for s in sorted({s for s, _ in mine}, reverse=True):
            here = sum(y for v, y in mine if v == s)
            seen += here
            ap += here / len(pos) * seen / sum(v >= s for v, _ in mine)
        row = got[m]
        assert row.roc_auc == pytest.approx(auc, abs=1e-12)
        assert row.pr_auc == pytest.approx(ap, abs=1e-12)
        assert row.brier == pytest.approx(sum((s - y) ** 2 for s, y in mine) / len(mine))
        top = sorted((d for d in data if d[3] == m), key=lambda d: (-d[5], d[0], d[1]))[:100]
        assert row.precision_at_100 == pytest.approx(sum(d[2] for d in top) / 100)
        gap = abs(sum(s for s, _ in mine) / len(mine) - sum(y for _, y in mine) / len(mine))
        assert row.ece >= gap - 1e-12
        assert row.f1 == pytest.approx(2 * row.precision * row.recall / (row.precision + row.recall))


def test_one_class_and_thresholds(spark):
    df = spark.createDataFrame([("m", "v", "a", i, 0, i / 10) for i in range(10)], "model string, variant string, e string, q int, y int, score double")
    p = metrics.score_prefix(df, "y")
    assert metrics.rank_quality(p).select("pr_auc", "roc_auc").first() == (None, None)
    above = metrics.threshold_quality(p, threshold=2.0).first()
    assert (above.precision, above.recall, above.f1, above.accuracy) == (0.0, 0.0, 0.0, 1.0)
    assert metrics.threshold_quality(p, threshold=0.5).first().accuracy == 0.5


def test_bootstrap_widens_until_it_fills(spark, scored):
    df, _ = scored
    pred = df.drop("variant").withColumn("variant", F.explode(F.array(F.lit("baseline"), F.lit("other"))))
    reps = gates.bootstrap_precision(pred, "y", ["e", "q"], k=50, n_boot=20)
    deltas = gates.bootstrap_deltas(reps).collect()
    assert len(deltas) == 2 and all(r.delta_vs_baseline == r.ci_low == r.ci_high == 0.0 for r in deltas)
    narrow = gates.bootstrap_precision(pred, "y", ["e", "q"], k=50, n_boot=20, margin=0)
    assert rows(narrow) == rows(reps)


def test_gates_and_placebo_guard(spark):
    m = spark.createDataFrame(
        [("m", "baseline", 0.3, 0.1, 0.05), ("m", "good", 0.5, 0.1, 0.05), ("m", "miscalibrated", 0.5, 0.2, 0.05), ("m", gates.PLACEBO, 0.3, 0.1, 0.05)],
        "model string, variant string, precision_at_500 double, brier double, ece double",
    )
    d = spark.createDataFrame(
        [("m", "good", 0.2, 0.1, 0.3), ("m", "miscalibrated", 0.2, 0.1, 0.3), ("m", gates.PLACEBO, 0.0, -0.1, 0.1)],
        "model string, variant string, delta_vs_baseline double, ci_low double, ci_high double",
    )
    g = gates.promotion_gates(m, d)
    assert {r.variant: r.promotion_pass for r in g.collect()} == {"baseline": 0, "good": 1, "miscalibrated": 0, gates.PLACEBO: 0}
    gates.placebo_guard(g)
    with pytest.raises(RuntimeError):
        gates.placebo_guard(g.withColumn("promotion_pass", F.lit(1)))


def test_capped_rows_have_the_exact_size(spark, scored):
    df, data = scored
    events = sum(d[2] for d in data)
    a = sampling.cap_training_rows(df, "y", ["e", "q"], max_rows=600)
    assert sorted(r[0] for r in a.select("y").collect()).count(1) == min(events, 300) and a.count() == 600
    b = sampling.cap_training_rows(df.repartition(11), "y", ["e", "q"], max_rows=600)
    assert rows(a.select("e", "q")) == rows(b.select("e", "q"))
    assert sampling.quota(5, 0, 3) == {1: 3, 0: 0} and sampling.quota(10, 10, 30) == {1: 10, 0: 10} and sampling.quota(100, 10, 50) == {1: 25, 0: 10}


def test_snapshot_window_edges(spark):
    cut = "2015-12-31"
    stamps = {
        "midnight": "2015-12-31 00:00:00", "later_that_day": "2015-12-31 00:00:01", "oldest": "2013-12-31 00:00:00",
        "too_old": "2013-12-30 23:59:59", "after": "2016-02-01 00:00:00",
    }
    snaps = spark.createDataFrame(
        [(k, v.replace("-", "").replace(" ", "").replace(":", ""), "u", "200", "text/html", "d", dt.datetime.fromisoformat(v)) for k, v in stamps.items()],
        "website_domain string, timestamp string, original string, statuscode string, mimetype string, digest string, snapshot_dt timestamp_ntz",
    )
    domains = spark.createDataFrame([(k,) for k in [*stamps, "none", "failed"]], "website_domain string")
    log = domains.withColumns({"cdx_http_status": F.lit(200), "error": F.when(F.col("website_domain") == "failed", "boom").otherwise("")})
    got = {r.website_domain: (r.homepage_archive_status, r.failure_reason) for r in cutoff_rows(domains, snaps, [cut], log=log).collect()}
    assert got == {
        "midnight": ("archived_200", ""), "oldest": ("archived_200", ""),
        "later_that_day": ("missing", "no_cdx_snapshot_before_cutoff"), "after": ("missing", "no_cdx_snapshot_before_cutoff"),
        "too_old": ("stale_snapshot", "no_snapshot_within_730_days_before_cutoff"),
        "none": ("missing", "no_cdx_snapshot_in_query_window"), "failed": ("request_error", "boom"),
    }


def test_rank_correlations_by_family(spark):
    rng = random.Random(8)
    data = [(rng.random(), float(rng.randrange(9)), None, int(rng.random() < 0.4), "a", rng.choice("xyz"), i % 4) for i in range(400)]
    df = spark.createDataFrame(data, "f double, g double, empty double, y int, sector_bucket string, stage_bucket string, quarter_idx int")
    families = {"one": ["f", "empty"], "two": ["g", "f"], "baseline": ["quarter_idx"]}
    got = {(r.family, r.feature): r.residual_rank_ic for r in rank_ic.residual_rank_ic_by_family(df, families, "y").collect()}
    single = {r.feature: r.residual_rank_ic for r in rank_ic.residual_rank_ic(df, ["f", "g", "quarter_idx"], "y").collect()}
    assert got == {(name, f): single.get(f) for name, fs in families.items() for f in fs}
    assert got["one", "empty"] is None and got["one", "f"] is not None


def test_fan_join_keeps_its_reducers_at_any_size(spark):
    from tidemark.operators.skew import fan_join

    left = spark.range(3000).select(F.col("id").alias("e"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", q, 1) for q in range(5)] + [("6", 0, 2)], "k string, q int, n int")
    joined = fan_join(left, right, ["k"], ["e"], 3000, per_task=100).cache()
    assert joined.count() == 2000 * 5 + 1 and joined.distinct().count() == joined.count()
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert joined.rdd.getNumPartitions() == 30 and max(sizes) < 3000
    plan = fan_join(left, right, ["k"], ["e"], 3000, per_task=100)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k" in plan
