"""Shape of physical plans, and the whole benchmark on the smallest tables."""

import os
import re

from pyspark.sql import functions as F

from tidemark.operators import asof, labels, matching, metrics, skew
from tidemark.plans import modelling, panel
from tidemark.plans.benchmark import run_benchmark, write_results
from tidemark.sources.sinks import cut
from tidemark.workload import standins as D

SF = "/root/testdata/sf0.001"
SPEC = D.panel_spec()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_shuffles_entities_before_expanding_them(spark):
    base = D.labelled_spine(spark, SF).groupBy(SPEC.entity).agg(F.min(SPEC.period).alias("panel_start"), F.max(SPEC.period).alias("panel_end"))
    block = panel.round_block(D.funding_rounds(spark, SF), SPEC)
    text = plan(asof.asof_panel(base, [block], SPEC.entity, SPEC.period))
    top = text[: text.index("Union")]
    assert top.count("Exchange") == 1 and top.index("Window") < top.index("Generate") < top.index("Exchange")


def test_no_pairwise_or_single_task_plans(spark):
    frame = cut(D.labelled_spine(spark, SF))
    pred = cut(D.predictions(spark, SF, frame))
    checked = [
        labels.route_support(frame, SPEC),
        metrics.metric_rows(pred, SPEC.label, [SPEC.entity, SPEC.period]),
        skew.top_k(pred, ["model", "variant"], 10, [F.desc("score"), F.asc(SPEC.entity)], [SPEC.entity]),
        D.homepage_rows(spark, SF),
    ]
    for df in checked:
        text = plan(df)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Exchange SinglePartition"):
            assert bad not in text, bad


def test_top_k_is_cut_before_the_shuffle_at_any_k(spark):
    pred = cut(D.predictions(spark, SF, cut(D.labelled_spine(spark, SF))))
    for k in (10, 5000):
        top = skew.top_k(pred, ["model", "variant"], k, [F.desc("score"), F.asc(SPEC.entity)], [SPEC.entity])
        assert plan(top).count("WindowGroupLimit") >= 2, k


def test_rows_with_unknown_keys_are_spread(spark):
    left = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    right = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("v"))
    joined = skew.spread_join(left.repartition(4), right.hint("shuffle_merge"), ["k"], ["id"], "left")
    held = [r["n"] for r in joined.filter("k is null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 3600 and max(held) < 1800


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(D.ipos(spark, SF).select("company_uuid"))
    assert "PushedFilters: [IsNotNull(o_orderpriority)" in text
    assert "o_totalprice" not in text[text.index("ReadSchema") :]


def test_whole_benchmark(spark, tmp_path):
    inputs = D.inputs(spark, SF, families=True)
    options = D.panel_options(spark, SF)
    result = run_benchmark(
        spark, inputs, SPEC, "test", models={"logistic_regression": modelling.ModelSpec("logistic", {"maxIter": 20})},
        n_boot=20, check_placebo=False, **options,
    )
    write_results(result, str(tmp_path / "out"))
    found = {name: spark.read.parquet(str(tmp_path / "out" / name)).count() for name in [*result.tables, "predictions"]}
    variants = found["metrics"]
    assert variants >= 8 and found["promotion_gates"] == variants == found["final_summary"]
    assert found["predictions"] == variants * 239
    assert found["feature_availability"] == 56 and found["partner_audit"] == 1
    scored = spark.read.parquet(str(tmp_path / "out" / "metrics"))
    hazard, logistic = (
        scored.filter((F.col("model") == m) & (F.col("variant") == "baseline")).drop("model").first()
        for m in ("binary_hazard_route", "logistic_regression")
    )
    assert abs(hazard.roc_auc - logistic.roc_auc) < 0.02
    assert os.path.isdir(str(tmp_path / "out" / "predictions" / "model=logistic_regression"))


def test_registered_sweep_is_the_published_one(spark, monkeypatch):
    """All models and variants, on a frame that is built with every family's source."""
    from types import SimpleNamespace

    from tidemark.plans import features
    from tidemark.workload import models

    asked = {}
    rows = [(f"c{i}", i, i % 2, "test" if i % 3 else "train", *[float(i)] * len(features.all_features())) for i in range(9)]
    frame = spark.createDataFrame(rows, [SPEC.entity, SPEC.period, SPEC.label, "split", *features.all_features()])

    def model_frame(inputs, spec, **options):
        asked.update(inputs=inputs)
        return SimpleNamespace(frame=frame)

    def sweep(train, test, spec, line_up, compared):
        asked.update(models=line_up, variants=compared)
        return test.select(SPEC.entity, SPEC.period, SPEC.label, F.lit("m").alias("model"), F.lit("baseline").alias("variant"), F.lit(0.5).alias("score"))

    monkeypatch.setattr(features, "model_frame", model_frame)
    monkeypatch.setattr(modelling, "sweep", sweep)
    models.sweep_metrics(spark, SF)
    assert asked["models"] == modelling.model_specs()
    assert asked["models"]["gradient_boosted_trees"].trees().trees == 250
    assert asked["variants"] == modelling.variants(features.FAMILIES) and len(asked["variants"]) == 12
    assert all(x is not None for x in (asked["inputs"].patents, asked["inputs"].partner_features, asked["inputs"].homepage_rows))


def test_deals_are_added_up_by_small_splits(spark):
    """Whatever larger split the session allows, in any spelling; a smaller one stays."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for given, left in (("128m", panel.SPLIT_BYTES), ("134217728b", panel.SPLIT_BYTES), ("1GB", panel.SPLIT_BYTES), ("4mb", 4 << 20)):
            spark.conf.set(name, given)
            panel.match_tables(D.inputs(spark, SF), SPEC)
            assert panel._in_bytes(spark.conf.get(name)) == left, given
    finally:
        spark.conf.set(name, before)


def test_shuffles_follow_the_input(spark, monkeypatch):
    """Partitions by the bytes of the input, each file once, merged up to a bound; a larger
    number or a smaller bound of the session stays."""
    parts, most = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    names = ("customer", "orders", "lineitem", "part", "pages")
    size = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in names)
    before = spark.conf.get(most)
    monkeypatch.setattr(panel, "INPUT_PER_PART", 10_000)
    inputs = D.inputs(spark, SF)
    try:
        spark.conf.set(most, "64m")
        panel.match_tables(inputs, SPEC)
        assert int(spark.conf.get(parts)) == -(-size // 10_000) > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert panel._in_bytes(spark.conf.get(most)) == panel.READ_BYTES
        many = str(10 * size)
        spark.conf.set(parts, many)
        spark.conf.set(most, "1m")
        panel._bounded_tasks(inputs)
        assert (spark.conf.get(parts), spark.conf.get(most)) == (many, "1m")
        spark.conf.unset(parts)
        rows = spark.createDataFrame([("a",)], "x string")
        panel._bounded_tasks(panel.PanelInputs(*[rows] * 6))
        assert spark.conf.get(parts, None) is None
    finally:
        spark.conf.unset(parts)
        spark.conf.set(most, before)


def test_tasks_of_the_panel_follow_its_entities(spark, monkeypatch):
    """Both where deals are added up and where periods are sorted, not what they read."""
    monkeypatch.setattr(asof, "ENTITIES_PER_SORT", 3)
    monkeypatch.setattr(matching, "ENTITIES_PER_SORT", 4)
    found = D.panel(spark, SF)
    companies = D.companies(spark, SF).filter("company_uuid is not null").count()
    text = re.sub(r"#\d+", "", plan(found.panel))
    assert f"hashpartitioning(company_uuid, {-(-companies // 3)}), REPARTITION_BY_NUM" in text
    assert f"hashpartitioning(company_uuid, fact_period, {-(-companies // 4)}), REPARTITION_BY_NUM" in text


def test_matched_deals_are_written_before_the_panel(spark, monkeypatch):
    """On request, with the same rows."""
    names, written = [], panel.cut
    monkeypatch.setattr(panel, "cut", lambda df, name="cut": names.append(name) or written(df, name))
    inputs, options = D.inputs(spark, SF), D.panel_options(spark, SF)
    one, other = (panel.build_panel(inputs, D.panel_spec(), write_facts=w, **options).panel for w in (False, True))
    assert names.count("deal-facts") == 1 and one.columns == other.columns
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
