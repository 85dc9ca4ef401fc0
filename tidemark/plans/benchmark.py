"""From input tables to every result table."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import PanelSpec
from tidemark.operators import audit, availability, gates, labels, metrics, rank_ic
from tidemark.plans import features, incremental, modelling
from tidemark.plans.panel import PanelInputs
from tidemark.sources.contracts import contract
from tidemark.sources.sinks import Cuts, cut, stage, write_table
from tidemark.sources.tabular import read_csv_directory, read_csv_optional


def read_inputs(spark: SparkSession, root: str, homepage_rows: DataFrame | None = None, line_breaks: bool = False) -> PanelInputs:
    """The eight input tables from a folder of CSV files (deals from folders of parts).
    ``line_breaks`` is for files whose cells contain line breaks."""

    def one(table: str) -> DataFrame:
        return read_csv_optional(spark, posixpath.join(root, f"{table}.csv"), contract(table), line_breaks)

    def parts(table: str) -> DataFrame:
        return read_csv_directory(spark, posixpath.join(root, table), contract(table), line_breaks)

    return PanelInputs(
        one("companies"), one("funding_rounds"), one("acquisitions"), one("ipos"), parts("vc_deals"),
        parts("buyout_deals"), one("patents"), one("partner_features"), homepage_rows,
    )


@dataclass
class Benchmark:
    frame: DataFrame
    predictions: DataFrame
    tables: dict[str, DataFrame]
    scratch: Cuts | None = None


def frame_key(inputs: PanelInputs, spec: PanelSpec, input_version: str, options: Mapping[str, object]) -> str:
    """Names a model frame by everything that shapes it: settings, data version, which
    tables there are, and the panel options by their text (expressions print as they are)."""
    tables = sorted(name for name, table in vars(inputs).items() if table is not None)
    parts = [spec.fingerprint(), input_version, *tables, *(f"{name}={_text(value)}" for name, value in sorted(options.items()))]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:24]


def _text(value: object) -> str:
    return incremental.setting_text(value, lambda table: f"{table.schema.simpleString()}#{table.semanticHash()}")


def run_benchmark(
    spark: SparkSession, inputs: PanelInputs, spec: PanelSpec, input_version: str | None = None,
    models: Mapping[str, modelling.ModelSpec] | None = None, n_boot: int = 500, max_train_rows: int | None = None,
    check_placebo: bool = True, **panel_options,
) -> Benchmark:
    """Build the frame, fit and score every model and variant, and derive the reports.

    The frame is a stage table named by the settings, the options and ``input_version`` (a
    name the caller changes with the data): a rerun picks it up and builds nothing. Without
    one the inputs are fingerprinted, which reads them once, and the panel is kept per entity
    bucket: only buckets whose inputs changed are built again. Tables that only this run
    needs are listed in ``scratch``; ``write_results`` removes them.
    """
    with Cuts() as scratch:
        result = _benchmark(spark, inputs, spec, input_version, models, n_boot, max_train_rows, check_placebo, panel_options)
    result.scratch = scratch
    return result


def _benchmark(spark, inputs, spec, input_version, models, n_boot, max_train_rows, check_placebo, panel_options) -> Benchmark:
    key = [spec.entity, spec.period]
    if input_version is None:
        kept = incremental.kept_panel(spark, inputs, spec, **panel_options)
        frame = stage(spark, "model-frame", kept.fingerprint, lambda: features.across_entities(kept.table, spec))
    else:
        named = frame_key(inputs, spec, input_version, panel_options)
        frame = stage(spark, "model-frame", named, lambda: features.model_frame(inputs, spec, **panel_options).frame)
    train, test = (frame.filter(F.col("split") == s) for s in ("train", "test"))

    present = set(availability.present_columns(frame, features.all_features()))
    usable = {fam: [c for c in cols if c in present] for fam, cols in features.FAMILIES.items()}
    models = modelling.model_specs() if models is None else models
    swept = modelling.sweep(train, test, spec, models, modelling.variants(usable), max_train_rows)
    predictions = cut(swept.unionByName(modelling.hazard_baseline(train, test, spec)), "predictions")

    scored = cut(metrics.metric_rows(predictions, spec.label, key), "metrics")
    deltas = gates.bootstrap_deltas(gates.bootstrap_precision(predictions, spec.label, key, n_boot=n_boot))
    promotion = cut(gates.promotion_gates(scored, deltas), "gates")
    if check_placebo:
        gates.placebo_guard(promotion)
    audited = audit.audited_top(predictions, frame, spec)
    out_of_time = frame.filter(F.col("split").isin("validation", "test"))
    screened = {**usable, "baseline": features.BASELINE_NUMERIC}
    tables = {
        "feature_availability": availability.availability(frame, features.FAMILIES, features.blocked_families(inputs)).orderBy("position"),
        "residual_rank_ic": rank_ic.residual_rank_ic_by_family(out_of_time, screened, spec.label),
        "metrics": scored,
        "promotion_gates": promotion,
        "calibration_deciles": metrics.binned_calibration(predictions, spec.label, key),
        "route_support": labels.route_support(frame, spec),
        "route_priors": labels.route_priors(frame, spec),
        "policy_backtest": audit.policy_backtest(predictions, spec),
        "split_overlap": audit.split_overlap(frame, spec),
        "topk_summary": audit.topk_summary(audited, spec),
        "topk_detail": audit.topk_detail(audited, spec),
        "final_summary": gates.final_summary(scored, promotion),
    }
    if inputs.partner_features is not None:
        tables["partner_audit"] = features.partner_audit(frame, inputs.partner_features, spec)
    return Benchmark(frame, predictions, tables)


def write_results(result: Benchmark, root: str, fmt: str = "parquet") -> None:
    """One folder per result table; predictions by model and variant."""
    for name, table in result.tables.items():
        write_table(table, posixpath.join(root, name), fmt)
    write_table(result.predictions, posixpath.join(root, "predictions"), fmt, ("model", "variant"))
    if result.scratch is not None:
        result.scratch.delete(result.frame.sparkSession)
