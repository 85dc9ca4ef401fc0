"""Bootstrap intervals, promotion gates and the final summary."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import percent, percent_interval
from tidemark.operators.metrics import MODEL, top_rows
from tidemark.sources.sinks import cut

BASELINE = "baseline"
PLACEBO = "baseline_plus_noise_placebo"

# How much worse a promoted variant may be calibrated.
MAX_BRIER_DELTA = 0.0025
MAX_ECE_DELTA = 0.01


def paired_scores(pred: DataFrame, label: str, key: Sequence[str], baseline: str = BASELINE) -> DataFrame:
    """Every variant's score beside the baseline score of the same model and row. Both come
    out of one aggregation by row when variants are few, so no self-join is needed."""
    slim = pred.select("model", *key, label, "variant", "score")
    per_row = slim.groupBy("model", *key, label).agg(
        F.max(F.when(F.col("variant") == baseline, F.col("score"))).alias("base_score"),
        # one entry per configured variant
        F.collect_list(F.when(F.col("variant") != baseline, F.struct("variant", "score"))).alias("_others"),
    )
    return per_row.filter(F.col("base_score").isNotNull()).select(
        "model", *key, label, "base_score", F.inline("_others").alias("variant", "cand_score")
    )


def bootstrap_precision(
    pred: DataFrame, label: str, key: Sequence[str], k: int = 500, n_boot: int = 500, seed: int = 42,
    cluster_by: Sequence[str] | None = None, margin: int | None = None, baseline: str = BASELINE,
) -> DataFrame:
    """Precision of the best k rows of each resample, per (model, variant, replicate).

    Each row is drawn Poisson(1) times per replicate, decided by a hash of the row and the
    replicate, so all variants of one replicate share the same resample: draws are made once
    per row for all replicates. Only rows near the top can enter: the best ``k + margin`` rows
    are kept, and if they cannot fill every replicate, the margin is widened until they do or
    all rows are kept. ``cluster_by`` (for instance the entity) draws whole clusters.
    """
    margin = 10 * math.ceil(math.sqrt(k)) + 50 if margin is None else margin
    slim = pred.select(*MODEL, *key, label, "score")
    while True:
        filled = cut(_replicates(slim, label, key, k, n_boot, seed, cluster_by, k + margin), "bootstrap")
        if not filled.filter((F.col("drawn") < k) & (F.col("kept") >= k + margin)).head(1):
            break
        margin = 2 * margin + k
    return filled.select(*MODEL, "replicate", F.try_divide("hits", "drawn").alias("precision"))


def draws(units: DataFrame, unit: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """``unit`` and ``copies``: a byte per replicate, how often the unit is drawn there. A
    digest of the unit and every fourth replicate gives the uniforms of four replicates."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in unit])
    kept = units.select(*unit)
    # the distribution function of Poisson(1), which uniforms are held against
    steps = np.cumsum([math.exp(-1.0) / math.factorial(count) for count in range(12)])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(unit)).to_pylist()
            digests = b"".join(md5(f"{t}|{four}|{seed}".encode()).digest() for t in texts for four in range(-(-n_boot // 4)))
            uniforms = (np.frombuffer(digests, ">u4").reshape(len(texts), -1)[:, :n_boot] + 0.5) / 2.0**32
            copies = np.searchsorted(steps, uniforms).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(unit)], pa.array([row.tobytes() for row in copies], pa.binary())], names=[*unit, "copies"])

    return units.select(*unit, text.alias("_text")).mapInArrow(draw, kept.schema.add("copies", "binary"))


def _replicates(
    slim: DataFrame, label: str, key: Sequence[str], k: int, n_boot: int, seed: int, cluster_by: Sequence[str] | None, depth: int
) -> DataFrame:
    """Hits and rows drawn per (model, variant, replicate) from the best ``depth`` rows, which
    is all that a task holds."""
    unit = list(cluster_by or key)
    top = cut(top_rows(slim, depth, key), "bootstrap-top")
    drawn = draws(top.select(*unit).distinct(), unit, n_boot, seed)

    def resample(table: pa.Table) -> pa.Table:
        table = table.sort_by("top_rank")
        copies = np.frombuffer(b"".join(table["copies"].to_pylist()), np.uint8).reshape(table.num_rows, -1).astype(np.int64)
        before = np.cumsum(copies, axis=0) - copies
        used = np.clip(k - before, 0, copies)
        columns = {c: pa.array([table[c][0].as_py()] * n_boot, pa.string()) for c in MODEL}
        columns |= {"replicate": pa.array(range(n_boot), pa.int32()), "hits": pa.array(table["y"].to_numpy() @ used), "drawn": pa.array(used.sum(axis=0))}
        return pa.table(columns | {"kept": pa.array([int(table["top_rank"].to_numpy()[-1])] * n_boot, pa.int64())})

    rows = top.join(drawn, unit).select(*MODEL, "top_rank", F.col(label).cast("long").alias("y"), "copies")
    return rows.groupBy(*MODEL).applyInArrow(resample, "model string, variant string, replicate int, hits long, drawn long, kept long")


def bootstrap_deltas(replicates: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Mean and 95 % interval of the paired difference to the baseline of the same model.
    A group holds one value per replicate."""
    base = replicates.filter(F.col("variant") == baseline).select(
        "model", "replicate", F.col("precision").alias("base_precision")
    )
    paired = replicates.filter(F.col("variant") != baseline).join(base, ["model", "replicate"])
    delta = F.col("precision") - F.col("base_precision")
    return paired.withColumn("delta", delta).groupBy(*MODEL).agg(
        F.avg("delta").alias("delta_vs_baseline"),
        F.percentile("delta", F.lit(0.025)).alias("ci_low"),
        F.percentile("delta", F.lit(0.975)).alias("ci_high"),
    )


def promotion_gates(metrics: DataFrame, deltas: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """A variant passes if its gain is significantly positive and it is not noticeably worse
    calibrated than the baseline of its model. Models without a baseline are left out."""
    base = metrics.filter(F.col("variant") == baseline).select(
        "model", F.col("brier").alias("_brier"), F.col("ece").alias("_ece")
    )
    is_base = F.col("variant") == baseline
    joined = metrics.join(base, "model").join(deltas, list(MODEL), "left")
    passed = (
        ~is_base
        & (F.col("ci_low") > 0)
        & (F.col("brier_delta") <= MAX_BRIER_DELTA)
        & (F.col("ece_delta") <= MAX_ECE_DELTA)
    )
    return (
        joined.withColumns(
            {
                "delta_vs_baseline": F.when(is_base, 0.0).otherwise(F.col("delta_vs_baseline")),
                "brier_delta": F.col("brier") - F.col("_brier"),
                "ece_delta": F.col("ece") - F.col("_ece"),
            }
        )
        .withColumn("promotion_pass", F.coalesce(passed, F.lit(False)).cast("int"))
        .select(
            *MODEL, "precision_at_500", "delta_vs_baseline", "ci_low", "ci_high", "brier_delta", "ece_delta",
            "promotion_pass",
        )
    )


def placebo_guard(gates: DataFrame, placebo: str = PLACEBO) -> None:
    """Noise must not be promoted; if it is, no promotion can be trusted."""
    passed = gates.filter((F.col("variant") == placebo) & (F.col("promotion_pass") == 1)).limit(1).count()
    if passed:
        raise RuntimeError("the noise placebo passed a promotion gate")


def final_summary(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Metrics and gates side by side, with the headline numbers as text."""
    joined = metrics.join(gates.drop("precision_at_500"), list(MODEL), "left")
    delta = F.when(F.col("delta_vs_baseline").isNull(), "").otherwise(percent(F.col("delta_vs_baseline"), signed=True))
    return joined.select(
        *MODEL,
        percent(F.col("precision_at_500")).alias("Precision@500"),
        percent(F.col("precision_at_5000")).alias("Precision@5000"),
        delta.alias("Delta vs baseline"),
        percent_interval(F.col("ci_low"), F.col("ci_high")).alias("95% bootstrap CI"),
        "pr_auc", "roc_auc", "brier", "brier_delta", "ece", "ece_delta", "accuracy", "precision", "recall", "f1",
        "promotion_pass",
    )
