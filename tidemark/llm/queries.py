"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read
from tidemark.llm.decontamination import contamination
from tidemark.llm.divergence import source_divergence
from tidemark.llm.license_scan import license_report
from tidemark.llm.mixing import mixed_sizes
from tidemark.llm.ngram_join import ngram_jaccard
from tidemark.llm.oracles import ORACLES
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.passages import repeated_passages
from tidemark.llm.personal_data import personal_data
from tidemark.llm.phrases import collocations
from tidemark.llm.quality import apply_policy, quality_ledger
from tidemark.llm.secret_scan import secret_report
from tidemark.llm.toxicity import toxicity
from tidemark.llm.vector_dedup import near_duplicate_vectors


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = apply_policy(quality_ledger(read(spark, sf_dir, "documents")))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_repeated_passages": op1_repeated_passages,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_source_mixing": op3_source_mixing,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_personal_data": op10_personal_data,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_source_divergence": op12_source_divergence,
    "op13_phrase_collocations": op13_phrase_collocations,
}
