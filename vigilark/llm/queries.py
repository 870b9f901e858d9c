"""The registered queries of this subpackage: each applies one operator, with its production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilark.llm.ann import nearest
from vigilark.llm.bpe_chunks import chunk_encode
from vigilark.llm.collocations import collocations
from vigilark.llm.common import table
from vigilark.llm.language_id import language_id
from vigilark.llm.line_dedup import dedup_report
from vigilark.llm.lm_score import lm_score
from vigilark.llm.mixture import mixture_report
from vigilark.llm.ngram_join import ngram_components
from vigilark.llm.oracle import ORACLE
from vigilark.llm.packing import best_fit_packing
from vigilark.llm.quality_classifier import quality_classifier
from vigilark.llm.quality_rules import quality_rules
from vigilark.llm.token_store import token_store
from vigilark.llm.whitening import whiten


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), added=True)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), added=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(table(spark, sf_dir, "documents")).select(*names)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op11_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_encode(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_classifier, op2_collision_neighbours, op3_mixture, op4_token_store, op5_best_fit_packing,
        op6_quality_rules, op7_lm_score, op8_ngram_join, op9_line_dedup, op10_language_id, op11_bpe_chunks,
        op12_whitening, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
