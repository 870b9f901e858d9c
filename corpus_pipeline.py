"""The corpus pipeline: documents through five of the training-data operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the
documents it keeps, which are written as Parquet and reread as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilark.llm.common import shared_dir, table
from vigilark.llm.line_dedup import without_copies
from vigilark.llm.mixture import mixture
from vigilark.llm.ngram_join import one_of_each
from vigilark.llm.packing import best_fit_packing
from vigilark.llm.quality_classifier import keep_good


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: later copies of repeated runs of lines (50 words or more) are deleted from the
    texts; a document of which no word is left goes."""
    return without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, with five-word shingles and a similarity of 0.8: one document of each group stays."""
    return one_of_each(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: sources mixed to target weights; a document is repeated as often as drawn."""
    return mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the mix packed into sequences of at most 4096 tokens; a row a piece."""
    return best_fit_packing(docs, added=True)


STAGES = [("quality_classifier", classify), ("line_dedup", dedup_lines), ("ngram_join", near_duplicates),
          ("mixture", mix), ("best_fit_packing", pack)]

#: SQL cannot express the stages: the classifier and the mix are hashed draws and fitted weights
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
