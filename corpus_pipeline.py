"""Corpus pipeline: toxic documents go, one document of each near-duplicate group
stays, documents with benchmark items go, secrets are masked, and what is left is
packed into sequences. Each stage reads the Parquet table that the one before wrote."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from filelens.llm import decontaminate, jaccard, packing, secrets, toxicity
from filelens.session import keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Rows that go to a Python worker at once: workers and executors keep the room that the
# largest batch took, and stages with other needs follow each other in the same ones.
BATCH_ROWS = 1000


def _in_small_batches(stage: Stage) -> Stage:
    """The stage, whoever runs it, with batches of ``BATCH_ROWS``."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


@_in_small_batches
def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more."""
    return jaccard.keep_one(docs, 5, 80)


@_in_small_batches
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_untouched(docs, _table(spark, sf_dir, "benchmark"))


@_in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard_join", remove_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

# A learned classifier and a tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
