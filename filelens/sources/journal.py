"""The steps of a run: append-only Parquet, a later record of a step replacing the earlier.
``steplog`` keeps them with a seal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens import schema
from filelens.functions import wording


def intended(operations: DataFrame) -> DataFrame:
    """The record of every step before it is attempted."""
    given = {
        "sequence": F.col("position"),
        "attempt": F.lit(0),
        "operation": F.col("position"),
        "machine": F.col("machine"),
        "progress": F.lit("intended"),
        "from_path": F.coalesce("subject_path", F.lit("")),
        "content": F.col("content"),
        "at": F.current_timestamp(),
    }
    return operations.select(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.STEP.fields
        ]
    )


def append_steps(steps: DataFrame, path: str) -> None:
    steps.select(*schema.STEP.fieldNames()).write.mode("append").parquet(path)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.STEP).parquet(path)


def latest_steps(steps: DataFrame, key: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """One record per step, the one of the latest attempt."""
    others = [c for c in steps.columns if c not in key]
    newest = F.max_by(F.struct(*others), F.struct("attempt", "at"))
    return steps.groupBy(*key).agg(newest.alias("latest")).select(
        *[F.col(c) if c in key else F.col(f"latest.{c}").alias(c) for c in steps.columns]
    )


def tally(steps: DataFrame, freed_by: Column | None = None) -> DataFrame:
    """What a run came to. ``freed_by`` prices a step; only done ones count."""
    progress = F.col("progress")
    by = lambda p: F.count_if(progress == p)
    freed = F.lit(0) if freed_by is None else F.coalesce(freed_by, F.lit(0))
    return steps.agg(
        by("done").alias("done"),
        by("skipped").alias("skipped"),
        by("failed").alias("failed"),
        by("intended").alias("unresolved"),
        F.coalesce(F.sum(F.when(progress == "done", freed)), F.lit(0)).cast("long").alias("freed"),
    ).withColumn("settled", F.col("unresolved") == 0)


def priced(steps: DataFrame, operations: DataFrame) -> DataFrame:
    """Steps with the bytes their operation frees."""
    price = operations.select(F.col("position").alias("operation"), "frees_bytes")
    return steps.join(price, "operation", "left")


def stop_reasons(steps: DataFrame) -> DataFrame:
    """Why steps stopped: skipped ones by impediment, failed ones verbatim."""
    text = F.when(
        F.col("progress") == "skipped", wording.impediment_report(F.col("reason"))
    ).otherwise(F.col("reason"))
    return (
        steps.where(F.col("progress").isin("skipped", "failed"))
        .groupBy(text.alias("why"))
        .agg(F.count(F.lit(1)).alias("steps"))
    )


def unresolved(steps: DataFrame) -> DataFrame:
    """Steps a stopped run wrote down and never resolved."""
    return latest_steps(steps).where("progress = 'intended'")
