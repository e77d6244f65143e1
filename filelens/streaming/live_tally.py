"""A running tally over an arriving step log.

A step may resolve at any later time, so there is no watermark: Spark keeps the latest
record of each step as the state of a streaming aggregation and puts out the steps of
each batch whose record changed. The tally is an aggregate of the last ones, whatever
order records arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filelens import schema

CHANGE = "sequence long, attempt int, at_micros long, progress string, freed long"


def _age() -> Column:
    """Later attempts win, then later times; of two records of one moment the one that
    resolves the step, then the larger text, so arrival never decides."""
    return F.struct("attempt", "at_micros", F.col("progress") != "intended", "progress", "freed")


def _latest(records: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("attempt", "at_micros", "progress", "freed"), _age())
    return records.groupBy("sequence").agg(newest.alias("latest")).select("sequence", "latest.*")


def changes(steps: DataFrame) -> DataFrame:
    """The latest record of each step as a stream of steps arrives. A ``frees_bytes``
    column prices a step; only done steps free anything."""
    price = F.coalesce("frees_bytes", F.lit(0)) if "frees_bytes" in steps.columns else F.lit(0)
    priced = steps.select(
        F.col("sequence").cast("long"),
        F.col("attempt").cast("int"),
        F.unix_micros("at").alias("at_micros"),
        "progress",
        F.when(F.col("progress") == "done", price).otherwise(F.lit(0)).cast("long").alias("freed"),
    )
    return _latest(priced)


def start(
    spark: SparkSession, step_dir: str, change_dir: str, checkpoint: str, frees: bool = False
) -> StreamingQuery:
    """Follow a step folder, writing each batch's changes to a folder of its own (a
    batch that is run again replaces it); runs over what is there and stops."""
    shape = schema.STEP if not frees else schema.STEP_PRICED

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{change_dir}/batch={number}")

    return (
        changes(spark.readStream.schema(shape).parquet(step_dir))
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def tally(changes_so_far: DataFrame) -> DataFrame:
    """The tally after the changes seen so far."""
    progress = F.col("progress")
    return (
        _latest(changes_so_far.select("sequence", "attempt", "at_micros", "progress", "freed"))
        .agg(
            F.count_if(progress == "done").alias("done"),
            F.count_if(progress == "skipped").alias("skipped"),
            F.count_if(progress == "failed").alias("failed"),
            F.count_if(progress == "intended").alias("unresolved"),
            F.coalesce(F.sum("freed"), F.lit(0)).alias("freed"),
        )
        .withColumn("settled", F.col("unresolved") == 0)
    )
