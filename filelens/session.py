"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are written for. Shuffle width is left to
# adaptive execution: a high initial number is coalesced on small data.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A broadcast passes through the driver, and one stage has dozens of joins. Above
    # this only sides whose rows were counted are broadcast, by a hint.
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m",
}


def local_session(cores: str = "8", app: str = "filelens") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        # Pinned frames leave files behind; drop them with the frames.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    ``spark.checkpoint.dir`` decides. Only a local session that names no folder
    (a test) gets a temporary one; on a cluster that is refused, since no other
    machine would see the folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        current = context.getCheckpointDir()
    return current


def pin(frame: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so that its partitions, row
    order and values no longer depend on recomputing what came before."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def keep(frame: DataFrame, *partition_by: str) -> DataFrame:
    """Write a frame to a Parquet table of its own in the shared folder and read it
    back: like ``pin``, with columns, statistics and pruning for what reads it."""
    spark = frame.sparkSession
    place = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    writer = frame.write.partitionBy(*partition_by) if partition_by else frame.write
    writer.parquet(place)
    return spark.read.schema(frame.schema).parquet(place)
