"""One-row and per-reason figures about an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.functions import classify, sizes, wording
from filelens.operators import scale

UNREAD_LISTED = 200
SAMPLES = 3


def _total(column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def reclaimable(entries: DataFrame) -> DataFrame:
    """Bytes freed by removing every file once: shared bytes count by their first
    name only, and what has no recorded allocation counts nothing."""
    files = entries.where(F.col("kind") == "file").select(
        "machine",
        "entry_id",
        F.col("file_id.volume").alias("volume"),
        F.col("file_id.index").alias("index"),
        F.when(F.col("file_id").isNull(), F.col("entry_id")).alias("lone"),
        "allocated_size",
    )
    return (
        files.groupBy("machine", "volume", "index", "lone")
        .agg(F.min_by("allocated_size", "entry_id").alias("held"))
        .agg(_total("held").alias("reclaimable_bytes"))
    )


def scan_summary(entries: DataFrame) -> DataFrame:
    """Counts by kind; not-downloaded counts remote entries of every kind."""
    kind = F.col("kind")
    counts = entries.agg(
        F.count_if(kind == "file").alias("files"),
        F.count_if(kind == "directory").alias("directories"),
        F.count_if(kind == "symlink").alias("links"),
        F.count_if((kind == "file") & F.col("cloud.provider").isNotNull()).alias("synced_files"),
        F.count_if(classify.scan_not_downloaded(F.col("cloud.residency"))).alias("not_downloaded"),
    )
    return counts


def window_summary(entries: DataFrame) -> DataFrame:
    """The window's figures; here in-the-cloud means remote or partial files."""
    kind = F.col("kind")
    file = kind == "file"
    size = sizes.summary_bytes(F.col("allocated_size"), F.col("logical_size"))
    cloud = classify.window_in_cloud(F.col("cloud.residency"))
    return entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(file).alias("files"),
        F.count_if(kind == "directory").alias("directories"),
        F.count_if(kind == "symlink").alias("links"),
        _total(F.when(file, size)).alias("bytes"),
        F.count_if(file & cloud).alias("in_cloud"),
    )


def unread_by_reason(unread: DataFrame) -> DataFrame:
    """How many places each reason kept from being read; no reason is left out."""
    return (
        unread.groupBy("reason")
        .agg(F.count(F.lit(1)).alias("places"))
        .withColumn("wording", wording.unread_report(F.col("reason")))
    )


def unread_samples(unread: DataFrame, n: int = SAMPLES) -> DataFrame:
    return scale.first_rows(unread, ["reason"], [F.col("path"), F.col("machine")], n).select(
        "reason", "rank", "machine", "path"
    )


def unread_list(unread: DataFrame, limit: int = UNREAD_LISTED) -> DataFrame:
    """The window's list: the first places with their reason in words."""
    return (
        unread.orderBy("path", "machine")
        .limit(limit)
        .select(
            "machine", "path", wording.unread_window(F.col("reason"), F.col("detail")).alias("why")
        )
    )


def is_complete(unread: DataFrame) -> bool:
    """Whether every figure covers everything asked for."""
    return unread.isEmpty()
