"""Where the space went: totals, kinds, folders, largest files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.functions import classify, paths, sizes

# List length, and the share by which a folder must outweigh its
# largest child to be worth naming (115 to 100).
WORTH_NAMING = 40
MORE, THAN = 115, 100
LONG_MAX = 2**63 - 1


def weighted(entries: DataFrame) -> DataFrame:
    """Files with the bytes they count for and whether those are here."""
    residency = F.col("cloud.residency")
    return entries.where(F.col("kind") == "file").select(
        "machine",
        "entry_id",
        "path",
        sizes.survey_bytes(residency, F.col("allocated_size"), F.col("logical_size")).alias("bytes"),
        classify.survey_local(residency).alias("local"),
    )


def totals(files: DataFrame) -> DataFrame:
    here = F.col("local")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        total("bytes").alias("bytes"),
        F.count_if(here).alias("here_files"),
        total(F.when(here, F.col("bytes"))).alias("here_bytes"),
        F.count_if(~here).alias("cloud_files"),
        total(F.when(~here, F.col("bytes"))).alias("cloud_bytes"),
    )


def kinds(files: DataFrame) -> DataFrame:
    """Weight per category, heaviest first, declaration order among equals."""
    return (
        files.groupBy(classify.category_of(F.col("path")).alias("category"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
        .withColumn("personal", classify.is_personal(F.col("category")))
        .orderBy(F.desc("bytes"), classify.category_rank(F.col("category")))
    )


def folders(files: DataFrame) -> DataFrame:
    """Weight of every folder, counting everything below it.

    Files collapse into their own folder before anything is exploded, so the
    explosion multiplies folders rather than files, and partial aggregation
    absorbs the root, which every row reaches.
    """
    direct = files.groupBy("machine", paths.parent(F.col("path")).alias("parent")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")
    )
    holding = direct.where("parent is not null").select(
        "machine", F.explode(paths.self_and_ancestors(F.col("parent"))).alias("folder"), "n", "b"
    )
    return holding.groupBy("machine", "folder").agg(
        F.sum("n").alias("files"), F.sum("b").alias("bytes")
    )


def largest_children(weights: DataFrame) -> DataFrame:
    return (
        weights.select("machine", paths.parent(F.col("folder")).alias("folder"), "bytes")
        .where("folder is not null")
        .groupBy("machine", "folder")
        .agg(F.max("bytes").alias("largest_child"))
    )


def _saturating(value: Column, by: int) -> Column:
    return F.when(value > LONG_MAX // by, F.lit(LONG_MAX)).otherwise(value * by)


def worth_showing(weights: DataFrame) -> DataFrame:
    """Folders not explained by a single folder inside them."""
    inside = F.coalesce("largest_child", F.lit(0))
    kept = weights.join(largest_children(weights), ["machine", "folder"], "left").where(
        _saturating(F.col("bytes"), THAN) > _saturating(inside, MORE)
    )
    return kept.drop("largest_child")


def top_folders(weights: DataFrame, k: int = WORTH_NAMING) -> DataFrame:
    """Heaviest first; among equals the deeper, then path order."""
    return weights.orderBy(
        F.desc("bytes"),
        F.desc(paths.depth(F.col("folder"))),
        paths.parts(F.col("folder")),
        "machine",
    ).limit(k)


def largest_files(files: DataFrame, k: int = WORTH_NAMING) -> DataFrame:
    """The heaviest files; only those that are kept get a category."""
    top = files.orderBy(
        F.desc("bytes"), paths.parts(F.col("path")), "machine", "entry_id"
    ).limit(k)
    return top.withColumn("category", classify.category_of(F.col("path")))


class Survey:
    """The four answers over one inventory; each is built when it is asked for."""

    def __init__(self, entries: DataFrame, k: int = WORTH_NAMING):
        self.files, self.k = weighted(entries), k

    @property
    def totals(self) -> DataFrame:
        return totals(self.files)

    @property
    def kinds(self) -> DataFrame:
        return kinds(self.files)

    @property
    def folders(self) -> DataFrame:
        return top_folders(worth_showing(folders(self.files)), self.k)

    @property
    def largest(self) -> DataFrame:
        return largest_files(self.files, self.k)


def survey(entries: DataFrame, k: int = WORTH_NAMING) -> Survey:
    return Survey(entries, k)
