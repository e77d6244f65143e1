"""What an artifact contains and where it came from: digests and chain audits."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens import schema
from filelens.operators import scale
from filelens.sources import sections

# Per stage its input kind, output kind, whether it changes a
# machine, and how many inputs it takes (no maximum is null).
STAGES = (
    ("scan", None, "inventory", False, 0, 0),
    ("analyze", "inventory", "analysis", False, 1, 1),
    ("merge", "analysis", "analysis", False, 2, None),
    ("plan", "analysis", "plan", False, 1, 1),
    ("preflight", "plan", "preflight", False, 1, 1),
    ("apply", "preflight", "journal", True, 1, 1),
    ("undo", "journal", "journal", True, 1, 1),
)
STAGE_TABLE = (
    "stage string, input_kind string, output_kind string, mutates boolean, "
    "least_inputs int, most_inputs int"
)

# Ids say where a row stood in its input, not what it is; digests of content alone
# leave them out.
POSITIONAL = ("entry_id", "group_id", "object_id", "first_name", "first_entry")


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STAGES), STAGE_TABLE)


def content_digest(
    tables: Mapping[str, DataFrame], parents: tuple[str, ...] = (), with_ids: bool = False
) -> str:
    """An order-independent digest of named tables, chained to parent digests.

    ``with_ids`` covers the ids too. A stored artifact needs that: later stages join on
    its ids, so a row that changes its group or its entry is another artifact.
    """
    skip = () if with_ids else POSITIONAL
    return chained({name: sections.root(sections.tree(frame, (), skip)) for name, frame in tables.items()}, parents)


def chained(roots: Mapping[str, tuple[int, str]], parents: Sequence[str] = ()) -> str:
    """The digest of an artifact: its tables' roots by name, then its parents in order."""
    told = [f"{name}:{rows}:{digest}" for name, (rows, digest) in sorted(roots.items())]
    return hashlib.sha256("|".join([*told, "", *parents]).encode()).hexdigest()


def chain_audit(headers: DataFrame, supplied: DataFrame) -> DataFrame:
    """Broken chains, one row per artifact and violation.

    ``headers`` has a row per artifact (content_digest, schema_version, stage, kind,
    parents); ``supplied`` the inputs it was really given (child, ordinal, digest).
    Parents are an ordered sequence: the same inputs in another order are another
    artifact.
    """
    dimension = F.broadcast(stages(headers.sparkSession))
    rows = headers.join(dimension, "stage", "left")
    given = supplied.groupBy(F.col("child").alias("content_digest")).agg(
        F.count(F.lit(1)).alias("given")
    )
    counted = rows.join(given, "content_digest", "left").withColumn(
        "given", F.coalesce("given", F.lit(0))
    )
    artifact = F.col("content_digest").alias("artifact")
    schema_off = counted.where(F.col("schema_version") != schema.SCHEMA_VERSION).select(
        artifact, F.lit("schema_mismatch").alias("violation"), F.lit(-1).cast("long").alias("ordinal")
    )
    wrong_count = (F.col("given") < F.col("least_inputs")) | (
        F.col("most_inputs").isNotNull() & (F.col("given") > F.col("most_inputs"))
    )
    wrong_count = wrong_count | (F.col("given") != F.size("parents"))
    count_off = counted.where(wrong_count).select(
        artifact, F.lit("wrong_parent_count").alias("violation"), F.lit(-1).cast("long").alias("ordinal")
    )
    kinds = headers.select(F.col("content_digest").alias("digest"), F.col("kind").alias("given_kind"))
    expected = rows.select(F.col("content_digest").alias("child"), "input_kind")
    expected = expected.join(given.withColumnRenamed("content_digest", "child"), "child")
    of_kind = scale.join_counted(supplied, kinds, ["digest"], "child")
    kind_off = (
        scale.join_hot(of_kind, expected, ["child"], "given", "digest")
        .where("input_kind is not null and given_kind <> input_kind")
        .select(
            F.col("child").alias("artifact"), F.lit("wrong_input_kind").alias("violation"), "ordinal"
        )
    )
    named = headers.select(
        F.col("content_digest").alias("child"), F.posexplode("parents").alias("ordinal", "named")
    ).withColumn("ordinal", F.col("ordinal").cast("long"))
    digest_off = (
        named.join(supplied, ["child", "ordinal"])
        .where("named <> digest")
        .select(
            F.col("child").alias("artifact"),
            F.lit("parent_digest_mismatch").alias("violation"),
            "ordinal",
        )
    )
    return schema_off.unionByName(count_off).unionByName(kind_off).unionByName(digest_off)


def executability_audit(headers: DataFrame, machines: DataFrame) -> DataFrame:
    """Artifacts that may not run on a machine: made for another, or merged.
    ``machines`` (content_digest, machine) says where each is to run."""
    foreign = F.get("machines", F.lit(0)) != F.col("machine")
    return (
        headers.join(machines, "content_digest")
        .withColumn(
            "violation",
            F.when(F.col("merged"), F.lit("merged_scope_not_executable")).when(
                foreign, F.lit("foreign_machine")
            ),
        )
        .where("violation is not null")
        .select(F.col("content_digest").alias("artifact"), "machine", "violation")
    )
