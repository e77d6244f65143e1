"""Grading a plan against a later snapshot. Nothing is changed by looking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens import schema
from filelens.functions import classify, paths, wording
from filelens.functions import content as digests
from filelens.operators import scale
from filelens.operators.duplicates import digest_entries
from filelens.session import pin

RIGOURS = ("content", "metadata")
UNREADABLE = "content could not be read"


def looked_at(observed: DataFrame, places: DataFrame) -> DataFrame:
    """Add ``seen``, what a snapshot says, to places unique by (machine, path);
    null where nothing is there. Overlapping scan roots repeat rows, so the first
    row of a path counts.

    ``observed`` is an inventory, optionally with a ``refusal`` column naming why
    a place could not be looked at.
    """
    refusal = F.col("refusal") if "refusal" in observed.columns else F.lit(None).cast("string")
    facts = F.struct(
        "entry_id",
        "kind",
        "logical_size",
        F.unix_seconds("modified").alias("modified_s"),
        classify.read_may_download(F.col("cloud.residency")).alias("may_download"),
        refusal.alias("refusal"),
    )
    seen = (
        observed.select("machine", "path", "entry_id", facts.alias("seen"))
        .join(places.select("machine", "path"), ["machine", "path"], "left_semi")
        .groupBy("machine", "path")
        .agg(F.min_by("seen", "entry_id").alias("seen"))
    )
    return places.join(seen, ["machine", "path"], "left")


def with_looks(
    frame: DataFrame,
    observed: DataFrame,
    looks: dict[str, str],
    spread_by: str,
    marks: dict[str, DataFrame] | None = None,
    slices: int | None = scale.SLICE_ROWS,
) -> DataFrame:
    """Add what a snapshot says about several path columns: {path column: name}.

    Places are counted before they are looked at, so a folder many rows point into
    is looked at once and joined back in slices. ``marks`` are sets of (machine,
    path); each becomes a flag ``name_mark`` of every look.
    """
    counted = reduce(
        DataFrame.unionByName,
        [
            frame.where(F.col(c).isNotNull())
            .groupBy("machine", F.col(c).alias("path"))
            .agg(F.count(F.lit(1)).alias("_rows"))
            for c in looks
        ],
    )
    places = counted.groupBy("machine", "path").agg(F.max("_rows").alias("_rows"))
    seen = looked_at(observed, places)
    for mark, paths_marked in (marks or {}).items():
        flag = paths_marked.select("machine", "path").distinct().withColumn(mark, F.lit(True))
        seen = seen.join(flag, ["machine", "path"], "left")
    for column, name in looks.items():
        flags = [F.coalesce(m, F.lit(False)).alias(f"{name}_{m}") for m in marks or {}]
        view = seen.select(
            "machine", F.col("path").alias(column), F.col("seen").alias(name), *flags, "_rows"
        )
        frame = scale.join_hot(
            frame, view, ["machine", column], "_rows", spread_by, "left", slices
        ).drop("_rows")
    return frame


def _refused(look: str) -> Column:
    return F.col(f"{look}.refusal").isNotNull()


def _facts(size: Column, modified: Column, content: Column) -> Column:
    return F.struct(
        size.cast("long").alias("logical_size"),
        modified.cast("long").alias("modified_s"),
        content.cast("string").alias("content"),
    )


def preflight(
    operations: DataFrame,
    observed: DataFrame,
    rigour: str = "metadata",
    content: DataFrame | None = None,
) -> DataFrame:
    """One verdict per operation: the first impediment in a fixed order decides.

    A recorded time that is missing never matches. With ``content`` rigour the
    subjects whose metadata still matches are digested again; only those.
    """
    if rigour not in RIGOURS or (rigour == "content") != (content is not None):
        raise ValueError(f"rigour is one of {RIGOURS}; 'content' needs a content table")
    making = operations.where("kind = 'create_directory'")
    made = making.select("machine", F.col("destination").alias("path"))
    leaving = operations.where("subject_path is not null").select(
        "machine", F.col("subject_path").alias("path")
    )
    rows = with_looks(
        operations.withColumn("into", paths.parent(F.col("destination"))),
        observed,
        {"subject_path": "source", "destination": "there", "into": "folder"},
        "position",
        {"made": made, "vacated": leaving},
        scale.slices_for(operations),
    )
    differs = (
        (F.col("logical_size") != F.col("source.logical_size"))
        | F.col("modified_s").isNull()
        | ~F.col("modified_s").eqNullSafe(F.col("source.modified_s"))
    )
    rows = rows.withColumn(
        "metadata_holds",
        F.col("source").isNotNull()
        & ~_refused("source")
        & ~F.col("source.may_download")
        & ~differs,
    )
    if rigour == "content":
        rows = pin(rows)
        wanted = rows.where("metadata_holds and content is not null").select(
            F.col("source.entry_id").alias("entry_id")
        )
        again = digest_entries(content, wanted, digests.full_digest(F.col("content")))
        again = again.select(F.col("entry_id").alias("_read"), F.col("digest").alias("actual"))
        rows = rows.join(again, F.col("source.entry_id") == F.col("_read"), "left")
        checks_content = F.col("content").isNotNull()
    else:
        rows = rows.withColumn("actual", F.lit(None).cast("string"))
        checks_content = F.lit(False)

    hold = lambda what: F.struct(F.lit("hold").alias("grade"), what.alias("impediment"))
    fail = lambda what: F.struct(F.lit("fail").alias("grade"), what.alias("impediment"))
    passed = F.struct(
        F.lit("pass").alias("grade"), F.lit(None).cast("string").alias("impediment")
    )
    creates = F.col("kind") == "create_directory"
    has_place = F.col("destination").isNotNull()
    reachable = F.col("into").isNull() | F.coalesce("folder_made", F.lit(False))
    outcome = (
        F.when(creates & F.col("there").isNull(), passed)
        .when(creates & _refused("there"), fail(F.col("there.refusal")))
        .when(creates & (F.col("there.kind") == "directory"), passed)
        .when(creates, hold(F.lit("destination_occupied")))
        .when(F.col("source").isNull(), hold(F.lit("source_missing")))
        .when(_refused("source"), fail(F.col("source.refusal")))
        .when(F.col("source.may_download"), hold(F.lit("content_not_present")))
        .when(differs, hold(F.lit("source_changed")))
        .when(checks_content & F.col("actual").isNull(), fail(F.lit("other")))
        .when(
            checks_content & (F.col("actual") != F.col("content")), hold(F.lit("source_changed"))
        )
        .when(has_place & _refused("there"), hold(F.col("there.refusal")))
        .when(
            has_place & F.col("there").isNotNull() & ~F.col("there_vacated"),
            hold(F.lit("destination_occupied")),
        )
        .when(~has_place | reachable, passed)
        .when(F.col("folder").isNull(), hold(F.lit("destination_unreachable")))
        .when(_refused("folder"), hold(F.col("folder.refusal")))
        .when(F.col("folder.kind") != "directory", hold(F.lit("destination_unreachable")))
        .otherwise(passed)
    )
    changed = F.col("outcome.impediment") == "source_changed"
    expected = _facts(F.col("logical_size"), F.col("modified_s"), F.col("content"))
    found = _facts(F.col("source.logical_size"), F.col("source.modified_s"), F.col("actual"))
    return rows.withColumn("outcome", outcome).select(
        F.col("position").alias("operation"),
        "machine",
        F.col("outcome.grade").alias("grade"),
        F.lit(rigour).alias("rigour"),
        F.col("outcome.impediment").alias("impediment"),
        F.when(F.col("outcome.impediment") == "other", F.lit(UNREADABLE)).alias("detail"),
        F.when(changed, expected).alias("expected"),
        F.when(changed, found).alias("found"),
    )


def standing(verdicts: DataFrame) -> DataFrame:
    grade = F.col("grade")
    return verdicts.agg(
        F.count_if(grade == "pass").alias("passing"),
        F.count_if(grade == "hold").alias("held"),
        F.count_if(grade == "fail").alias("failed"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("clear", (F.col("held") == 0) & (F.col("failed") == 0))


def impediments(verdicts: DataFrame) -> DataFrame:
    """How many operations each impediment stops, in words."""
    return (
        verdicts.where("grade <> 'pass' and impediment is not null")
        .groupBy("impediment")
        .agg(F.count(F.lit(1)).alias("operations"))
        .withColumn("wording", wording.impediment_report(F.col("impediment")))
    )


def impediment_samples(verdicts: DataFrame, operations: DataFrame, n: int = 3) -> DataFrame:
    """The first operations each impediment stops."""
    stopped = verdicts.where("grade <> 'pass' and impediment is not null")
    first = scale.first_rows(stopped, ["impediment"], [F.col("operation")], n)
    subjects = operations.select(F.col("position").alias("operation"), "subject_path")
    return first.select("impediment", "rank", "operation").join(subjects, "operation")


def passing(operations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Operations that will run; without a verdict there is no pass."""
    good = verdicts.where("grade = 'pass'").select(F.col("operation").alias("position"))
    return operations.join(good, "position").select(*schema.OPERATION.fieldNames())


def passing_effect(operations: DataFrame, verdicts: DataFrame) -> DataFrame:
    return passing(operations, verdicts).agg(
        F.count(F.lit(1)).alias("passing"),
        F.coalesce(F.sum("frees_bytes"), F.lit(0)).alias("frees_bytes"),
    )
