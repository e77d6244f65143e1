"""Keep rules, operations, their order, their conflicts and their effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens import schema
from filelens.functions import paths, wording
from filelens.operators import scale
from filelens.operators.duplicates import Analysis

RULES = ("oldest", "newest", "shallowest", "under")
LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)

STAGE_ORDER = ("create_directory", "move", "quarantine")


def keep_key(rule: str, under: str | None = None) -> Column:
    """The smaller, the better to keep: preference, ordering, path by component,
    inventory order. No recorded time is last for oldest and first for newest."""
    if rule not in RULES or (rule == "under") != (under is not None):
        raise ValueError(f"rules are {RULES}; 'under' takes a path")
    path, time = F.col("path"), F.col("modified_s")
    preference = F.lit(0)
    if rule == "oldest":
        ordering = F.coalesce(time, F.lit(LONG_MAX))
    elif rule == "newest":
        ordering = F.coalesce(-time, F.lit(LONG_MIN))
    else:
        ordering = paths.depth(path)
    if rule == "under":
        preference = F.when(paths.is_under(path, F.lit(under)), 0).otherwise(1)
    return F.struct(
        preference.alias("preference"),
        ordering.alias("ordering"),
        paths.parts(path).alias("parts"),
        F.col("entry_id").alias("entry_id"),
        path.alias("path"),
    )


def _exact_names(entries: DataFrame, analysis: Analysis) -> DataFrame:
    """Every name in an exact group with the facts operations record."""
    exact = analysis.groups.where("certainty = 'exact'").select(
        "group_id", "names", F.col("digest").alias("content")
    )
    names = scale.join_hot(
        analysis.members.select("machine", "group_id", "object_id", "entry_id", "first_name"),
        exact,
        ["group_id"],
        "names",
        "entry_id",
        slice_rows=scale.slices_for(analysis.members),
    )
    facts = entries.select(
        "machine",
        "entry_id",
        "path",
        "logical_size",
        "allocated_size",
        F.unix_seconds("modified").alias("modified_s"),
    )
    return names.join(facts, ["machine", "entry_id"])


def kept(entries: DataFrame, analysis: Analysis, rule: str, under: str | None = None) -> DataFrame:
    """The object each exact group keeps, by its first name. A minimum, not a
    ranking: a group of any size folds inside the tasks that hold it."""
    firsts = _exact_names(entries, analysis).where("entry_id = first_name")
    return _kept(firsts, rule, under)


def _kept(firsts: DataFrame, rule: str, under: str | None) -> DataFrame:
    return (
        firsts.groupBy("group_id")
        .agg(F.min(keep_key(rule, under)).alias("best"), F.first("names").alias("names"))
        .select(
            "group_id",
            "names",
            F.col("best.entry_id").alias("kept_entry"),
            F.col("best.path").alias("kept"),
        )
    )


def operation_frame(frame: DataFrame, **columns: Column) -> DataFrame:
    """A frame with the operation columns, absent ones null."""
    given = {f.name: F.lit(None).cast(f.dataType) for f in schema.OPERATION.fields} | columns
    return frame.select(
        *[given[f.name].cast(f.dataType).alias(f.name) for f in schema.OPERATION.fields]
    )


def resolve(
    entries: DataFrame, analysis: Analysis, rule: str, under: str | None = None
) -> DataFrame:
    """Set aside every name of every object a proven group does not keep.

    Each name counts its own recorded allocation in ``frees_bytes``, so names of
    shared bytes count them more than once; ``effect`` also reports them once.
    """
    names = _exact_names(entries, analysis)
    best = _kept(names.where("entry_id = first_name"), rule, under)
    losers = scale.join_hot(
        names.drop("names"),
        best,
        ["group_id"],
        "names",
        "entry_id",
        slice_rows=scale.slices_for(analysis.members),
    ).where("first_name <> kept_entry")
    return operation_frame(
        losers,
        kind=F.lit("quarantine"),
        machine=F.col("machine"),
        entry_id=F.col("entry_id"),
        subject_path=F.col("path"),
        content=F.col("content"),
        logical_size=F.col("logical_size"),
        modified_s=F.col("modified_s"),
        because=F.lit("redundant_copy"),
        kept=F.col("kept"),
        frees_bytes=F.coalesce("allocated_size", F.lit(0)),
        is_folder=F.lit(False),
    )


def combine(by_rule: DataFrame, requested: DataFrame) -> DataFrame:
    """What was asked for wins: no rule operation on an entry already asked about,
    no folder made twice."""
    asked = requested.where("entry_id is not null").select("machine", "entry_id").distinct()
    folders = (
        requested.where("kind = 'create_directory'").select("machine", "destination").distinct()
    )
    making = by_rule.where("kind = 'create_directory'").dropDuplicates(["machine", "destination"])
    acting = by_rule.where("kind <> 'create_directory'")
    return (
        requested.unionByName(making.join(folders, ["machine", "destination"], "left_anti"))
        .unionByName(acting.join(asked, ["machine", "entry_id"], "left_anti"))
        .select(*schema.OPERATION.fieldNames())
    )


def order_key() -> list[Column]:
    """Folders first, moves next, quarantines last; by path inside each."""
    stage = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), F.col("kind"))
    place = F.coalesce("destination", "subject_path")
    return [stage, paths.parts(place), F.col("machine"), F.col("entry_id")]


def ordered(operations: DataFrame) -> DataFrame:
    """Operations with their plan position."""
    return scale.number_rows(operations.drop("position"), order_key(), "position").select(
        *schema.OPERATION.fieldNames()
    )


def plan(
    entries: DataFrame,
    analysis: Analysis,
    rule: str | None = "oldest",
    under: str | None = None,
    requested: DataFrame | None = None,
    merged: bool = False,
) -> DataFrame:
    """An ordered plan from a keep rule, requested operations, or both."""
    if merged:
        raise ValueError("a comparison of several machines can be planned on none of them")
    if rule is None and requested is None:
        raise ValueError("a plan needs a rule or requested operations")
    if rule is None:
        return ordered(requested)
    by_rule = resolve(entries, analysis, rule, under)
    return ordered(by_rule if requested is None else combine(by_rule, requested))


def claims(operations: DataFrame) -> DataFrame:
    """One row per destination an operation would take."""
    return operations.where("destination is not null").select(
        "machine", "destination", "position"
    )


def conflicts(entries: DataFrame, operations: DataFrame) -> DataFrame:
    """Places claimed twice, or held by an entry no operation is moving away."""
    wanted = claims(operations).groupBy("machine", "destination").agg(
        F.count(F.lit(1)).alias("claimants"), F.min("position").alias("first_claimant")
    )
    leaving = operations.where("subject_path is not null").select(
        "machine", F.col("subject_path").alias("destination")
    )
    held = (
        entries.select("machine", F.col("path").alias("destination"), "entry_id")
        .join(wanted.select("machine", "destination"), ["machine", "destination"], "left_semi")
        .join(leaving, ["machine", "destination"], "left_anti")
        .groupBy("machine", "destination")
        .agg(F.max("entry_id").alias("occupied_by"))
    )
    return wanted.join(held, ["machine", "destination"], "left").where(
        "claimants > 1 or occupied_by is not null"
    )


def conflict_claims(entries: DataFrame, operations: DataFrame) -> DataFrame:
    """The claiming operations of every conflict, one row each."""
    found = conflicts(entries, operations)
    return scale.join_hot(
        claims(operations),
        found.select("machine", "destination", "claimants"),
        ["machine", "destination"],
        "claimants",
        "position",
        "left_semi",
        scale.slices_for(operations),
    )


def effect(operations: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """What a plan would do. With members, shared bytes are also counted once."""
    kind = F.col("kind")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    figures = [
        F.count_if(kind == "quarantine").alias("quarantined"),
        F.count_if(kind == "move").alias("moved"),
        F.count_if(kind == "create_directory").alias("directories"),
        total("frees_bytes").alias("frees_bytes"),
    ]
    if members is not None:
        firsts = members.where("entry_id = first_name").select("machine", "entry_id", F.lit(True).alias("own"))
        operations = operations.join(firsts, ["machine", "entry_id"], "left")
        once = F.when(F.col("own"), F.col("frees_bytes"))
        figures.append(total(once).alias("frees_bytes_distinct"))
    return operations.agg(*figures)


def described(operations: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Plan rows in words, each with its verdict where one was given."""
    rows = operations.select(
        F.col("position").alias("operation"),
        "kind",
        "subject_path",
        "destination",
        "frees_bytes",
        wording.because(F.col("kind"), F.col("because"), F.col("kept")).alias("because"),
    )
    if verdicts is None:
        return rows
    graded = verdicts.select(
        "operation",
        "grade",
        wording.impediment_window(F.col("impediment"), F.col("detail")).alias("impediment"),
    )
    return rows.join(graded, "operation", "left")
