"""Several machines side by side: merging, coverage, shared and exclusive content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelens.operators import duplicates, scale
from filelens.session import pin
from filelens.sources.sections import SECTION


@dataclass
class Recorded:
    """One machine's analysis as input to a merge."""

    label: str
    entries: DataFrame
    settled: DataFrame
    unread: DataFrame | None = None
    roots: DataFrame | None = None
    links: DataFrame | None = None
    merged: bool = False


@dataclass
class Merged:
    """Inputs concatenated in order. ``source`` says which ids are whose; the
    machine column scopes file ids, so equal ids never join across machines."""

    source: DataFrame
    entries: DataFrame
    settled: DataFrame
    unread: DataFrame | None
    roots: DataFrame | None
    links: DataFrame | None


def _stack(frames: Sequence[DataFrame | None]) -> DataFrame | None:
    given = [f for f in frames if f is not None]
    return reduce(DataFrame.unionByName, given) if given else None


SOURCE = "label string, ordinal long, first_entry long, entry_count long, id_span long"
FILE, ORDINAL = "_file", "_ordinal"


def _check_labels(labels: Sequence[str], merged: bool) -> None:
    if len(labels) < 2:
        raise ValueError("a comparison needs at least two analyses")
    if merged:
        raise ValueError("a merged analysis cannot be merged again")
    if len(set(labels)) < len(labels):
        raise ValueError("every analysis needs a label of its own")


def _sources(named: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each input: how many entries it has, and where its ids begin once they
    follow on from those of the inputs before. One pass over all entries; ``named`` has
    (label, ordinal) of every input, empty ones too."""
    sizes = entries.groupBy(F.col(ORDINAL).alias("ordinal")).agg(
        F.count(F.lit(1)).alias("entry_count"), (F.max("entry_id") + 1).alias("id_span")
    )
    zero = F.lit(0).cast("long")
    known = named.join(sizes, "ordinal", "left").select(
        "label", F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("entry_count", zero).alias("entry_count"),
        F.coalesce("id_span", zero).alias("id_span"),
    )
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)  # a row for each input
    first = F.coalesce(F.sum("id_span").over(before), zero).alias("first_entry")
    return pin(known.select("label", "ordinal", first, "entry_count", "id_span"))


def _moved(frame: DataFrame, source: DataFrame) -> DataFrame:
    """Rows under their input's label, ids after those of the inputs before."""
    facts = source.select(F.col("ordinal").alias(ORDINAL), "label", "first_entry")
    given = {"machine": F.col("label"), "entry_id": F.col("entry_id") + F.col("first_entry")}
    columns = [c for c in frame.columns if c != ORDINAL]
    joined = scale.look_up(frame, facts, [ORDINAL], columns[0])
    return joined.select(*[given.get(c, F.col(c)).alias(c) for c in columns])


def merge(inputs: Sequence[Recorded]) -> Merged:
    """At least two analyses of single machines with distinct labels. Entry ids
    are shifted so that they stay unique and keep the order of the inputs."""
    _check_labels([i.label for i in inputs], any(i.merged for i in inputs))
    spark = inputs[0].entries.sparkSession
    named = spark.createDataFrame([(i.label, n) for n, i in enumerate(inputs)], "label string, ordinal long")
    tagged = lambda part: _stack(
        [getattr(i, part).withColumn(ORDINAL, F.lit(n).cast("long")) for n, i in enumerate(inputs)]
    )
    entries = tagged("entries")
    source = _sources(named, entries)
    return Merged(
        source,
        _moved(entries, source),
        _moved(tagged("settled"), source),
        _stack([i.unread for i in inputs]),
        _stack([i.roots for i in inputs]),
        _stack([i.links for i in inputs]),
    )


def merge_stored(spark: SparkSession, folders: Mapping[str, str]) -> Merged:
    """``merge`` of stored analyses in the order of ``folders``: label -> folder that holds
    ``entries`` and ``settled``, or a place with ``{table}`` in it. Each table is one scan
    over all folders, and whose a row is follows from its file, so neither plans nor jobs
    grow with the number of inputs."""
    _check_labels(list(folders), False)
    plain = lambda path: F.regexp_replace(path, "^[a-zA-Z0-9]+:/+", "/")
    inside = [folder if "{table}" in folder else f"{folder.rstrip('/')}/{{table}}" for folder in folders.values()]
    named = spark.createDataFrame(list(zip(folders, range(len(inside)), inside, strict=True)), "label string, ordinal long, place string")

    def scan(table: str) -> DataFrame:
        frame = spark.read.parquet(*[place.format(table=table) for place in inside])
        columns = [c for c in frame.columns if c != SECTION]
        where = F.regexp_replace(plain(F.col("_metadata.file_path")), "/[^/]*$", "").alias(FILE)
        place = plain(F.replace(F.col("place"), F.lit("{table}"), F.lit(table)))
        places = named.select(place.alias(FILE), F.col("ordinal").alias(ORDINAL))
        return scale.look_up(frame.select(*columns, where), places, [FILE], "entry_id").drop(FILE)

    entries = scan("entries")
    source = _sources(named.drop("place"), entries)
    return Merged(source, _moved(entries, source), _moved(scan("settled"), source), None, None, None)


def source_of(entry_ids: DataFrame, source: DataFrame) -> DataFrame:
    """Label of each entry id by its source's range; null outside all. Ranges are laid
    into bins of equal width, a few for each source, and ids are joined by their bin, so
    the plan is the same for any number of sources."""
    whole = source.agg(F.max(F.col("first_entry") + F.col("id_span")), F.count(F.lit(1))).first()
    width = max(1, -(-(whole[0] or 0) // max(1, 4 * whole[1])))
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    end = F.col("first_entry") + F.col("id_span")
    ranges = source.where("id_span > 0").select(
        "label", F.col("first_entry").alias("_first"), end.alias("_end"),
        F.explode(F.sequence(bin_of(F.col("first_entry")), bin_of(end - 1))).alias("_bin"),
    )
    ids = entry_ids.withColumn("_at", bin_of(F.col("entry_id")))
    inside = (F.col("_at") == F.col("_bin")) & (F.col("entry_id") >= F.col("_first")) & (F.col("entry_id") < F.col("_end"))
    ranges = F.broadcast(ranges) if scale.is_small(ranges) else ranges
    return ids.join(ranges, inside, "left").select(*entry_ids.columns, "label")


def coverage(entries: DataFrame, settled: DataFrame) -> DataFrame:
    """Per machine: names of non-empty files against fingerprints. Only first
    names carry fingerprints, so a hard link makes a machine look partial;
    ``objects`` beside it does not count names."""
    files = duplicates.candidate_files(entries).groupBy("machine").agg(
        F.count(F.lit(1)).alias("files")
    )
    objects = duplicates.storage_objects(entries).groupBy("machine").agg(
        F.count(F.lit(1)).alias("objects")
    )
    marks = settled.groupBy("machine").agg(
        F.count(F.lit(1)).alias("fingerprinted"),
        F.count_if(F.col("kind") == "sample").alias("sample_only"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        files.join(objects, "machine", "left")
        .join(marks, "machine", "left")
        .select("machine", "files", zero("objects"), zero("fingerprinted"), zero("sample_only"))
        .withColumn("partial", F.col("fingerprinted") < F.col("files"))
    )


def machines_among(members: DataFrame) -> DataFrame:
    """Machines represented in each group, sorted."""
    return members.groupBy("group_id").agg(
        F.array_sort(F.collect_set("machine")).alias("machines")
    )


def shared(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Exact groups on several machines with one size each, and those on one."""
    exact = groups.where("certainty = 'exact'").select("group_id", "logical_size")
    spread = exact.join(machines_among(members), "group_id")
    many = F.size("machines") > 1
    return spread.agg(
        F.count_if(many).alias("shared"),
        F.coalesce(F.sum(F.when(many, F.col("logical_size"))), F.lit(0)).alias("shared_bytes"),
        F.count_if(~many).alias("on_one_machine"),
    )


def exclusive(settled: DataFrame) -> DataFrame:
    """Fingerprinted files per machine whose content no other machine holds.

    A digest held by one machine only contributes that machine's rows, so two
    aggregations answer what would otherwise be an anti join on a hot digest.
    """
    by_digest = (
        settled.where("kind = 'content'")
        .groupBy("fingerprint", "machine")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("fingerprint")
        .agg(
            F.min("machine").alias("machine"),
            F.count(F.lit(1)).alias("machines"),
            F.sum("rows").alias("rows"),
        )
    )
    return (
        by_digest.groupBy("machine")
        .agg(F.sum(F.when(F.col("machines") == 1, F.col("rows")).otherwise(0)).alias("files"))
        .where("files > 0")
    )


def exclusive_entries(settled: DataFrame) -> DataFrame:
    """The rows behind ``exclusive``: content on one machine and nowhere else."""
    content = settled.where("kind = 'content'")
    alone = (
        content.groupBy("fingerprint")
        .agg(
            F.min("machine").alias("least"),
            F.max("machine").alias("most"),
            F.count(F.lit(1)).alias("rows"),
        )
        .where("least = most")
    )
    slices = scale.slices_for(settled)
    found = scale.join_hot(
        content, alone, ["fingerprint"], "rows", "entry_id", "left_semi", slices
    )
    return found.select("machine", "entry_id", "fingerprint")


def comparison(inputs: Sequence[Recorded]) -> tuple[Merged, duplicates.Analysis]:
    """Merge analyses and group again from what they recorded; nothing is read."""
    merged = merge(inputs)
    return merged, duplicates.analysis_of(merged.entries, merged.settled)


def _facts(frame: DataFrame, prefix: str) -> DataFrame:
    """One row per (machine, path): overlapping scan roots repeat rows, so the
    first is taken."""
    fields = F.struct(
        "kind",
        "logical_size",
        F.unix_seconds("modified").alias("modified_s"),
        F.col("link_target"),
        F.col("cloud.residency").alias("residency"),
    )
    return frame.groupBy("machine", "path").agg(F.min_by(fields, "entry_id").alias(prefix))


def inventory_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What differs between two inventories: added, removed, changed, by path."""
    both = _facts(before, "was").join(_facts(after, "now"), ["machine", "path"], "full")
    change = (
        F.when(F.col("was").isNull(), F.lit("added"))
        .when(F.col("now").isNull(), F.lit("removed"))
        .when(~F.col("was").eqNullSafe(F.col("now")), F.lit("changed"))
    )
    return both.select(
        "machine",
        "path",
        change.alias("change"),
        F.col("was.logical_size").alias("size_was"),
        F.col("now.logical_size").alias("size_now"),
    ).where("change is not null")

