"""Identity: storage objects, size buckets, digests, exact and candidate groups.

Three narrowings, each on fewer bytes: files sharing a size with another object,
files whose ends agree, files whose content agrees. Content never enters a
shuffle; it is digested where it is scanned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from filelens.functions import classify, paths
from filelens.functions import content as digests
from filelens.operators import scale
from filelens.session import pin

OBJECT_KEYS = ["machine", "volume", "index", "lone"]
GROUP_KEYS = ["logical_size", "tier", "digest"]

# Fixed value: how an unreadable-for-another-reason object is reported.
NOT_DIGESTED = "content was not digested during this analysis"


def candidate_files(entries: DataFrame) -> DataFrame:
    """Non-empty files; an empty file matches every other and says nothing."""
    return entries.where((F.col("kind") == "file") & (F.col("logical_size") > 0))


def object_key(entries: DataFrame) -> DataFrame:
    """Names of the same bytes share a key: the file id scoped to its machine,
    or the entry itself where the platform gave no id."""
    return entries.select(
        "entry_id",
        "machine",
        F.coalesce(F.col("file_id.volume"), F.lit(0)).alias("volume"),
        F.coalesce(F.col("file_id.index"), F.lit(0)).alias("index"),
        F.when(F.col("file_id").isNull(), F.col("entry_id")).otherwise(F.lit(-1)).alias("lone"),
        "logical_size",
        "allocated_size",
        classify.read_may_download(F.col("cloud.residency")).alias("may_download"),
    )


def storage_objects(entries: DataFrame) -> DataFrame:
    """One row per set of bytes. Size and allocation are the first name's, even
    where a later name of the same id disagrees."""
    by_first = lambda name: F.min_by(name, "entry_id").alias(name)
    return (
        object_key(candidate_files(entries))
        .groupBy(*OBJECT_KEYS)
        .agg(
            F.min("entry_id").alias("first_name"),
            F.count(F.lit(1)).alias("names"),
            by_first("logical_size"),
            by_first("allocated_size"),
            by_first("may_download"),
        )
    )


def object_names(
    entries: DataFrame, objects: DataFrame, slices: int | None = scale.SLICE_ROWS
) -> DataFrame:
    """One row per name of the given objects: (entry_id, first_name).

    An object with one name is its own row; only objects with several names are
    looked up among the entries.
    """
    single = objects.where("names = 1").select(F.col("first_name").alias("entry_id"), "first_name")
    several = objects.where("names > 1").select(*OBJECT_KEYS, "first_name", "names")
    keyed = object_key(candidate_files(entries)).select("entry_id", *OBJECT_KEYS)
    found = scale.join_hot(keyed, several, OBJECT_KEYS, "names", "entry_id", slice_rows=slices)
    return single.unionByName(found.select("entry_id", "first_name"))


def size_buckets(objects: DataFrame) -> DataFrame:
    """Sizes that at least two objects share."""
    return (
        objects.groupBy("logical_size")
        .agg(F.count(F.lit(1)).alias("objects"))
        .where("objects > 1")
    )


def sharing_a_size(objects: DataFrame, slices: int | None = scale.SLICE_ROWS) -> DataFrame:
    buckets = size_buckets(objects)
    return scale.join_hot(
        objects, buckets, ["logical_size"], "objects", "first_name", "left_semi", slices
    )


def shared_objects(entries: DataFrame) -> DataFrame:
    """Objects that share their size with another, written once: both the reading
    and the grouping start from them, and they are few beside the inventory."""
    objects = pin(storage_objects(entries))
    return pin(sharing_a_size(objects, scale.slices_for(objects)))


def candidates(entries: DataFrame, depth: str = "duplicates") -> DataFrame:
    """Objects to read, by first name: those sharing a size, or with
    ``thorough`` all of them; never one whose reading could download."""
    if depth == "duplicates":
        return readable_objects(shared_objects(entries))
    if depth == "thorough":
        return readable_objects(storage_objects(entries))
    raise ValueError(f"depth is 'duplicates' or 'thorough', not {depth!r}")


def readable_objects(objects: DataFrame) -> DataFrame:
    return objects.where(~F.col("may_download")).select(
        F.col("first_name").alias("entry_id"), "machine", "logical_size"
    )


def digest_entries(
    content: DataFrame, wanted: DataFrame, digest: Column, limit: int = scale.BROADCAST_ROWS
) -> DataFrame:
    """Digest the wanted entries of a content table (entry_id, content), and no others.

    The digest is evaluated above the semi join at every size. A list whose size was
    checked is broadcast to the scan; a longer one meets the content where both are
    bucketed by ``entry_id`` (see ``sources.inventory.write_content``), which moves
    neither.
    """
    ids = wanted.select("entry_id")
    if scale.is_small(ids, limit):
        ids = F.broadcast(ids)
    kept = content.select("entry_id", "content").join(ids, "entry_id", "left_semi")
    return kept.select("entry_id", digest.alias("digest"))


def watched(read: DataFrame, progress: Observation | None) -> DataFrame:
    """Report files and bytes of a reading pass as it completes."""
    if progress is None:
        return read
    return read.observe(
        progress,
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("logical_size"), F.lit(0)).alias("bytes"),
    )


def sample_pass(
    content: DataFrame,
    wanted: DataFrame,
    end_bytes: int = digests.SAMPLE_END_BYTES,
    progress: Observation | None = None,
) -> DataFrame:
    """(entry_id, machine, logical_size, digest, complete) of each wanted file's ends."""
    size = F.octet_length("content").cast("long")
    read = digest_entries(
        content, wanted, digests.sample_digest(F.col("content"), size, end_bytes)
    )
    done = wanted.join(read, "entry_id").withColumn(
        "complete", digests.read_whole(F.col("logical_size"), end_bytes)
    )
    return watched(done, progress)


def needing_full_read(sampled: DataFrame) -> DataFrame:
    """Files whose ends agree with another's and were not yet read whole."""
    partial = sampled.where(~F.col("complete"))
    agreeing = (
        partial.groupBy("logical_size", "digest")
        .agg(F.count(F.lit(1)).alias("agree"))
        .where("agree > 1")
    )
    keys = ["logical_size", "digest"]
    slices = scale.slices_for(sampled)
    found = scale.join_hot(partial, agreeing, keys, "agree", "entry_id", "left_semi", slices)
    return found.select("entry_id", "logical_size")


def settle(
    entries: DataFrame,
    content: DataFrame,
    depth: str = "duplicates",
    end_bytes: int = digests.SAMPLE_END_BYTES,
    confirm_all: bool = False,
    shared: DataFrame | None = None,
    progress: Observation | None = None,
) -> DataFrame:
    """Fingerprints: (machine, entry_id, kind, fingerprint).

    ``content`` is a digest of every byte; ``sample`` means the ends alone told
    the file apart, which is not identity. ``confirm_all`` reads every sampled
    file whole, so that files unique on each of two machines can be compared.
    """
    if shared is not None and depth == "duplicates":
        wanted = readable_objects(shared)
    else:
        wanted = pin(candidates(entries, depth))
    sampled = pin(sample_pass(content, wanted, end_bytes, progress))
    confirm = sampled.where(~F.col("complete")) if confirm_all else needing_full_read(sampled)
    confirm = pin(confirm.select("entry_id"))
    # Where no ends agree there is no second pass over the content.
    if confirm.isEmpty():
        read = sampled.withColumn("whole", F.lit(None).cast("string"))
    else:
        full = digest_entries(content, confirm, digests.full_digest(F.col("content")))
        full = full.select("entry_id", F.col("digest").alias("whole"))
        read = sampled.join(full, "entry_id", "left")
    known = F.col("complete") | F.col("whole").isNotNull()
    return read.select(
        "machine",
        "entry_id",
        F.when(known, F.lit("content")).otherwise(F.lit("sample")).alias("kind"),
        F.coalesce("whole", "digest").alias("fingerprint"),
    )


def settled_objects(shared: DataFrame, settled: DataFrame) -> DataFrame:
    """Objects sharing a size, with the state of their first name."""
    state = settled.select(
        "machine", F.col("entry_id").alias("first_name"), F.col("kind").alias("state"), "fingerprint"
    )
    return shared.join(state, ["machine", "first_name"], "left")


def group_tables(
    entries: DataFrame, settled: DataFrame, shared: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Groups and their member objects, keyed by (logical_size, tier, digest).

    Tier 0 is exact: at least two objects with the same content digest. Tier 1 is
    the candidate group of a size: its unread objects, possibly a single one.
    """
    shared = shared_objects(entries) if shared is None else shared
    objects = pin(settled_objects(shared, settled))
    unread = F.col("state").isNull()
    keyed = objects.where(unread | (F.col("state") == "content")).select(
        "*",
        F.when(unread, F.lit(1)).otherwise(F.lit(0)).alias("tier"),
        F.when(unread, F.lit("")).otherwise(F.col("fingerprint")).alias("digest"),
    )
    held = F.coalesce("allocated_size", F.lit(0))
    download = F.when(F.col("may_download") & (F.col("tier") == 1), F.col("logical_size"))
    groups = (
        keyed.groupBy(*GROUP_KEYS)
        .agg(
            F.count(F.lit(1)).alias("objects"),
            F.sum(held).alias("held"),
            F.min_by(held, "first_name").alias("first_held"),
            F.min("first_name").alias("first_entry"),
            F.sum("names").alias("names"),
            F.count(download).alias("download_objects"),
            F.coalesce(F.sum(download), F.lit(0)).alias("bytes_to_settle"),
        )
        .where("tier = 1 or objects > 1")
    )
    checked = (
        objects.where(~unread)
        .groupBy("logical_size")
        .agg(F.count(F.lit(1)).alias("checked"))
        .withColumn("tier", F.lit(1))
    )
    groups = groups.join(checked, ["logical_size", "tier"], "left").select(
        *GROUP_KEYS,
        "objects",
        "names",
        F.when(F.col("tier") == 0, F.col("held") - F.col("first_held"))
        .otherwise(F.lit(0))
        .cast("long")
        .alias("reclaimable_bytes"),
        F.coalesce("checked", F.lit(0)).cast("long").alias("settled_of_same_size"),
        "first_entry",
        "download_objects",
        F.when(F.col("tier") == 1, F.col("objects") - F.col("download_objects"))
        .otherwise(F.lit(0))
        .alias("refused_objects"),
        "bytes_to_settle",
    )
    return groups, keyed


def members_of(groups: DataFrame, keyed: DataFrame) -> DataFrame:
    """The member objects of each group."""
    wanted = groups.select(*GROUP_KEYS, "objects")
    slices = scale.slices_for(keyed)
    return scale.join_hot(keyed, wanted, GROUP_KEYS, "objects", "first_name", "left_semi", slices)


def unsettled_reasons(download: Column, refused: Column, size: Column) -> Column:
    """Why a group's objects were not read, one element per reason that occurs."""
    reasons = F.array(
        F.struct(
            F.lit("would_require_download").alias("reason"),
            download.alias("objects"),
            (download * size).alias("bytes"),
        ),
        F.struct(
            F.lit("refused").alias("reason"),
            refused.alias("objects"),
            F.lit(0).cast("long").alias("bytes"),
        ),
    )
    return F.filter(reasons, lambda r: r.objects > 0)


@dataclass
class Analysis:
    """What is the same as what. ``members`` has one row per name."""

    settled: DataFrame
    groups: DataFrame
    members: DataFrame


def analysis_of(
    entries: DataFrame, settled: DataFrame, shared: DataFrame | None = None
) -> Analysis:
    """Numbered groups and members from fingerprints already recorded.

    Group numbers follow size, then digest, the candidate group last in its size.
    """
    slices = scale.slices_for(entries)
    groups, keyed = group_tables(entries, settled, shared)
    numbered = scale.number_rows(groups, [F.col(k) for k in GROUP_KEYS], "group_id")
    table = numbered.select(
        "group_id",
        F.when(F.col("tier") == 0, F.lit("exact")).otherwise(F.lit("candidate")).alias("certainty"),
        F.when(F.col("tier") == 0, F.col("digest")).alias("digest"),
        "logical_size",
        "objects",
        "names",
        "reclaimable_bytes",
        "settled_of_same_size",
        "first_entry",
        unsettled_reasons(
            F.col("download_objects"), F.col("refused_objects"), F.col("logical_size")
        ).alias("unsettled"),
    )
    with_ids = scale.join_hot(
        keyed,
        numbered.select(*GROUP_KEYS, "group_id", F.col("objects").alias("group_objects")),
        GROUP_KEYS,
        "group_objects",
        "first_name",
        slice_rows=slices,
    )
    placed = scale.number_within(
        with_ids.select(
            "group_id", "first_name", "names", *OBJECT_KEYS, "logical_size", "allocated_size"
        ),
        ["group_id"],
        [F.col("first_name")],
        "object_id",
        "first_name",
        slices,
    )
    names = object_names(entries, placed, slices)
    members = scale.join_hot(
        names,
        placed.select(
            "first_name", "group_id", "object_id", "machine", "logical_size", "allocated_size",
            "names",
        ),
        ["first_name"],
        "names",
        "entry_id",
        slice_rows=slices,
    ).select(
        "group_id", "object_id", "machine", "entry_id", "first_name", "logical_size",
        "allocated_size",
    )
    return Analysis(settled, table, members)


def analyze(
    entries: DataFrame,
    content: DataFrame,
    depth: str = "duplicates",
    end_bytes: int = digests.SAMPLE_END_BYTES,
    confirm_all: bool = False,
) -> Analysis:
    shared = shared_objects(entries)
    settled = pin(settle(entries, content, depth, end_bytes, confirm_all, shared))
    return analysis_of(entries, settled, shared)


def group_copies(entries: DataFrame, members: DataFrame) -> DataFrame:
    """The copies inside groups; later names of one object are ``same_file``."""
    facts = entries.select(
        "entry_id",
        "path",
        F.unix_seconds("modified").alias("modified_s"),
        F.unix_seconds("created").alias("created_s"),
        (~classify.read_may_download(F.col("cloud.residency"))).alias("local"),
    )
    return members.join(facts, "entry_id").select(
        "group_id",
        "object_id",
        "machine",
        "entry_id",
        "path",
        "modified_s",
        "created_s",
        "local",
        (F.col("entry_id") != F.col("first_name")).alias("same_file"),
    )


def findings(groups: DataFrame) -> DataFrame:
    """One row of counts; what was not checked never adds to what was proven."""
    exact = F.col("certainty") == "exact"
    to_settle = F.aggregate(
        "unsettled", F.lit(0).cast("long"), lambda acc, r: acc + r.bytes
    )
    return groups.agg(
        F.count_if(exact).alias("proven"),
        F.coalesce(F.sum(F.when(exact, F.col("objects") - 1)), F.lit(0)).alias("redundant"),
        F.coalesce(F.sum(F.when(exact, F.col("reclaimable_bytes"))), F.lit(0)).alias("reclaimable"),
        F.count_if(~exact).alias("unchecked"),
        F.coalesce(F.sum(F.when(~exact, to_settle)), F.lit(0)).alias("to_settle"),
    )


def largest_finding(groups: DataFrame, copies: DataFrame, show: int = 3) -> DataFrame:
    """The exact group that would free most, the later of equals, with the first
    names of its first objects."""
    top = (
        groups.where((F.col("certainty") == "exact") & (F.col("reclaimable_bytes") > 0))
        .orderBy(F.desc("reclaimable_bytes"), F.desc("group_id"))
        .limit(1)
        .select("group_id", "reclaimable_bytes", "objects")
    )
    shown = copies.where((F.col("object_id") < show) & ~F.col("same_file"))
    return shown.join(F.broadcast(top), "group_id").select(
        "group_id", "reclaimable_bytes", "objects", "object_id", "entry_id", "path"
    )


def group_page(entries: DataFrame, groups: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of group rows, largest saving first, ties by group number."""
    page = (
        groups.orderBy(F.desc("reclaimable_bytes"), "group_id").offset(offset).limit(limit)
    )
    names = entries.select(F.col("entry_id").alias("first_entry"), "path")
    return names.join(F.broadcast(page), "first_entry").select(
        "group_id",
        F.coalesce(paths.file_name(F.col("path")), F.lit("(unnamed)")).alias("name"),
        F.col("objects").alias("copies"),
        F.col("logical_size").alias("size"),
        F.col("reclaimable_bytes").alias("reclaimable"),
        (F.col("certainty") == "exact").alias("proven"),
    )
