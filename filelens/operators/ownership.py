"""Provider roots: which root owns a path, what links lead out, and what they mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.functions import classify, paths, wording
from filelens.operators import scale
from filelens.session import pin

# Up to this many prefixes are matched in place against each row; more are
# matched by joining on the ancestors of distinct folders.
IN_PLACE_ROOTS = 64

# Names whose presence under a target marks it as a provider's own.
PROVIDER_MARKERS = (".tmp.drivedownload", ".shortcut-targets-by-id", ".dropbox.cache")

# Where providers keep their folders below a home folder.
ICLOUD_FOLDER = "Library/Mobile Documents"
ICLOUD_DRIVE = "com~apple~CloudDocs"
ICLOUD_TRASH = ".Trash"
FILE_PROVIDER_FOLDER = "Library/CloudStorage"
LEGACY_FOLDERS = {"Google Drive": "google_drive", "Dropbox": "dropbox", "OneDrive": "one_drive"}
REDIRECTED_FOLDERS = ("Desktop", "Documents")
WINDOWS_FOLDERS = {"iCloudDrive": "icloud", "Dropbox": "dropbox"}
WINDOWS_VARIABLES = {"OneDriveConsumer": "personal", "OneDriveCommercial": "work", "OneDrive": None}


def longest_root(
    frame: DataFrame,
    roots: DataFrame,
    payload: Sequence[str],
    path: str = "path",
    name: str = "owner",
    in_place: int = IN_PLACE_ROOTS,
) -> DataFrame:
    """Add ``name``: a struct (path, *payload) of the longest root holding each
    path on its machine, null outside every root. Root paths are unique per
    machine; equal lengths cannot both hold one path."""
    fields = F.struct(F.col("path").alias("path"), *payload)
    if scale.is_small(roots, in_place):
        listed = roots.groupBy("machine").agg(
            F.reverse(
                F.array_sort(F.collect_list(F.struct(F.length("path").alias("size"), fields.alias("root"))))
            ).alias("_roots")
        )
        found = F.get(
            F.filter("_roots", lambda r: paths.is_under(F.col(path), r.root.path)), F.lit(0)
        )
        return (
            frame.join(F.broadcast(listed), "machine", "left")
            .withColumn(name, found.getField("root"))
            .drop("_roots")
        )
    keyed = roots.select("machine", F.col("path").alias("_folder"), fields.alias("_root"))
    frame = frame.withColumn("_parent", paths.parent(F.col(path)))
    folders = frame.groupBy("machine", "_parent").agg(F.count(F.lit(1)).alias("_rows"))
    above = folders.where("_parent is not null").select(
        "machine", "_parent", F.explode(paths.self_and_ancestors(F.col("_parent"))).alias("_folder")
    )
    owned = (
        scale.look_up(above, keyed, ["machine", "_folder"], "_parent", "inner")
        .groupBy("machine", "_parent")
        .agg(F.max_by("_root", F.length("_folder")).alias("_above"))
    )
    owned = folders.join(owned, ["machine", "_parent"])
    by_folder = scale.join_hot(frame, owned, ["machine", "_parent"], "_rows", path, "left")
    itself = keyed.select("machine", F.col("_folder").alias(path), F.col("_root").alias("_self"))
    return (
        by_folder.join(itself, ["machine", path], "left")
        .withColumn(name, F.coalesce("_self", "_above"))
        .drop("_parent", "_rows", "_above", "_self")
    )


def owner_of(entries: DataFrame, roots: DataFrame, in_place: int = IN_PLACE_ROOTS) -> DataFrame:
    """Entries with ``root_path``, ``provider`` and ``account`` of their owner."""
    owned = longest_root(entries, roots, ["provider", "account"], in_place=in_place)
    return owned.select(
        *[c for c in entries.columns],
        F.col("owner.path").alias("root_path"),
        F.col("owner.provider").alias("provider"),
        F.col("owner.account").alias("account"),
    )


def classified(
    entries: DataFrame, roots: DataFrame, residency: Column, retention: Column
) -> DataFrame:
    """Cloud state of each path: outside every root it is not synced; inside, the
    root's provider with the residency and retention read from its metadata."""
    owned = owner_of(entries, roots)
    inside = F.col("root_path").isNotNull()
    return owned.withColumn(
        "cloud",
        F.struct(
            F.col("provider").alias("provider"),
            F.when(inside, residency).otherwise(F.lit("not_synced")).alias("residency"),
            F.when(inside, retention).otherwise(F.lit("unspecified")).alias("retention"),
        ),
    ).drop("root_path", "provider", "account")


def links_at_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Symbolic links directly inside a root, relative targets made absolute."""
    links = entries.where("kind = 'symlink' and link_target is not null").select(
        "machine", "entry_id", "path", "link_target", paths.parent(F.col("path")).alias("_root")
    )
    target = F.when(F.startswith("link_target", F.lit("/")), F.col("link_target")).otherwise(
        paths.join(F.col("_root"), F.col("link_target"))
    )
    named = roots.select("machine", F.col("path").alias("_root"), "provider")
    return scale.look_up(links, named, ["machine", "_root"], "entry_id", "inner").select(
        "machine", F.col("path").alias("link"), target.alias("target"), "provider"
    )


def outward_links(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Links that lead outside every root; the rest is internal plumbing."""
    links = longest_root(links_at_roots(entries, roots), roots, [], path="target")
    return links.where("owner is null").drop("owner")


def link_verdicts(links: DataFrame, entries: DataFrame, ignored: DataFrame) -> DataFrame:
    """Verdict per link: excluded by an ignore attribute (``ignored``: machine,
    link), owned by the provider when a marker lies under the target, else
    unsettled."""
    marker = paths.file_name(F.col("path")).isin(*PROVIDER_MARKERS)
    marked = (
        entries.where(marker)
        .select("machine", paths.parent(F.col("path")).alias("target"))
        .distinct()
        .withColumn("marked", F.lit(True))
    )
    marked = pin(marked)
    excluded = ignored.select("machine", "link").distinct().withColumn("excluded", F.lit(True))
    known = scale.look_up(
        links.join(excluded, ["machine", "link"], "left"), marked, ["machine", "target"], "link"
    )
    return known.select(
        "machine",
        "link",
        "target",
        "provider",
        F.when(F.col("excluded"), F.lit("excluded_by_provider"))
        .when(F.col("marked"), F.lit("provider_owned"))
        .otherwise(F.lit("unsettled"))
        .alias("verdict"),
    )


def provider_report(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Per machine: roots, and links excluded, provider-owned and unsettled."""
    by_verdict = lambda v: F.count_if(F.col("verdict") == v)
    counted = links.groupBy("machine").agg(
        by_verdict("excluded_by_provider").alias("excluded"),
        by_verdict("provider_owned").alias("provider_owned"),
        by_verdict("unsettled").alias("unsettled"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        roots.groupBy("machine")
        .agg(F.count(F.lit(1)).alias("roots"))
        .join(counted, "machine", "full")
        .select("machine", zero("roots"), zero("excluded"), zero("provider_owned"), zero("unsettled"))
    )


def root_list(roots: DataFrame) -> DataFrame:
    """Roots most specific first, with their origin in words."""
    return roots.orderBy("machine", F.desc(F.length("path")), paths.parts(F.col("path"))).select(
        "machine", "path", "provider", "account", wording.root_origin(F.col("origin")).alias("origin")
    )


def mac_roots(entries: DataFrame, homes: DataFrame) -> DataFrame:
    """Provider roots recognised in an inventory of macOS homes (machine, home)."""
    home = F.col("home")
    at = lambda folder: F.concat(home, F.lit(f"/{folder}"))
    inside = entries.select(
        "machine",
        "path",
        "kind",
        "link_target",
        paths.parent(F.col("path")).alias("folder"),
        paths.file_name(F.col("path")).alias("name"),
    )
    # An entry that tells of a root lies in its home, or in a folder two levels below.
    near = F.array_distinct(F.array("folder", paths.parent(paths.parent(F.col("folder")))))
    inside = inside.withColumn("home", F.explode(near)).where("home is not null")
    inside = scale.look_up(inside, homes.distinct(), ["machine", "home"], "path", "inner")
    name, folder, kind = F.col("name"), F.col("folder"), F.col("kind")
    icloud = folder == at(ICLOUD_FOLDER)
    mount = folder == at(FILE_PROVIDER_FOLDER)
    legacy = (folder == home) & (kind == "directory") & name.isin(*LEGACY_FOLDERS)
    redirect = (
        (folder == home)
        & (kind == "symlink")
        & name.isin(*REDIRECTED_FOLDERS)
        & paths.is_under(F.col("link_target"), at(ICLOUD_FOLDER))
    )
    container = icloud & ~name.isin(ICLOUD_DRIVE, ICLOUD_TRASH)
    return inside.where(icloud | mount | legacy | redirect).select(
        "machine",
        F.when(redirect, F.col("link_target")).otherwise(F.col("path")).alias("path"),
        F.when(icloud | redirect, F.lit("icloud"))
        .when(mount, classify.provider_of_mount(name))
        .otherwise(wording.lookup(LEGACY_FOLDERS, name))
        .alias("provider"),
        F.when(container | redirect, name)
        .when(mount, classify.account_of_mount(name))
        .alias("account"),
        F.when(redirect, F.lit("home_redirect"))
        .when(container, F.lit("app_container"))
        .when(icloud & (name == ICLOUD_TRASH), F.lit("provider_trash"))
        .when(legacy, F.lit("legacy_location"))
        .otherwise(F.lit("provider_mount"))
        .alias("origin"),
    )


def windows_roots(entries: DataFrame, homes: DataFrame, variables: DataFrame) -> DataFrame:
    """Provider roots of Windows homes: published variables (machine, variable,
    value) that name existing folders, equal paths once, then known folders."""
    folders = entries.where("kind = 'directory'").select("machine", "path")
    rank = {v: i for i, v in enumerate(WINDOWS_VARIABLES)}
    ranks = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    accounts = {v: a for v, a in WINDOWS_VARIABLES.items() if a}
    published = (
        variables.where(F.col("variable").isin(*WINDOWS_VARIABLES))
        .join(folders.withColumnRenamed("path", "value"), ["machine", "value"], "left_semi")
        .groupBy("machine", F.col("value").alias("path"))
        .agg(F.min_by("variable", F.try_element_at(ranks, F.col("variable"))).alias("variable"))
        .select(
            "machine",
            "path",
            F.lit("one_drive").alias("provider"),
            wording.lookup(accounts, F.col("variable")).alias("account"),
        )
    )
    named = (
        folders.withColumn("home", paths.parent(F.col("path")))
        .join(homes, ["machine", "home"], "left_semi")
        .withColumn("name", paths.file_name(F.col("path")))
        .where(F.col("name").isin(*WINDOWS_FOLDERS))
        .select(
            "machine",
            "path",
            wording.lookup(WINDOWS_FOLDERS, F.col("name")).alias("provider"),
            F.lit(None).cast("string").alias("account"),
        )
    )
    return published.unionByName(named).withColumn("origin", F.lit("provider_mount"))
