"""Every registered query beside the SQL it is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens import schema
from filelens.functions import classify, paths, sizes, wording
from filelens.operators import compare, duplicates, ownership, scale, summaries, survey
from filelens.plans import carry, edits, lineage, plan, preflight
from filelens.sources import artifacts, datasource, inventory, journal, ndjson, sections, steplog
from filelens.session import pin
from filelens.streaming import live_tally
from parity import tables, views
from parity.views import category, folder, name, parent, weight

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

UNDER = "/home/src1"
QUARANTINE = "/quarantine"


class Given:
    """The tables a query reads, derived on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, table: str):
        return getattr(tables, table)(self.spark, self.sf_dir)

    @property
    def roots(self) -> DataFrame:
        return tables.roots(self.spark)

    def stored(self, table: str, build: Callable[[], DataFrame]) -> DataFrame:
        return tables.stored(self.spark, self.sf_dir, table, build)

    def source(self, table: str) -> DataFrame:
        return tables.source(self.spark, self.sf_dir, table)


def query(key: str, sql: str | None = None):
    def register(build: Callable[[Given], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(Given(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = views.compose(sql)
        return build

    return register


def longs(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("long") for c in columns})


# --- identity -------------------------------------------------------------------


@query("objects", """
SELECT machine, file_index, first_name, names, logical_size, CAST(allocated_size AS BIGINT)
  AS allocated_size, may_download FROM v_object""")
def _(t: Given):
    return duplicates.storage_objects(t.entries).select(
        "machine", F.col("index").alias("file_index"), "first_name", "names", "logical_size",
        "allocated_size", "may_download",
    )


@query("object_names", "SELECT entry_id, first_name FROM v_name")
def _(t: Given):
    return duplicates.object_names(t.entries, duplicates.storage_objects(t.entries))


@query("size_buckets", "SELECT logical_size, objects FROM v_bucket")
def _(t: Given):
    return duplicates.size_buckets(duplicates.storage_objects(t.entries))


@query("readable_candidates",
       "SELECT first_name AS entry_id, machine, logical_size FROM v_candidate")
def _(t: Given):
    return duplicates.candidates(t.entries)


@query("thorough_candidates",
       "SELECT first_name AS entry_id, machine, logical_size FROM v_thorough")
def _(t: Given):
    return duplicates.candidates(t.entries, "thorough")


@query("sample_digest", f"""
SELECT c.first_name AS entry_id, {views.sample_of(64)} AS digest, strlen(text) <= 128 AS complete
FROM v_candidate c JOIN documents d ON d.doc_id = c.first_name""")
def _(t: Given):
    wanted = duplicates.candidates(t.entries)
    return duplicates.sample_pass(t.content, wanted, tables.END_BYTES).select(
        "entry_id", "digest", "complete"
    )


@query("full_read_list", f"""
SELECT entry_id FROM (SELECT c.first_name AS entry_id, logical_size,
    count(*) OVER (PARTITION BY logical_size, {views.sample_of(64)}) AS agree
  FROM v_candidate c JOIN documents d ON d.doc_id = c.first_name)
WHERE agree > 1 AND logical_size > 128""")
def _(t: Given):
    wanted = duplicates.candidates(t.entries)
    sampled = duplicates.sample_pass(t.content, wanted, tables.END_BYTES)
    return duplicates.needing_full_read(sampled).select("entry_id")


@query("settled", "SELECT machine, entry_id, kind, fingerprint FROM v_settled")
def _(t: Given):
    return duplicates.settle(t.entries, t.content)


@query("settled_by_ends", "SELECT machine, entry_id, kind, fingerprint FROM v_settled_small")
def _(t: Given):
    return duplicates.settle(t.entries, t.content, end_bytes=tables.END_BYTES)


@query("exact_groups", """
SELECT logical_size, digest, objects, CAST(names AS BIGINT) AS names, first_entry,
  CAST(reclaimable_bytes AS BIGINT) AS reclaimable_bytes FROM v_group WHERE tier = 0""")
def exact_groups(t: Given):
    shared = duplicates.shared_objects(t.entries)
    marks = duplicates.settle(t.entries, t.content, shared=shared)
    groups, _ = duplicates.group_tables(t.entries, marks, shared)
    return groups.where("tier = 0").select(
        "logical_size", "digest", "objects", "names", "first_entry", "reclaimable_bytes"
    )


@query("analyze_two_machines", """
SELECT logical_size, digest, objects, CAST(names AS BIGINT) AS names, m.on_mac, m.on_windows
FROM v_group g JOIN (SELECT group_id, count(*) FILTER (machine = 'mac') AS on_mac, count(*) FILTER (machine = 'windows') AS on_windows
  FROM v_exact_name GROUP BY group_id) m ON m.group_id = g.group_id WHERE tier = 0""")
def _(t: Given):
    # Both machines number their files from zero, so ids are equal on the two.
    own = F.shiftright("entry_id", 1)
    files = t.entries.where("kind = 'file'").withColumn("entry_id", own)
    machine = F.when(F.pmod("entry_id", F.lit(2)) == 0, F.lit("mac")).otherwise(F.lit("windows"))
    content = t.content.select(machine.alias("machine"), own.alias("entry_id"), "content")
    numbers = pin(inventory.machine_numbers(files))
    keyed = inventory.checked(pin(inventory.keyed(files, numbers)))
    found = duplicates.analyze(keyed, inventory.keyed(content, numbers).select("entry_id", "content"))
    on = lambda m: F.count_if(F.col("machine") == m)
    members = found.members.groupBy("group_id").agg(on("mac").alias("on_mac"), on("windows").alias("on_windows"))
    return found.groups.where("certainty = 'exact'").join(members, "group_id").select(
        "logical_size", "digest", "objects", "names", "on_mac", "on_windows"
    )


@query("candidate_groups", """
SELECT logical_size, objects, settled_of_same_size, download_objects, refused_objects,
  CAST(bytes_to_settle AS BIGINT) AS bytes_to_settle FROM v_group WHERE tier = 1""")
def _(t: Given):
    groups, _ = duplicates.group_tables(t.entries, t.settled)
    return groups.where("tier = 1").select(
        "logical_size", "objects", "settled_of_same_size", "download_objects", "refused_objects",
        "bytes_to_settle",
    )


@query("group_objects", """
SELECT g.logical_size, CAST(g.tier AS BIGINT) AS tier, g.digest, m.first_name
FROM v_object_member m JOIN v_group g ON g.group_id = m.group_id""")
def _(t: Given):
    groups, keyed = duplicates.group_tables(t.entries, t.settled)
    found = duplicates.members_of(groups, keyed)
    return longs(found.select("logical_size", "tier", "digest", "first_name"), "tier")


@query("groups_numbered", """
SELECT group_id, CASE WHEN tier = 0 THEN 'exact' ELSE 'candidate' END AS certainty,
  CASE WHEN tier = 0 THEN digest END AS digest, logical_size, objects, first_entry,
  CAST(reclaimable_bytes AS BIGINT) AS reclaimable_bytes FROM v_group""")
def _(t: Given):
    return t.analysis.groups.select(
        "group_id", "certainty", "digest", "logical_size", "objects", "first_entry",
        "reclaimable_bytes",
    )


@query("group_members", """
SELECT group_id, object_id, machine, entry_id, first_name, logical_size,
  CAST(allocated_size AS BIGINT) AS allocated_size FROM v_member""")
def _(t: Given):
    return duplicates.analysis_of(t.entries, t.settled).members


def sliced(key: str, of: str, rows: int = 3):
    """A query once more, with every key above a few rows cut into slices."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scale.sliced(rows):
            return QUERIES[of](spark, sf_dir)

    QUERIES[key], ORACLE[key] = build, ORACLE[of]


sliced("group_members_sliced", "group_members")


@query("group_copies", """
SELECT m.group_id, m.object_id, m.entry_id, f.path, f.modified_s,
  f.residency NOT IN ('remote', 'partial', 'unknown') AS local, m.entry_id <> m.first_name AS same_file
FROM v_member m JOIN v_file f ON f.entry_id = m.entry_id""")
def _(t: Given):
    return duplicates.group_copies(t.entries, t.analysis.members).select(
        "group_id", "object_id", "entry_id", "path", "modified_s", "local", "same_file"
    )


@query("findings", """
SELECT count(*) FILTER (tier = 0) AS proven,
  CAST(coalesce(sum(objects - 1) FILTER (tier = 0), 0) AS BIGINT) AS redundant,
  CAST(sum(reclaimable_bytes) AS BIGINT) AS reclaimable, count(*) FILTER (tier = 1) AS unchecked,
  CAST(sum(bytes_to_settle) AS BIGINT) AS to_settle FROM v_group""")
def _(t: Given):
    return duplicates.findings(t.analysis.groups)


@query("largest_finding", """
SELECT m.group_id, CAST(g.reclaimable_bytes AS BIGINT) AS reclaimable_bytes, g.objects, m.object_id,
  m.first_name AS entry_id, f.path
FROM v_object_member m JOIN v_file f ON f.entry_id = m.first_name
JOIN (SELECT * FROM v_group WHERE tier = 0 AND reclaimable_bytes > 0
      ORDER BY reclaimable_bytes DESC, group_id DESC LIMIT 1) g ON g.group_id = m.group_id
WHERE m.object_id < 3""")
def _(t: Given):
    found = t.analysis
    return duplicates.largest_finding(
        found.groups, duplicates.group_copies(t.entries, found.members)
    )


@query("group_page", f"""
SELECT g.group_id, {name('f.path')} AS name, g.objects AS copies, g.logical_size AS size,
  CAST(g.reclaimable_bytes AS BIGINT) AS reclaimable, g.tier = 0 AS proven
FROM (SELECT * FROM v_group ORDER BY reclaimable_bytes DESC, group_id LIMIT 20 OFFSET 5) g
JOIN v_file f ON f.entry_id = g.first_entry""")
def _(t: Given):
    return duplicates.group_page(t.entries, t.analysis.groups, 5, 20)


# --- survey and summaries -------------------------------------------------------

FOLDERS = f"""
SELECT machine, folder, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM (
  SELECT machine, {weight()} AS bytes, unnest({views._ancestors('path')}) AS folder FROM v_file)
GROUP BY 1, 2"""
PRUNED = f"""
SELECT f.* FROM ({FOLDERS}) f LEFT JOIN (
  SELECT machine, {parent('folder')} AS folder, max(bytes) AS inside FROM ({FOLDERS}) GROUP BY 1, 2) c
  ON c.machine = f.machine AND c.folder = f.folder
WHERE f.bytes * 100 > coalesce(c.inside, 0) * 115"""


@query("survey_totals", f"""
SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes,
  count(*) FILTER (here) AS here_files, CAST(coalesce(sum(bytes) FILTER (here), 0) AS BIGINT)
  AS here_bytes, count(*) FILTER (NOT here) AS cloud_files,
  CAST(coalesce(sum(bytes) FILTER (NOT here), 0) AS BIGINT) AS cloud_bytes
FROM (SELECT {weight()} AS bytes, residency NOT IN ('remote', 'partial') AS here FROM v_file)""")
def _(t: Given):
    return survey.survey(t.entries).totals


@query("survey_kinds", f"""
SELECT category, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes,
  category NOT IN ('system', 'applications') AS personal
FROM (SELECT {category('path')} AS category, {weight()} AS bytes FROM v_file) GROUP BY 1""")
def _(t: Given):
    return survey.survey(t.entries).kinds


@query("survey_folders", FOLDERS)
def _(t: Given):
    return survey.folders(survey.weighted(t.entries))


@query("survey_folders_pruned", PRUNED)
def _(t: Given):
    return survey.worth_showing(survey.folders(survey.weighted(t.entries)))


@query("survey_top_folders", f"""
SELECT * FROM ({PRUNED}) ORDER BY bytes DESC, len(string_split(folder, '/')) DESC,
  string_split(folder, '/'), machine LIMIT 40""")
def _(t: Given):
    return survey.survey(t.entries).folders


@query("survey_largest", f"""
SELECT machine, entry_id, path, CAST({weight()} AS BIGINT) AS bytes,
  residency NOT IN ('remote', 'partial') AS local, {category('path')} AS category FROM v_file
ORDER BY bytes DESC, string_split(path, '/'), machine, entry_id LIMIT 40""")
def _(t: Given):
    return survey.survey(t.entries).largest


@query("inventory_summary", """
SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'directory') AS directories,
  count(*) FILTER (kind = 'symlink') AS links, CAST(0 AS BIGINT) AS synced_files,
  count(*) FILTER (residency = 'remote') AS not_downloaded FROM v_entry""")
def _(t: Given):
    return summaries.scan_summary(t.entries)


@query("window_summary", """
SELECT count(*) AS entries, count(*) FILTER (kind = 'file') AS files,
  count(*) FILTER (kind = 'directory') AS directories, count(*) FILTER (kind = 'symlink') AS links,
  CAST(sum(coalesce(allocated_size, logical_size)) FILTER (kind = 'file') AS BIGINT) AS bytes,
  count(*) FILTER (kind = 'file' AND residency IN ('remote', 'partial')) AS in_cloud FROM v_entry""")
def _(t: Given):
    return summaries.window_summary(t.entries)


@query("inventory_reclaimable", """
SELECT CAST(sum(f.allocated_size) AS BIGINT) AS reclaimable_bytes FROM v_file f
JOIN (SELECT min(entry_id) AS entry_id FROM v_file GROUP BY machine, volume, file_index) g
  ON g.entry_id = f.entry_id""")
def _(t: Given):
    return summaries.reclaimable(t.entries)


@query("unread_by_reason", """
SELECT reason, count(*) AS places, CASE reason WHEN 'permission_denied' THEN 'the system refused access'
  WHEN 'would_require_download' THEN 'cloud-only; reading would download it'
  WHEN 'vanished' THEN 'it disappeared while scanning' ELSE 'reported by the system' END AS wording
FROM v_unread GROUP BY 1""")
def _(t: Given):
    return summaries.unread_by_reason(t.unread)


@query("unread_samples", """
SELECT * FROM (SELECT reason, row_number() OVER (PARTITION BY reason ORDER BY path, machine) AS rank,
  machine, path FROM v_unread) WHERE rank <= 3""")
def _(t: Given):
    return summaries.unread_samples(t.unread)


@query("unread_list", """
SELECT machine, path, CASE reason WHEN 'permission_denied'
  THEN 'this account is not allowed to read it'
  WHEN 'would_require_download' THEN 'reading it would have downloaded it'
  WHEN 'vanished' THEN 'it went away while the scan ran' ELSE detail END AS why
FROM v_unread ORDER BY path, machine LIMIT 200""")
def _(t: Given):
    return summaries.unread_list(t.unread)


# --- machines side by side ------------------------------------------------------


def by_machine(t: Given) -> list[compare.Recorded]:
    out = []
    for machine in tables.MACHINES:
        entries = t.entries.where(F.col("machine") == machine)
        marks = t.stored(
            f"thorough_{machine}",
            lambda entries=entries: duplicates.settle(entries, t.content, "thorough"),
        )
        unread = t.unread.where(F.col("machine") == machine)
        out.append(compare.Recorded(machine, entries, marks, unread))
    return out


COMPARED = """
SELECT logical_size, fingerprint, count(DISTINCT machine) AS machines
FROM (SELECT o.machine, o.logical_size, s.fingerprint FROM v_object o
      JOIN v_settled_thorough s ON s.entry_id = o.first_name AND s.kind = 'content')
GROUP BY 1, 2 HAVING count(*) > 1"""


@query("compare_coverage", """
SELECT f.machine, f.files, o.objects, s.fingerprinted, s.sample_only,
  s.fingerprinted < f.files AS partial
FROM (SELECT machine, count(*) AS files FROM v_file WHERE logical_size > 0 GROUP BY 1) f
JOIN (SELECT machine, count(*) AS objects FROM v_object GROUP BY 1) o ON o.machine = f.machine
JOIN (SELECT machine, count(*) AS fingerprinted, count(*) FILTER (kind = 'sample') AS sample_only
      FROM v_settled_thorough GROUP BY 1) s ON s.machine = f.machine""")
def _(t: Given):
    merged = compare.merge(by_machine(t))
    return compare.coverage(merged.entries, merged.settled)


@query("compare_shared", f"""
SELECT count(*) FILTER (machines > 1) AS shared,
  CAST(coalesce(sum(logical_size) FILTER (machines > 1), 0) AS BIGINT) AS shared_bytes,
  count(*) FILTER (machines = 1) AS on_one_machine FROM ({COMPARED})""")
def _(t: Given):
    _, found = compare.comparison(by_machine(t))
    return compare.shared(found.groups, found.members)


@query("compare_exclusive", """
SELECT machine, count(*) AS files FROM v_settled_thorough s WHERE kind = 'content' AND NOT EXISTS (
  SELECT 1 FROM v_settled_thorough o WHERE o.kind = 'content' AND o.machine <> s.machine
    AND o.fingerprint = s.fingerprint) GROUP BY 1""")
def _(t: Given):
    return compare.exclusive(compare.merge(by_machine(t)).settled)


@query("exclusive_entries", """
SELECT machine, entry_id, fingerprint FROM v_settled_thorough s WHERE kind = 'content' AND NOT EXISTS (
  SELECT 1 FROM v_settled_thorough o WHERE o.kind = 'content' AND o.machine <> s.machine
    AND o.fingerprint = s.fingerprint)""")
def _(t: Given):
    marks = [item.settled for item in by_machine(t)]
    return compare.exclusive_entries(marks[0].unionByName(marks[1]))


sliced("exclusive_entries_sliced", "exclusive_entries")


@query("sources_among", """
SELECT group_id, string_agg(DISTINCT machine, ',' ORDER BY machine) AS machines FROM v_member GROUP BY 1""")
def _(t: Given):
    return compare.machines_among(t.analysis.members).select(
        "group_id", F.array_join("machines", ",").alias("machines")
    )


@query("source_of_entry", "SELECT machine AS label, count(*) AS entries FROM v_entry GROUP BY 1")
def _(t: Given):
    merged = compare.merge(by_machine(t))
    return (
        compare.source_of(merged.entries.select("entry_id"), merged.source)
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("entries"))
    )


@query("merged_many", """
SELECT e.label, entries, coalesce(settled, 0) AS settled FROM (SELECT string_split(path, '/')[3] AS label, count(*) AS entries
    FROM v_file GROUP BY 1) e
  LEFT JOIN (SELECT string_split(path, '/')[3] AS label, count(*) AS settled FROM v_settled s JOIN v_file f ON f.entry_id = s.entry_id
    GROUP BY 1) s ON s.label = e.label""")
def _(t: Given):
    # Every top folder as the analysis of a machine of its own, stored, then merged.
    base = tables.place(t.spark, t.sf_dir, "many")
    owner = F.element_at(F.split("path", "/"), 3)
    if base not in _logged:
        files = t.entries.where("kind = 'file'").withColumn("owner", owner)
        # A file without a fingerprint has an empty row, so that every folder has the table.
        marks = files.select("machine", "entry_id", "owner").join(t.settled.drop("machine"), "entry_id", "left")
        for name, frame in (("entries", files), ("settled", marks)):
            frame.repartition("owner").write.mode("overwrite").partitionBy("owner").parquet(f"{base}/{name}")
        _logged.add(base)
    labels = [r.owner for r in t.spark.read.parquet(f"{base}/entries").select("owner").distinct().orderBy("owner").collect()]  # top folders
    merged = compare.merge_stored(t.spark, {label: f"{base}/{{table}}/owner={label}" for label in labels})
    held = compare.source_of(merged.entries.select("entry_id"), merged.source).groupBy("label")
    marks = merged.settled.groupBy(F.col("machine").alias("label")).agg(F.count("kind").alias("settled"))
    return held.agg(F.count(F.lit(1)).alias("entries")).join(marks, "label").select("label", "entries", "settled")


@query("merged_unread", "SELECT machine, reason, count(*) AS places FROM v_unread GROUP BY 1, 2")
def _(t: Given):
    merged = compare.merge(by_machine(t))
    return merged.unread.groupBy("machine", "reason").agg(F.count(F.lit(1)).alias("places"))


@query("inventory_diff", """
SELECT * FROM (SELECT e.machine, e.path, CASE WHEN o.entry_id IS NULL THEN 'removed'
  WHEN o.logical_size <> e.logical_size THEN 'changed' END AS change, e.logical_size AS size_was,
  o.logical_size AS size_now
FROM v_entry e LEFT JOIN v_observed o ON o.machine = e.machine AND o.path = e.path)
WHERE change IS NOT NULL""")
def _(t: Given):
    return compare.inventory_diff(t.entries, t.observed)


# --- provider roots and links ---------------------------------------------------


@query("owner_of_root", """
SELECT e.machine, e.entry_id, arg_max(r.path, length(r.path)) AS root_path,
  arg_max(r.provider, length(r.path)) AS provider
FROM v_entry e LEFT JOIN v_root r ON r.machine = e.machine
  AND (e.path = r.path OR starts_with(e.path, r.path || '/')) GROUP BY 1, 2""")
def _(t: Given):
    return ownership.owner_of(t.entries, t.roots).select(
        "machine", "entry_id", "root_path", "provider"
    )


@query("owner_among_many", """
SELECT e.machine, e.entry_id, arg_max(r.path, length(r.path)) AS root_path
FROM v_entry e LEFT JOIN (SELECT machine, path FROM v_dir WHERE len(string_split(path, '/')) = 4) r
  ON r.machine = e.machine AND (e.path = r.path OR starts_with(e.path, r.path || '/')) GROUP BY 1, 2""")
def _(t: Given):
    folders = t.entries.where("kind = 'directory'")
    wide = folders.where(paths.depth(F.col("path")) == 4).where(
        F.col("entry_id") < tables.FIRST_LINK
    )
    roots = wide.select("machine", "path")
    owned = ownership.longest_root(t.entries, roots, [], in_place=0)
    return owned.select("machine", "entry_id", F.col("owner.path").alias("root_path"))


@query("cloud_classified", """
SELECT e.machine, e.entry_id, arg_max(r.provider, length(r.path)) AS provider,
  CASE WHEN count(r.path) = 0 THEN 'not_synced'
    WHEN any_value(e.kind) = 'file' AND any_value(e.allocated_size) = 0
      AND any_value(e.logical_size) > 0 THEN 'remote' ELSE 'local' END AS residency
FROM v_entry e LEFT JOIN v_root r ON r.machine = e.machine
  AND (e.path = r.path OR starts_with(e.path, r.path || '/')) GROUP BY 1, 2""")
def _(t: Given):
    blocks = F.floor(F.col("allocated_size") / classify.BLOCK_BYTES)
    residency = classify.mac_residency(F.lit(0), F.col("kind"), blocks, F.col("logical_size"))
    found = ownership.classified(t.entries, t.roots, residency, F.lit("unspecified"))
    return found.select("machine", "entry_id", "cloud.provider", "cloud.residency")


LINKS = f"""
SELECT l.machine, l.path AS link, CASE WHEN starts_with(l.link_target, '/') THEN l.link_target
  ELSE r.path || '/' || l.link_target END AS target, r.provider, l.entry_id
FROM v_link l JOIN v_root r ON r.machine = l.machine AND r.path = {parent('l.path')}"""
OUTWARD = f"""
SELECT k.* FROM ({LINKS}) k WHERE NOT EXISTS (SELECT 1 FROM v_root o WHERE o.machine = k.machine
  AND (k.target = o.path OR starts_with(k.target, o.path || '/')))"""
VERDICTS = f"""
SELECT k.machine, k.link, k.target, k.provider,
  CASE WHEN EXISTS (SELECT 1 FROM pages p WHERE p.page_id + {tables.FIRST_LINK} = k.entry_id
      AND starts_with(p.url, 'https')) THEN 'excluded_by_provider'
    WHEN EXISTS (SELECT 1 FROM v_marker m WHERE m.machine = k.machine
      AND m.path = k.target || '/.dropbox.cache') THEN 'provider_owned' ELSE 'unsettled' END AS verdict
FROM ({OUTWARD}) k"""


def ignored_links(t: Given) -> DataFrame:
    """Links carrying the provider's ignore attribute, as scan evidence: those made
    from pages served over https."""
    secure = t.source("pages").where(F.startswith("url", F.lit("https"))).select(
        (F.col("page_id") + tables.FIRST_LINK).alias("entry_id")
    )
    return t.entries.join(secure, "entry_id", "left_semi").select(
        "machine", F.col("path").alias("link")
    )


@query("links_at_roots", f"SELECT machine, link, target, provider FROM ({LINKS})")
def _(t: Given):
    return ownership.links_at_roots(t.entries, t.roots)


@query("outward_links", f"SELECT machine, link, target, provider FROM ({OUTWARD})")
def _(t: Given):
    return ownership.outward_links(t.entries, t.roots)


def verdicts_on_links(t: Given) -> DataFrame:
    links = ownership.outward_links(t.entries, t.roots)
    return ownership.link_verdicts(links, t.entries, ignored_links(t))


@query("link_verdicts", VERDICTS)
def _(t: Given):
    return verdicts_on_links(t)


@query("provider_report", f"""
SELECT r.machine, r.roots, count(v.link) FILTER (verdict = 'excluded_by_provider') AS excluded,
  count(v.link) FILTER (verdict = 'provider_owned') AS provider_owned,
  count(v.link) FILTER (verdict = 'unsettled') AS unsettled
FROM (SELECT machine, count(*) AS roots FROM v_root GROUP BY 1) r
LEFT JOIN ({VERDICTS}) v ON v.machine = r.machine GROUP BY 1, 2""")
def _(t: Given):
    return ownership.provider_report(t.roots, verdicts_on_links(t))


def home_listing(t: Given) -> tuple[DataFrame, DataFrame]:
    """A listing of one home per source, a place per document, and the homes."""
    turn = F.pmod("doc_id", F.lit(6))
    home = F.concat(F.lit("/Users/"), "source")
    at = lambda text, *more: F.concat(home, F.lit(text), *more)
    linked = turn >= 4
    place = (
        F.when(turn == 0, at("/Library/Mobile Documents/com~apple~CloudDocs"))
        .when(turn == 1, at("/Library/Mobile Documents/app~", F.col("lang")))
        .when(turn == 2, at("/Library/CloudStorage/OneDrive-", F.col("lang"), F.lit("-x")))
        .when(turn == 3, at("/Dropbox"))
        .when(turn == 4, at("/Desktop"))
        .otherwise(at("/Documents"))
    )
    target = F.when(turn == 4, at("/Library/Mobile Documents/Desk")).when(turn == 5, F.lit("/mnt"))
    docs = t.source("documents")
    listing = docs.select(
        F.lit("mac").alias("machine"),
        place.alias("path"),
        F.when(linked, F.lit("symlink")).otherwise(F.lit("directory")).alias("kind"),
        target.alias("link_target"),
    ).distinct()
    return listing, docs.select(F.lit("mac").alias("machine"), home.alias("home")).distinct()


@query("provider_roots", """
SELECT DISTINCT 'mac' AS machine, concat('/Users/', source, CASE doc_id % 6
    WHEN 0 THEN '/Library/Mobile Documents/com~apple~CloudDocs'
    WHEN 1 THEN concat('/Library/Mobile Documents/app~', lang)
    WHEN 2 THEN concat('/Library/CloudStorage/OneDrive-', lang, '-x') WHEN 3 THEN '/Dropbox'
    ELSE '/Library/Mobile Documents/Desk' END) AS path,
  CASE doc_id % 6 WHEN 2 THEN 'one_drive' WHEN 3 THEN 'dropbox' ELSE 'icloud' END AS provider,
  CASE doc_id % 6 WHEN 1 THEN concat('app~', lang) WHEN 2 THEN concat(lang, '-x')
    WHEN 4 THEN 'Desktop' END AS account,
  CASE doc_id % 6 WHEN 1 THEN 'app_container' WHEN 3 THEN 'legacy_location'
    WHEN 4 THEN 'home_redirect' ELSE 'provider_mount' END AS origin
FROM documents WHERE doc_id % 6 <> 5""")
def _(t: Given):
    return ownership.mac_roots(*home_listing(t))


@query("provider_roots_published", """
SELECT 'windows' AS machine, concat('/Users/', source, '/', lang) AS path, 'one_drive' AS provider,
  CASE min(CASE source WHEN 'src1' THEN 1 ELSE 2 END) WHEN 1 THEN 'work' ELSE 'personal' END AS account,
  'provider_mount' AS origin FROM documents GROUP BY source, lang""")
def _(t: Given):
    # Every folder is published twice: under its account and as the primary.
    path = F.concat(F.lit("/Users/"), "source", F.lit("/"), "lang")
    account = F.when(F.col("source") == "src1", F.lit("OneDriveCommercial")).otherwise(
        F.lit("OneDriveConsumer")
    )
    docs = t.source("documents").select("source", "lang").distinct()
    machine = F.lit("windows").alias("machine")
    folders = docs.select(machine, path.alias("path"), F.lit("directory").alias("kind"))
    homes = docs.select(machine, F.concat(F.lit("/Users/"), "source").alias("home")).distinct()
    variables = docs.select(
        machine, F.explode(F.array(account, F.lit("OneDrive"))).alias("variable"), path.alias("value")
    )
    return ownership.windows_roots(folders, homes, variables)


# --- keep rules and plans -------------------------------------------------------

for rule in plan.RULES:

    @query(f"keep_{rule}", f"SELECT group_id, kept_entry, kept FROM v_keep_{rule}")
    def _(t: Given, rule=rule):
        under = UNDER if rule == "under" else None
        return plan.kept(t.entries, t.analysis, rule, under).drop("names")


@query("quarantine_operations", """
SELECT machine, entry_id, path AS subject_path, content, kept, CAST(frees_bytes AS BIGINT)
  AS frees_bytes FROM v_quarantine""")
def _(t: Given):
    return plan.resolve(t.entries, t.analysis, "oldest").select(
        "machine", "entry_id", "subject_path", "content", "kept", "frees_bytes"
    )


sliced("quarantine_operations_sliced", "quarantine_operations")


@query("plan_effect", """
SELECT count(*) AS quarantined, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS directories,
  CAST(sum(frees_bytes) AS BIGINT) AS frees_bytes, CAST(coalesce(sum(frees_bytes) FILTER
  (entry_id = first_name), 0) AS BIGINT) AS frees_bytes_distinct FROM v_quarantine""")
def _(t: Given):
    found = t.analysis
    return plan.effect(plan.resolve(t.entries, found, "oldest"), found.members)


def edit_log(t: Given) -> DataFrame:
    """A log per machine over the inventory's own folders and files."""
    home = lambda k, m: f"/home/src{2 * k + (m == 'windows')}"
    # (kind, folder naming the entry, whether its first file is meant, path, name)
    steps = (
        ("rename", 1, False, None, "renamed"),
        ("relocate", 2, True, "/home/renamed", None),
        ("new_directory", None, False, "/home/archive", None),
        ("relocate", 4, False, "{4}/en", None),
        ("set_aside", 5, False, None, None),
        ("set_aside", 6, True, None, None),
        ("set_aside", 6, True, None, None),
        ("rename", 7, False, None, "{8}"),
        ("rename", 7, False, None, "a/b"),
        ("rename", 7, False, None, ".."),
        ("rename", 7, False, None, "  "),
        ("relocate", 7, False, "relative", None),
        ("relocate", 7, False, "/home/nowhere", None),
        ("rename", None, False, None, "nothing"),
        ("relocate", 8, False, "/home/archive", None),
        ("new_directory", None, False, "/home/archive/sub", None),
        ("rename", 8, False, None, "nine"),
        ("rename", 1, False, None, "two"),
        ("new_directory", None, False, "/home/two", None),
        ("rename", 9, True, None, " trimmed.txt "),
        ("rename", 3, False, None, "{3}"),
    )
    rows = []
    for m in tables.MACHINES:
        for at, (kind, k, first_file, path, new_name) in enumerate(steps):
            if path and path.startswith("{"):
                path = home(int(path[1]), m) + path[3:]
            if new_name and new_name.startswith("{"):
                new_name = home(int(new_name[1]), m).rpartition("/")[2]
            rows.append((m, at, kind, None if k is None else home(k, m), first_file, path, new_name))
    log = t.spark.createDataFrame(
        rows,
        "machine string, position long, kind string, at string, first_file boolean, path string, "
        "name string",
    )
    top = t.entries.select(
        "machine",
        "entry_id",
        "kind",
        "path",
        F.array_join(F.slice(paths.parts(F.col("path")), 1, 3), "/").alias("at"),
    )
    named = top.groupBy("machine", "at").agg(
        F.min(F.when(F.col("kind") == "file", F.col("entry_id"))).alias("file"),
        F.min(F.when(F.col("path") == F.col("at"), F.col("entry_id"))).alias("folder"),
    )
    subject = F.when(F.col("first_file"), F.col("file")).otherwise(F.col("folder"))
    unknown = (F.col("kind") == "rename") & F.col("at").isNull()
    return log.join(named, ["machine", "at"], "left").select(
        "machine",
        "position",
        "kind",
        F.when(unknown, F.lit(-1)).otherwise(subject).cast("long").alias("entry_id"),
        "path",
        "name",
    )


def replayed(t: Given) -> edits.Replayed:
    log = t.stored("edit_log", lambda: edit_log(t))
    return edits.replay(t.entries, log)


def combined_plan(t: Given) -> DataFrame:
    """The oldest-copy rule together with the edit log, ordered."""

    def build() -> DataFrame:
        found = replayed(t)
        asked = edits.edit_operations(t.entries, found, t.settled)
        return plan.plan(t.entries, t.analysis, "oldest", requested=asked)

    return t.stored("plan", build)


PLAN_COLUMNS = (
    "position", "kind", "machine", "entry_id", "subject_path", "destination", "content",
    "logical_size", "modified_s", "because", "kept", "frees_bytes", "is_folder",
)


@query("plan_ordered", f"""
SELECT {", ".join(c for c in PLAN_COLUMNS if c != "frees_bytes")},
  CAST(frees_bytes AS BIGINT) AS frees_bytes FROM v_plan""")
def _(t: Given):
    asked = edits.edit_operations(t.entries, replayed(t), t.settled)
    return plan.plan(t.entries, t.analysis, "oldest", requested=asked).select(*PLAN_COLUMNS)


def contested(t: Given) -> DataFrame:
    """Quarantined copies sent to one folder under their own names, so that some
    places are claimed twice and some are taken."""
    asked = plan.resolve(t.entries, t.analysis, "oldest")
    folder_path = F.array_join(F.slice(paths.parts(F.col("kept")), 1, 3), "/")
    place = paths.join(folder_path, F.element_at(paths.parts(F.col("kept")), -2))
    moved = asked.withColumn("kind", F.lit("move")).withColumn("destination", place)
    return t.stored("contested", lambda: plan.ordered(moved))


CLAIMS = f"""
SELECT row_number() OVER (ORDER BY string_split(destination, '/'), machine, entry_id) - 1 AS position,
  * FROM (SELECT machine, entry_id, path AS subject_path,
    array_to_string(string_split(kept, '/')[1:3], '/') || '/' || string_split(kept, '/')[-2]
      AS destination FROM v_quarantine)"""
CONFLICTS = f"""
SELECT machine, destination, count(*) AS claimants, min(position) AS first_claimant,
  (SELECT max(e.entry_id) FROM v_entry e WHERE e.machine = c.machine AND e.path = c.destination
    AND e.path NOT IN (SELECT q.path FROM v_quarantine q WHERE q.machine = c.machine)) AS occupied_by
FROM ({CLAIMS}) c GROUP BY machine, destination"""


@query("plan_conflicts", f"""
SELECT * FROM ({CONFLICTS}) WHERE claimants > 1 OR occupied_by IS NOT NULL""")
def _(t: Given):
    return plan.conflicts(t.entries, contested(t))


@query("conflict_claims", f"""
SELECT c.machine, c.destination, c.position FROM ({CLAIMS}) c JOIN ({CONFLICTS}) x
  ON x.machine = c.machine AND x.destination = c.destination
WHERE x.claimants > 1 OR x.occupied_by IS NOT NULL""")
def _(t: Given):
    return plan.conflict_claims(t.entries, contested(t))


# --- edits ----------------------------------------------------------------------


@query("edits_applied", "SELECT machine, entry_id, now_path FROM v_arranged")
def _(t: Given):
    return edits.arranged(t.entries, replayed(t)).select("machine", "entry_id", "now_path")


@query("edit_changes", """
SELECT machine, entry_id, path AS was, now_path AS becomes, NOT asked AS carried FROM v_arranged
WHERE now_path IS NULL OR now_path <> path""")
def _(t: Given):
    return edits.changes(t.entries, replayed(t))


@query("edit_changes_page", """
SELECT machine, entry_id, path AS was, now_path AS becomes, NOT asked AS carried FROM v_arranged
WHERE now_path IS NULL OR now_path <> path ORDER BY string_split(path, '/'), machine LIMIT 15 OFFSET 10""")
def _(t: Given):
    return edits.changes_page(edits.changes(t.entries, replayed(t)), 10, 15)


@query("edit_refusals", f"""
SELECT m.machine, r.position, CASE WHEN r.position = 3 AND NOT EXISTS (SELECT 1 FROM v_dir d
  WHERE d.machine = m.machine AND d.path = {folder(4, 'm.machine')} || '/en')
  THEN 'not_a_directory' ELSE r.reason END AS reason
FROM v_machine m, (VALUES (3, 'into_itself'), (4, 'folders_are_not_set_aside'), (6, 'already_aside'),
  (7, 'occupied'), (8, 'not_a_name'), (9, 'not_a_name'), (10, 'not_a_name'), (11, 'not_absolute'),
  (12, 'not_a_directory'), (13, 'no_such_entry'), (18, 'occupied')) AS r(position, reason)""")
def _(t: Given):
    return replayed(t).refusals.select("machine", "position", "reason")


@query("edit_operations", """
SELECT kind, machine, entry_id, subject_path, destination, content, CAST(frees_bytes AS BIGINT)
  AS frees_bytes FROM v_edit_operation""")
def _(t: Given):
    return edits.edit_operations(t.entries, replayed(t), t.settled).select(
        "kind", "machine", "entry_id", "subject_path", "destination", "content", "frees_bytes"
    )


@query("edit_counters", """
SELECT machine, CAST(21 AS BIGINT) AS asked, CAST(11 AS BIGINT) AS refused,
  count(*) FILTER (now_path IS NULL OR now_path <> path) AS differences,
  CAST(2 AS BIGINT) AS new_folders, count(*) FILTER (now_path IS NULL) AS set_aside
FROM v_arranged GROUP BY 1""")
def _(t: Given):
    return edits.counters(t.entries, replayed(t))


@query("edits_taken_back", f"""
SELECT a.machine, a.entry_id, now_path FROM v_arranged a""")
def _(t: Given):
    # The last edit asks for the name a folder already has, so taking it back
    # leaves every path as it was.
    log = t.stored("edit_log", lambda: edit_log(t))
    found = edits.take_back_last(t.entries, log)
    return edits.arranged(t.entries, found).select("machine", "entry_id", "now_path")


@query("browse_folder", f"""
SELECT name, is_folder, size, moved, entry_id FROM (
  SELECT 1 AS section, entry_id, {name('now_path')} AS name, kind = 'directory' AS is_folder,
    logical_size AS size, now_path <> path AS moved FROM v_arranged
  WHERE machine = 'mac' AND {parent('now_path')} = '/home'
  UNION ALL SELECT 0, NULL, 'archive', true, 0, true)
ORDER BY section, is_folder DESC, name, entry_id LIMIT 8 OFFSET 0""")
def _(t: Given):
    return edits.browse(t.entries, replayed(t), "mac", "/home", 0, 8)[0]


# --- preflight, apply, undo -----------------------------------------------------


def graded(t: Given, rigour: str = "metadata") -> DataFrame:
    content = t.observed_content if rigour == "content" else None
    return preflight.preflight(combined_plan(t), t.observed, rigour, content)


VERDICT_COLUMNS = "position AS operation, grade, impediment"


@query("preflight_metadata", f"SELECT {VERDICT_COLUMNS} FROM v_verdict")
def _(t: Given):
    return graded(t).select("operation", "grade", "impediment")


@query("preflight_content", f"SELECT {VERDICT_COLUMNS} FROM v_verdict_content")
def _(t: Given):
    return graded(t, "content").select("operation", "grade", "impediment")


@query("preflight_changes", """
SELECT position AS operation, logical_size AS expected_size, s_size AS found_size,
  modified_s AS expected_modified, s_modified AS found_modified, content AS expected_content,
  CASE WHEN NOT differs THEN actual END AS found_content
FROM v_verdict_content WHERE impediment = 'source_changed'""")
def _(t: Given):
    return graded(t, "content").where("impediment = 'source_changed'").select(
        "operation",
        F.col("expected.logical_size").alias("expected_size"),
        F.col("found.logical_size").alias("found_size"),
        F.col("expected.modified_s").alias("expected_modified"),
        F.col("found.modified_s").alias("found_modified"),
        F.col("expected.content").alias("expected_content"),
        F.col("found.content").alias("found_content"),
    )


@query("standing", """
SELECT count(*) FILTER (grade = 'pass') AS passing, count(*) FILTER (grade = 'hold') AS held,
  count(*) FILTER (grade = 'fail') AS failed, count(*) AS total, count(*) FILTER (grade <> 'pass') = 0
  AS clear FROM v_verdict""")
def _(t: Given):
    return preflight.standing(graded(t))


@query("impediments", """
SELECT impediment, count(*) AS operations FROM v_verdict WHERE grade <> 'pass' GROUP BY 1""")
def _(t: Given):
    return preflight.impediments(graded(t)).drop("wording")


@query("impediment_samples", """
SELECT * FROM (SELECT impediment, row_number() OVER (PARTITION BY impediment ORDER BY position) AS rank,
  position AS operation, subject_path FROM v_verdict WHERE grade <> 'pass') WHERE rank <= 3""")
def _(t: Given):
    return preflight.impediment_samples(graded(t), combined_plan(t))


@query("steps_with_verdicts", """
SELECT position AS operation, kind, subject_path, destination, CAST(frees_bytes AS BIGINT)
  AS frees_bytes, grade, CASE WHEN kind = 'create_directory' THEN 'somewhere has to exist first'
  WHEN kind = 'move' THEN 'you asked for it to go there'
  WHEN because = 'redundant_copy' THEN concat('exactly these bytes are also at ', kept,
    ', and that copy is being kept') ELSE 'you asked for it' END AS because FROM v_verdict""")
def _(t: Given):
    return plan.described(combined_plan(t), graded(t)).drop("impediment")


@query("passing_effect", """
SELECT count(*) AS passing, CAST(coalesce(sum(frees_bytes), 0) AS BIGINT) AS frees_bytes
FROM v_verdict WHERE grade = 'pass'""")
def _(t: Given):
    return preflight.passing_effect(combined_plan(t), graded(t))


def applied(t: Given) -> carry.Run:
    operations = preflight.passing(combined_plan(t), graded(t))
    kept: list[carry.Run] = []

    def run() -> carry.Run:
        if not kept:
            kept.append(
                carry.apply_snapshot(operations, t.observed, QUARANTINE, t.observed_content)
            )
        return kept[0]

    return carry.Run(
        t.stored("apply_steps", lambda: run().steps), t.stored("apply_after", lambda: run().after)
    )


STEPS = """
SELECT position AS sequence, CASE WHEN reason IS NULL THEN 'done' ELSE 'skipped' END AS progress, reason,
  CASE WHEN kind = 'create_directory' THEN destination ELSE subject_path END AS from_path,
  CASE WHEN kind <> 'create_directory' AND reason IS NULL THEN lands END AS to_path, content FROM v_step"""


@query("apply_steps", STEPS)
def _(t: Given):
    operations = preflight.passing(combined_plan(t), graded(t))
    run = carry.apply_snapshot(operations, t.observed, QUARANTINE, t.observed_content)
    return run.steps.select("sequence", "progress", "reason", "from_path", "to_path", "content")


@query("apply_state", "SELECT machine, entry_id, kind, path FROM v_after")
def _(t: Given):
    return applied(t).after.select("machine", "entry_id", "kind", "path")


@query("undo_state", "SELECT machine, entry_id, kind, path, logical_size FROM v_observed")
def _(t: Given):
    run = applied(t)
    back = carry.undo_snapshot(run.steps, run.after)
    return back.after.select("machine", "entry_id", "kind", "path", "logical_size")


@query("undo_steps", """
SELECT position AS operation, 'done' AS progress, CASE WHEN kind = 'create_directory' THEN destination
  ELSE lands END AS from_path, CASE WHEN kind <> 'create_directory' THEN subject_path END AS to_path
FROM v_step WHERE reason IS NULL""")
def _(t: Given):
    run = applied(t)
    return carry.undo_snapshot(run.steps, run.after).steps.select(
        "operation", "progress", "from_path", "to_path"
    )


@query("reversal_order", """
SELECT row_number() OVER (ORDER BY position DESC) AS turn, position AS sequence FROM v_step
WHERE reason IS NULL AND kind <> 'create_directory'""")
def _(t: Given):
    steps = carry.reversible(applied(t).steps)
    return scale.number_rows(steps, [F.desc("sequence")], "turn", start=1).select("turn", "sequence")


TALLY = """
SELECT count(*) FILTER (reason IS NULL) AS done, count(*) FILTER (reason IS NOT NULL) AS skipped,
  CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS unresolved,
  CAST(coalesce(sum(frees_bytes) FILTER (reason IS NULL), 0) AS BIGINT) AS freed, true AS settled
FROM v_step"""


def step_log(t: Given) -> str:
    """An append-only log: every step before it was attempted, then its outcome."""
    operations = preflight.passing(combined_plan(t), graded(t))
    run = applied(t)
    where = tables.place(t.spark, t.sf_dir, "step_log")
    if where not in _logged:
        journal.append_steps(journal.intended(operations), where)
        journal.append_steps(run.steps, where)
        _logged.add(where)
    return where


_logged: set[str] = set()


@query("tally", TALLY)
def _(t: Given):
    steps = journal.latest_steps(journal.read_steps(t.spark, step_log(t)))
    return journal.tally(journal.priced(steps, combined_plan(t)), F.col("frees_bytes"))


@query("log_states", """
SELECT log, state, records, CASE WHEN state <> 'tampered' THEN times * n END AS steps,
  CASE WHEN state <> 'tampered' THEN (times - 1) * carried END AS done
FROM (VALUES ('finished', 'sealed', 4, 2), ('stopped', 'unsealed', 2, 1), ('torn', 'unsealed', 2, 1),
    ('changed', 'tampered', 4, 2), ('shortened', 'tampered', 3, 1)) AS l(log, state, records, times),
  (SELECT count(*) AS n, count(*) FILTER (reason IS NULL) AS carried FROM v_step) AS s""")
def _(t: Given):
    # Runs that finished, stopped, lost their writer, and logs that were changed later.
    steps = journal.read_steps(t.spark, step_log(t))
    first, last = steps.where("progress = 'intended'"), steps.where("progress <> 'intended'")
    where = tables.place(t.spark, t.sf_dir, f"logs-{uuid.uuid4().hex}")
    rows = []
    for name in ("finished", "stopped", "torn", "changed", "shortened"):
        log = steplog.append(t.spark, steplog.begin(t.spark, f"{where}/{name}", "plan"), first)
        if name == "torn":
            last.write.parquet(f"{log.path}/steps/000000002-lost")
        elif name != "stopped":
            log = steplog.seal(t.spark, steplog.append(t.spark, log, last))
        if name == "changed":
            first.limit(1).select(*schema.STEP.fieldNames()).write.mode("append").parquet(log.folders[0])
        if name == "shortened":
            record = t.spark._jvm.org.apache.hadoop.fs.Path(f"{log.path}/records/000000001")
            record.getFileSystem(t.spark._jsc.hadoopConfiguration()).delete(record, False)
        found = steplog.load(t.spark, log.path)
        told = steplog.state(t.spark, found)
        counts = found.steps(t.spark).agg(F.count(F.lit(1)), F.count_if(F.col("progress") == "done")).first()
        rows.append((name, told, len(found.records), *(counts if told != "tampered" else (None, None))))
    return t.spark.createDataFrame(rows, "log string, state string, records int, steps long, done long")


@query("step_reasons", """
SELECT CASE reason WHEN 'source_missing' THEN 'the file is no longer where the plan found it'
  WHEN 'source_changed' THEN 'the file changed after the plan was made'
  WHEN 'content_not_present' THEN 'the content is in the cloud, not on this machine'
  ELSE 'the system reported a problem' END AS why, count(*) AS steps
FROM v_step WHERE reason IS NOT NULL GROUP BY 1""")
def _(t: Given):
    return journal.stop_reasons(journal.latest_steps(journal.read_steps(t.spark, step_log(t))))


@query("unresolved_steps", "SELECT position AS sequence FROM v_step")
def _(t: Given):
    # A run that stopped after writing down every step and resolving none.
    operations = preflight.passing(combined_plan(t), graded(t))
    return journal.unresolved(journal.intended(operations)).select("sequence")


@query("live_tally", TALLY)
def _(t: Given):
    priced = journal.priced(journal.read_steps(t.spark, step_log(t)), combined_plan(t))
    base = f"{step_log(t)}-live"
    if base not in _logged:
        columns = [f.name for f in schema.STEP_PRICED.fields]
        for progress in ("intended", None):
            part = priced.where(
                F.col("progress") == progress if progress else F.col("progress") != "intended"
            )
            part.select(*columns).write.mode("append").parquet(f"{base}/in")
        live_tally.start(t.spark, f"{base}/in", f"{base}/out", f"{base}/state", True).awaitTermination()
        _logged.add(base)
    return live_tally.tally(t.spark.read.schema(live_tally.CHANGE).parquet(f"{base}/out"))


# --- expressions over the whole inventory ---------------------------------------


@query("path_parts", f"""
SELECT entry_id, CASE WHEN path = '/' THEN 1 ELSE len(string_split(path, '/')) END AS depth,
  {parent('path')} AS parent, nullif({name('path')}, '') AS file_name,
  nullif(lower(regexp_extract({name('path')}, '(?s)^.+\\.([^.]*)$', 1)), '') AS extension,
  CASE WHEN len(list_filter(string_split(path, '/'), lambda p: p <> '')) <= 2 THEN path
    ELSE '…/' || array_to_string(string_split(path, '/')[-2:], '/') END AS short,
  '/q/' || array_to_string(list_filter(string_split(path, '/'), lambda p: p <> ''), '/') AS held,
  path = '/home/src1' OR starts_with(path, '/home/src1/') AS under_root FROM v_entry""")
def _(t: Given):
    path = F.col("path")
    return t.entries.select(
        "entry_id",
        paths.depth(path).alias("depth"),
        paths.parent(path).alias("parent"),
        paths.file_name(path).alias("file_name"),
        paths.extension(path).alias("extension"),
        paths.short_path(path).alias("short"),
        paths.quarantine_place(path, F.lit("/q")).alias("held"),
        paths.is_under(path, F.lit(UNDER)).alias("under_root"),
    )


@query("category_of", f"""
SELECT entry_id, {category('path')} AS category, CASE {category('path')} WHEN 'system'
  THEN 'system files' WHEN 'other' THEN 'everything else' ELSE {category('path')} END AS shown
FROM v_entry""")
def _(t: Given):
    found = classify.category_of(F.col("path"))
    return t.entries.select(
        "entry_id", found.alias("category"), wording.category_name(found).alias("shown")
    )


@query("residency_macos", f"""
SELECT entry_id, CASE WHEN entry_id % 5 = 0 OR (kind = 'file' AND allocated_size = 0
  AND logical_size > 0) THEN 'remote' ELSE 'local' END AS residency,
  CAST(allocated_size // 512 * 512 AS BIGINT) AS allocated FROM v_entry""")
def _(t: Given):
    flags = F.when(F.pmod("entry_id", F.lit(5)) == 0, F.lit(classify.MAC_DATALESS | 1)).otherwise(1)
    blocks = F.floor(F.col("allocated_size") / classify.BLOCK_BYTES)
    return t.entries.select(
        "entry_id",
        classify.mac_residency(flags, F.col("kind"), blocks, F.col("logical_size")).alias("residency"),
        classify.mac_allocated(blocks).alias("allocated"),
    )


@query("residency_windows", """
SELECT entry_id, CASE WHEN entry_id % 2 = 1 OR entry_id % 3 = 1 THEN 'remote'
  WHEN entry_id % 5 = 1 THEN 'partial' ELSE 'local' END AS residency,
  CASE WHEN entry_id % 7 = 1 AND entry_id % 11 <> 1 THEN 'pinned'
    WHEN entry_id % 11 = 1 AND entry_id % 7 <> 1 THEN 'unpinned' ELSE 'unspecified' END AS retention
FROM v_entry""")
def _(t: Given):
    bit = lambda n, mask: F.when(F.pmod("entry_id", F.lit(n)) == 1, F.lit(mask)).otherwise(0)
    attributes = (
        bit(2, classify.WIN_RECALL_ON_OPEN)
        + bit(3, classify.WIN_OFFLINE)
        + bit(5, classify.WIN_RECALL_ON_DATA_ACCESS)
        + bit(7, classify.WIN_PINNED)
        + bit(11, classify.WIN_UNPINNED)
    )
    return t.entries.select(
        "entry_id",
        classify.windows_residency(attributes).alias("residency"),
        classify.windows_retention(attributes).alias("retention"),
    )


def asked_name() -> Column:
    turn = F.pmod("entry_id", F.lit(6))
    return (
        F.when(turn == 0, F.lit(""))
        .when(turn == 1, F.lit(" . "))
        .when(turn == 2, F.lit(".."))
        .when(turn == 3, F.concat(paths.file_name(F.col("path")), F.lit("/b")))
        .when(turn == 4, F.concat(F.lit("  "), paths.file_name(F.col("path")), F.lit(" ")))
        .otherwise(paths.file_name(F.col("path")))
    )


@query("name_check", f"""
SELECT entry_id, CASE entry_id % 6 WHEN 0 THEN 'a name cannot be empty'
  WHEN 1 THEN 'every folder already has those two names'
  WHEN 2 THEN 'every folder already has those two names'
  WHEN 3 THEN 'a name cannot contain a path separator — to move something, move it' END AS trouble
FROM v_entry WHERE path <> '/'""")
def _(t: Given):
    return t.entries.where("path <> '/'").select(
        "entry_id", paths.name_trouble(asked_name()).alias("trouble")
    )


SCALED = "logical_size * CAST(pow(1000, entry_id % 5) AS BIGINT)"


def _report_case() -> str:
    arms = " ".join(
        f"WHEN v >= {s} THEN concat(v // {s}, '.', (v % {s}) * 10 // {s}, ' {u}')"
        for u, s in sizes.REPORT_UNITS
    )
    return f"CASE {arms} ELSE concat(v, ' bytes') END"


def _window_case() -> str:
    arms = " ".join(
        f"WHEN v >= {s} THEN concat(CASE WHEN v // {s} >= 10 OR v // {s // 10} % 10 = 0 "
        f"THEN CAST(v // {s} AS VARCHAR) ELSE concat(v // {s}, '.', v // {s // 10} % 10) END, ' {u}')"
        for u, s in sizes.WINDOW_UNITS
    )
    return f"CASE {arms} ELSE concat(v, ' bytes') END"


@query("human_bytes", f"""
SELECT entry_id, {_report_case()} AS report, {_window_case()} AS window_text
FROM (SELECT entry_id, {SCALED} AS v FROM v_entry)""")
def _(t: Given):
    value = F.col("logical_size") * F.pow(F.lit(1000), F.pmod("entry_id", F.lit(5))).cast("long")
    return t.entries.select(
        "entry_id",
        sizes.human_bytes(value).alias("report"),
        sizes.window_bytes(value).alias("window_text"),
    )


@query("unread_classified", """
SELECT CASE WHEN user_id % 4 = 0 THEN 'would_require_download'
  WHEN event_type = 'error' THEN 'permission_denied' WHEN event_type = 'view' THEN 'vanished'
  ELSE 'other' END AS reason, count(*) AS places FROM events GROUP BY 1""")
def _(t: Given):
    kind = F.col("event_type")
    error = F.when(kind == "error", F.lit("permission_denied")).when(kind == "view", F.lit("not_found"))
    turn = F.pmod("user_id", F.lit(8))
    errno = F.when(turn == 0, F.lit(classify.EDEADLK)).when(turn == 4, F.lit(classify.ETIMEDOUT))
    return (
        t.source("events")
        .groupBy(classify.unread_reason(errno, error).alias("reason"))
        .agg(F.count(F.lit(1)).alias("places"))
    )


@query("provider_mounts", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'google_drive' WHEN 1 THEN 'one_drive'
  WHEN 2 THEN 'dropbox' WHEN 3 THEN 'icloud' ELSE 'Box' END AS provider,
  CASE WHEN lang <> 'en' THEN concat(source, '-', lang) END AS account FROM documents""")
def _(t: Given):
    prefix = F.element_at(
        F.array(*[F.lit(p) for p in ("GoogleDrive", "OneDrive", "Dropbox", "iCloudDrive", "Box")]),
        (F.pmod("doc_id", F.lit(5)) + 1).cast("int"),
    )
    mount = F.when(
        F.col("lang") == "en",
        F.when(F.pmod("doc_id", F.lit(2)) == 0, prefix).otherwise(F.concat(prefix, F.lit("-"))),
    ).otherwise(F.concat(prefix, F.lit("-"), "source", F.lit("-"), "lang"))
    return t.source("documents").select(
        "doc_id",
        classify.provider_of_mount(mount).alias("provider"),
        classify.account_of_mount(mount).alias("account"),
    )


@query("times_normalised", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0
  ELSE CAST(trunc(value * 1000 - 20000) AS BIGINT) END AS second FROM events""")
def _(t: Given):
    seconds = F.when(F.pmod("event_id", F.lit(9)) == 0, F.lit(1e15)).otherwise(
        F.col("value") * 1000 - 20000
    )
    return t.source("events").select("event_id", classify.whole_second(seconds).alias("second"))


@query("path_bytes", """
SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN lower(hex(encode(path))) || 'ff' END AS exact,
  CASE WHEN entry_id % 3 = 0 THEN path || '�' ELSE path END AS text FROM v_entry""")
def _(t: Given):
    raw = F.when(
        F.pmod("entry_id", F.lit(3)) == 0, F.concat(F.col("path").cast("binary"), F.unhex(F.lit("ff")))
    ).otherwise(F.col("path").cast("binary"))
    return t.entries.select(
        "entry_id",
        F.lower(F.hex(paths.exact_bytes(raw))).alias("exact"),
        paths.rendered(raw).alias("text"),
    )


@query("digests_valid", """
SELECT doc_id, doc_id % 3 <> 0 AS valid FROM documents""")
def _(t: Given):
    digest = F.sha2("text", 256)
    shown = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.substring(digest, 1, 63)).otherwise(digest)
    return t.source("documents").select("doc_id", classify.is_digest(shown).alias("valid"))


# --- artifacts and lineage ------------------------------------------------------


@query("stage_table", """
SELECT * FROM (VALUES ('scan', NULL, 'inventory', false, 0, 0),
  ('analyze', 'inventory', 'analysis', false, 1, 1), ('merge', 'analysis', 'analysis', false, 2, NULL),
  ('plan', 'analysis', 'plan', false, 1, 1), ('preflight', 'plan', 'preflight', false, 1, 1),
  ('apply', 'preflight', 'journal', true, 1, 1), ('undo', 'journal', 'journal', true, 1, 1))
  AS s(stage, input_kind, output_kind, mutates, least_inputs, most_inputs)
WHERE stage IN (SELECT CASE least(turn, 6) WHEN 0 THEN 'scan' WHEN 1 THEN 'analyze' WHEN 2 THEN 'plan'
  WHEN 3 THEN 'preflight' WHEN 4 THEN 'apply' WHEN 5 THEN 'undo' ELSE 'merge' END FROM conversations)""")
def _(t: Given):
    used = headers(t).select("stage").distinct()
    return lineage.stages(t.spark).join(used, "stage", "left_semi")


STAGE_OF = ("scan", "analyze", "plan", "preflight", "apply", "undo", "merge")


def headers(t: Given) -> DataFrame:
    """One artifact per conversation turn, made from the turn before it."""
    turn = F.least(F.col("turn"), F.lit(6))
    digest = lambda back: F.sha2(
        F.concat_ws(":", "conv_id", (F.col("turn") - back).cast("string")), 256
    )
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGE_OF]), (turn + 1).cast("int"))
    stages = F.broadcast(lineage.stages(t.spark).select("stage", "output_kind"))
    mislabelled = F.length("text") % 5 == 0
    return (
        t.source("conversations")
        .select("*", stage.alias("stage"), digest(0).alias("content_digest"), digest(1).alias("before"))
        .join(stages, "stage")
        .select(
            "conv_id",
            "turn",
            "stage",
            "content_digest",
            F.when(mislabelled, F.lit("plan")).otherwise(F.col("output_kind")).alias("kind"),
            F.when(F.length("text") % 7 == 0, F.lit(0))
            .otherwise(F.lit(schema.SCHEMA_VERSION))
            .alias("schema_version"),
            F.when(F.col("turn") == 0, F.array().cast("array<string>"))
            .otherwise(F.array("before"))
            .alias("parents"),
            F.array(F.when(F.col("role") == "user", F.lit("mac")).otherwise("windows")).alias("machines"),
            (stage == "merge").alias("merged"),
        )
    )


HEADERS = """
SELECT conv_id, turn, stage, digest, CASE WHEN length(text) % 5 = 0 THEN 'plan' ELSE output END AS kind,
  length(text) % 7 = 0 AS old, CASE WHEN turn = 0 THEN 0 ELSE 1 END AS named,
  CASE WHEN role = 'user' THEN 'mac' ELSE 'windows' END AS machine, input, least, most
FROM (SELECT *, sha256(concat(conv_id, ':', turn)) AS digest, CASE least(turn, 6) WHEN 0 THEN 'scan'
    WHEN 1 THEN 'analyze' WHEN 2 THEN 'plan' WHEN 3 THEN 'preflight' WHEN 4 THEN 'apply'
    WHEN 5 THEN 'undo' ELSE 'merge' END AS stage FROM conversations) c
JOIN (VALUES ('scan', NULL, 'inventory', 0, 0), ('analyze', 'inventory', 'analysis', 1, 1),
  ('merge', 'analysis', 'analysis', 2, 1000000), ('plan', 'analysis', 'plan', 1, 1),
  ('preflight', 'plan', 'preflight', 1, 1), ('apply', 'preflight', 'journal', 1, 1),
  ('undo', 'journal', 'journal', 1, 1)) AS s(name, input, output, least, most) ON s.name = c.stage"""


def supplied(t: Given) -> DataFrame:
    """What each turn was really given: the turn before, or a wrong one."""
    found = headers(t)
    wrong = F.sha2(F.concat(F.lit("other"), "content_digest"), 256)
    return found.where(F.size("parents") > 0).select(
        F.col("content_digest").alias("child"),
        F.lit(0).cast("long").alias("ordinal"),
        F.when(F.col("schema_version") == 0, wrong).otherwise(F.get("parents", F.lit(0))).alias("digest"),
    )


@query("lineage_violations", f"""
WITH h AS ({HEADERS})
SELECT digest AS artifact, 'schema_mismatch' AS violation, CAST(-1 AS BIGINT) AS ordinal FROM h WHERE old
UNION ALL SELECT digest, 'wrong_parent_count', -1 FROM h WHERE named < least OR named > most
UNION ALL SELECT h.digest, 'wrong_input_kind', 0 FROM h JOIN h p ON p.conv_id = h.conv_id
  AND p.turn = h.turn - 1 WHERE NOT h.old AND p.kind <> h.input AND h.named = 1
UNION ALL SELECT digest, 'parent_digest_mismatch', 0 FROM h WHERE old AND named = 1""")
def _(t: Given):
    return lineage.chain_audit(headers(t), supplied(t))


@query("executable_here", f"""
SELECT digest AS artifact, 'mac' AS machine, CASE WHEN stage = 'merge' THEN 'merged_scope_not_executable'
  ELSE 'foreign_machine' END AS violation FROM ({HEADERS}) WHERE stage = 'merge' OR machine <> 'mac'""")
def _(t: Given):
    found = headers(t)
    here = found.select("content_digest", F.lit("mac").alias("machine"))
    return lineage.executability_audit(found, here)


def told(value: str) -> str:
    return f"coalesce(length(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def entry_facts(entry_id: str) -> str:
    """A row of an inventory as the text its digest covers."""
    return " || ".join([
        f"'allocated_size=' || {told('allocated_size')}",
        f"'cloud={{-' || {told('residency')} || '11:unspecified}}created=-'",
        entry_id,
        f"'file_id=' || CASE WHEN file_index IS NULL THEN '-' ELSE '{{' || {told('volume')} || {told('file_index')} || '}}' END",
        f"'kind=' || {told('kind')} || 'link_count=1:1link_target=' || {told('link_target')}",
        f"'logical_size=' || {told('logical_size')} || 'machine=' || {told('machine')}",
        f"'modified=' || {told('modified_s * 1000000')} || 'path=' || {told('path')} || 'path_bytes=-'",
    ])


ENTRY_ID = f"'entry_id=' || {told('entry_id')}"
UNREAD_FACTS = " || ".join(f"'{c}=' || {told(c)}" for c in ("detail", "machine", "path", "reason"))


def section_tree(tag: str, hashed: str, per_section: int) -> str:
    """The nodes of a section tree over rows (k, h), as common tables ending in ``tag``."""
    depth = " ".join(f"WHEN count(*) <= {per_section * 16**d} THEN {d}" for d in range(4))
    text = f"""{tag}_c AS MATERIALIZED (SELECT k, h, count(*) AS n FROM ({hashed}) GROUP BY ALL),
{tag}_d AS (SELECT CASE {depth} ELSE 4 END AS depth FROM {tag}_c),
{tag}_4 AS MATERIALIZED (SELECT depth, substr(k, 1, depth) AS prefix, CAST(sum(n) AS BIGINT) AS rows,
  sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS digest FROM {tag}_c, {tag}_d GROUP BY ALL)"""
    for up in (3, 2, 1, 0):
        name = tag if up == 0 else f"{tag}_{up}"
        text += f""",
{name} AS MATERIALIZED (SELECT * FROM {tag}_{up + 1} UNION ALL SELECT {up}, substr(prefix, 1, {up}) AS above, CAST(sum(rows) AS BIGINT),
  sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix || ':' || digest)) FROM {tag}_{up + 1} WHERE depth = {up + 1} GROUP BY above)"""
    return text


@query("artifact_digest", f"""
, {section_tree("e", f"SELECT h AS k, h FROM (SELECT sha256({entry_facts("''")}) AS h FROM v_entry)", 4096)},
{section_tree("u", f"SELECT h AS k, h FROM (SELECT sha256({UNREAD_FACTS}) AS h FROM v_unread)", 4096)}
SELECT e.rows AS entries, sha256('entries:' || e.rows || ':' || e.digest || '|unread:' || u.rows || ':' || u.digest || '|')
  AS content_digest, true AS order_independent FROM e, u WHERE e.depth = 0 AND u.depth = 0""")
def _(t: Given):
    named = {"entries": t.entries, "unread": t.unread}
    shuffled = {"entries": t.entries.repartition(5), "unread": t.unread.repartition(3, "path")}
    one, two = lineage.content_digest(named), lineage.content_digest(shuffled)
    return t.entries.groupBy().agg(
        F.count(F.lit(1)).alias("entries"),
        F.lit(one).alias("content_digest"),
        F.lit(one == two).alias("order_independent"),
    )


@query("entry_sections", f"""
, {section_tree("e", f"SELECT sha256({ENTRY_ID} || 'machine=' || {told('machine')}) AS k, sha256({entry_facts(ENTRY_ID)}) AS h FROM v_entry", 16)}
SELECT depth, prefix, rows, digest FROM e""")
def _(t: Given):
    return sections.tree(t.entries, artifacts.KEYS["entries"], per_section=16)


def inventories(t: Given) -> tuple[str, str]:
    """The inventory and the later snapshot as artifacts."""
    where = tables.place(t.spark, t.sf_dir, "inventories")
    if where not in _logged:
        for name, frame in (("before", t.entries), ("after", t.observed.select(*schema.ENTRY.fieldNames()))):
            artifacts.write(t.spark, f"{where}/{name}", "scan", {"entries": frame, "unread": t.unread}, tables.MACHINES[:1], replace=True)
        _logged.add(where)
    return f"{where}/before", f"{where}/after"


@query("artifact_differences", """
SELECT machine, entry_id, CASE WHEN quality = 0 THEN 'removed' ELSE 'changed' END AS change
FROM v_entry JOIN labels ON doc_id = entry_id WHERE quality = 0 OR toxic <> 0""")
def _(t: Given):
    return artifacts.differences(t.spark, *inventories(t), "entries")


@query("artifact_reload", """
SELECT 'entries' AS stored, kind, count(*) AS records, CAST(sum(logical_size) AS BIGINT) AS bytes,
  count(modified_s) AS dated, count(file_index) AS filed, min(path) AS first_path FROM v_entry GROUP BY kind
UNION ALL SELECT 'unread', reason, count(*), NULL, 0, 0, min(path) FROM v_unread GROUP BY reason""")
def _(t: Given):
    # Written and read through the data source, in two additions to one table.
    t.spark.dataSource.register(datasource.StoredTable)
    where = tables.place(t.spark, t.sf_dir, "reload")
    odd = F.col("entry_id") % 2 == 1
    t.entries.where(odd).write.format("filelens").mode("overwrite").save(f"{where}/entries")
    t.entries.where(~odd).write.format("filelens").mode("append").save(f"{where}/entries")
    t.unread.write.format("filelens").mode("overwrite").save(f"{where}/unread")
    entries, places = (t.spark.read.format("filelens").load(f"{where}/{name}") for name in ("entries", "unread"))
    files = entries.groupBy("kind").agg(
        F.count(F.lit(1)).alias("records"), F.sum("logical_size").alias("bytes"), F.count("modified").alias("dated"),
        F.count("file_id").alias("filed"), F.min("path").alias("first_path"),
    )
    none = F.lit(0).cast("long")
    unread = places.groupBy(F.col("reason").alias("kind")).agg(
        F.count(F.lit(1)).alias("records"), F.lit(None).cast("long").alias("bytes"), none.alias("dated"),
        none.alias("filed"), F.min("path").alias("first_path"),
    )
    return files.withColumn("stored", F.lit("entries")).unionByName(unread.withColumn("stored", F.lit("unread")))


@query("analysis_artifact", None)
def _(t: Given):
    found = t.analysis
    where = tables.place(t.spark, t.sf_dir, "artifacts")
    inventory = artifacts.write(
        t.spark, f"{where}/inventory", "scan", {"entries": t.entries, "unread": t.unread},
        tables.MACHINES[:1], replace=True,
    )
    written = artifacts.write(
        t.spark,
        f"{where}/analysis",
        "analyze",
        {
            "settled": artifacts.with_paths(found.settled, t.entries),
            "groups": found.groups,
            "members": artifacts.with_paths(found.members, t.entries),
        },
        tables.MACHINES[:1],
        [inventory],
        replace=True,
    )
    back = artifacts.read(t.spark, f"{where}/analysis", "analysis")
    back.register("analysis_")
    return t.spark.sql(
        "SELECT g.certainty, count(DISTINCT g.group_id) AS groups, count(*) AS names "
        "FROM analysis_groups g JOIN analysis_members m ON m.group_id = g.group_id GROUP BY 1"
    ).withColumn("artifact", F.lit(written.digest))


@query("ndjson_export", """
SELECT kind, count(*) AS records, CAST(sum(logical_size) AS BIGINT) AS bytes, count(modified_s) AS dated,
  min(path) AS first_path FROM v_entry GROUP BY 1
UNION ALL SELECT reason, count(*), NULL, 0, min(path) FROM v_unread GROUP BY 1""")
def _(t: Given):
    # Out to text and back: the figures are those of the exported files.
    where = tables.place(t.spark, t.sf_dir, "ndjson")
    ndjson.export_ndjson(ndjson.records(t.entries, t.unread, t.roots), where, replace=True)
    back, _, _ = ndjson.read_ndjson(t.spark, where)
    files = back.entries.groupBy("kind").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("logical_size").alias("bytes"),
        F.count("modified").alias("dated"),
        F.min("path").alias("first_path"),
    )
    places = back.unread.groupBy(F.col("reason").alias("kind")).agg(
        F.count(F.lit(1)).alias("records"),
        F.lit(None).cast("long").alias("bytes"),
        F.lit(0).cast("long").alias("dated"),
        F.min("path").alias("first_path"),
    )
    return files.unionByName(places)
