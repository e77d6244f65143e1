"""Artifacts: a Parquet dataset per table, with a header written last.

The header carries the version, the parents and the digest of what was written: the
roots of the tables' section trees, which are stored beside them. A folder without a
header was never finished; one whose digest differs was changed. A section can be checked
alone, and two artifacts are compared by reading the sections that differ.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens import schema
from filelens.plans.lineage import STAGES, chained
from filelens.sources import sections

TOOL_VERSION = "0.1"
OUTPUT_KIND = {stage: kind for stage, _, kind, *_ in STAGES}

# Tables kept per artifact kind, with the columns their rows are ordered by.
TABLES = {
    "inventory": ("entries", "unread", "roots", "links"),
    "analysis": ("settled", "groups", "members"),
    "plan": ("operations", "edits"),
    "preflight": ("operations", "verdicts"),
    "journal": ("operations", "steps"),
}
# What tells the rows of a table apart, where something does: a row that changes stays in
# its section.
KEYS = {
    "entries": ("machine", "entry_id"),
    "groups": ("group_id",),
    "members": ("group_id", "object_id", "entry_id"),
    "operations": ("position",),
    "edits": ("machine", "position"),
    "verdicts": ("operation",),
}


class ArtifactError(ValueError):
    """An artifact that may not be read, written or used."""


@dataclass
class Artifact:
    header: dict
    tables: Mapping[str, DataFrame]

    @property
    def kind(self) -> str:
        return self.header["kind"]

    @property
    def digest(self) -> str:
        return self.header["content_digest"]

    def is_executable_on(self, machine: str) -> bool:
        return not self.header["merged"] and self.header["machines"] == [machine]

    def is_native(self, path_encoding: str) -> bool:
        return self.header["path_encoding"] == path_encoding

    def register(self, prefix: str = "") -> None:
        """Expose the tables to SQL."""
        for name, frame in self.tables.items():
            frame.createOrReplaceTempView(f"{prefix}{name}")


def with_paths(frame: DataFrame, entries: DataFrame) -> DataFrame:
    """Add the path of each row's entry, so that what is stored and digested does
    not depend on where the entry stood in its input."""
    return frame.join(entries.select("entry_id", "path"), "entry_id")


def _check_parents(stage: str, parents: Sequence[Artifact], machines: Sequence[str]) -> None:
    """The chain gate: as many inputs as the stage takes, of its kind, and a stage that
    changes a machine may run on nothing but the one machine its input is about."""
    _, input_kind, _, mutates, least, most = next(s for s in STAGES if s[0] == stage)
    if len(parents) < least or (most is not None and len(parents) > most):
        raise ArtifactError(f"{stage} takes {least} inputs, not {len(parents)}")
    wrong = sorted({p.kind for p in parents} - {input_kind})
    if wrong:
        raise ArtifactError(f"{stage} follows {input_kind} artifacts, not {wrong}")
    if mutates and not all(len(machines) == 1 and p.is_executable_on(machines[0]) for p in parents):
        raise ArtifactError(f"{stage} runs on the one machine that its input is about")


def write(
    spark: SparkSession,
    path: str,
    stage: str,
    tables: Mapping[str, DataFrame],
    machines: Sequence[str],
    parents: Sequence[Artifact] = (),
    scope_digest: str | None = None,
    path_encoding: str = "bytes",
    replace: bool = False,
) -> Artifact:
    """Write tables, digest what was written, write the digests, then the header."""
    kind = OUTPUT_KIND[stage]
    unknown = set(tables) - set(TABLES[kind])
    if unknown:
        raise ArtifactError(f"{kind} artifacts hold {TABLES[kind]}, not {sorted(unknown)}")
    _check_parents(stage, parents, machines)
    mode = "overwrite" if replace else "errorifexists"
    try:
        for name, frame in tables.items():
            sections.placed(frame, KEYS.get(name, ())).write.mode(mode).parquet(f"{path}/{name}")
    except AnalysisException as problem:
        raise ArtifactError(f"{path} is taken; pass replace=True to replace it") from problem
    written = {name: stored(spark, path, name).drop(sections.SECTION) for name in tables}
    trees = {name: sections.tree(frame, KEYS.get(name, ())) for name, frame in written.items()}
    for name, nodes in trees.items():
        nodes.sortWithinPartitions("depth", "prefix").write.mode(mode).parquet(f"{path}/sections/{name}")
    digests = tuple(p.digest for p in parents)
    header = {
        "schema_version": schema.SCHEMA_VERSION,
        "tool_version": TOOL_VERSION,
        "algorithm": schema.DIGEST_ALGORITHM,
        "stage": stage,
        "kind": kind,
        "parents": list(digests),
        "machines": list(machines),
        "merged": stage == "merge",
        "created_at": datetime.now(timezone.utc),
        "scope_digest": scope_digest or (parents[0].header["scope_digest"] if parents else None),
        "content_digest": chained({name: sections.root(nodes) for name, nodes in trees.items()}, digests),
        "path_encoding": path_encoding,
    }
    row = [tuple(header[f] for f in schema.HEADER.fieldNames())]
    spark.createDataFrame(row, schema.HEADER).coalesce(1).write.mode(mode).parquet(f"{path}/header")
    return Artifact(header, written)


def stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table as it is stored, with its sections."""
    return spark.read.parquet(f"{path}/{table}")


def tree_of(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(sections.TREE).parquet(f"{path}/sections/{table}")


def section_holds(spark: SparkSession, path: str, table: str, prefix: str) -> bool:
    """Whether the rows of one section are those its digest was made of, nothing else
    read. A prefix shorter than a section's names all sections below it."""
    nodes = tree_of(spark, path, table)
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    named = spark.createDataFrame([(prefix,)], "prefix string")
    rows = sections.within(stored(spark, path, table), named).drop(sections.SECTION)
    leaves = nodes.where((F.col("depth") == depth) & F.startswith("prefix", F.lit(prefix[:depth])))
    return sections.same_leaves(leaves, sections.leaves(rows, KEYS.get(table, ()), depth), prefix)


def differences(spark: SparkSession, one: str, two: str, table: str) -> DataFrame:
    """(key columns, change) of rows that were added, removed or changed from one
    artifact to another."""
    return sections.differences(
        stored(spark, one, table), stored(spark, two, table), KEYS[table], tree_of(spark, one, table), tree_of(spark, two, table)
    )


def read(spark: SparkSession, path: str, kind: str | None = None, verify: bool = True) -> Artifact:
    """Read an artifact: its version is judged before anything else, then its kind,
    then its content against the recorded digest."""
    try:
        header = spark.read.parquet(f"{path}/header").first().asDict(recursive=True)
    except AnalysisException as problem:
        raise ArtifactError(f"{path} holds no finished artifact") from problem
    if header["schema_version"] != schema.SCHEMA_VERSION:
        raise ArtifactError(
            f"{path} has schema version {header['schema_version']}, "
            f"this reads {schema.SCHEMA_VERSION}"
        )
    if kind is not None and header["kind"] != kind:
        raise ArtifactError(f"{path} is a {header['kind']} artifact, not {kind}")
    tables = {}
    for name in TABLES[header["kind"]]:
        try:
            tables[name] = stored(spark, path, name).drop(sections.SECTION)
        except AnalysisException:
            continue
    if verify:
        roots = {name: sections.root(sections.tree(frame, KEYS.get(name, ()))) for name, frame in tables.items()}
        if chained(roots, header["parents"]) != header["content_digest"]:
            raise ArtifactError(f"{path} is not what its header says it is")
    return Artifact(header, tables)


def read_analyses(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, Artifact]]:
    """Analyses to compare, each labelled by its file stem: at least two, none of
    them a comparison itself."""
    if len(paths) < 2:
        raise ArtifactError("a comparison needs at least two analyses")
    found = []
    for path in paths:
        artifact = read(spark, path, "analysis")
        if artifact.header["merged"]:
            raise ArtifactError(f"{path} already compares several machines")
        stem = path.rstrip("/").rpartition("/")[2]
        found.append((stem.rpartition(".")[0] or stem, artifact))
    return found
