"""Section digests: a table as a tree of hashes, of which any part can be checked alone.

A row belongs to the section that its key's hash begins with. A section's digest covers
its rows in the order of their hashes, and a node's digest those of its sixteen children,
up to one root. A row that changes changes one section and the nodes above it, so two
states of a table are compared from the root down, and only sections that differ are
read. Rows are kept in the order of their section, which lets a scan skip the others.

Keys should be unique: rows of one key lie in one section. Where a table has no key the
whole row is its own. Equal rows are counted before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.session import keep

SECTION = "_section"
SECTION_DIGITS = 8
ROWS = 4096  # rows of a section, on average at most
RANGES = 256  # sections that are named to a scan; more are joined
TREE = "depth int, prefix string, rows long, digest string"


def _text(value: Column, kind: T.DataType) -> Column:
    """A value as text that no other value has: its length before it, absent ones told
    from empty ones, times as signed microseconds."""
    if isinstance(kind, T.StructType):
        inner = F.concat(F.lit("{"), *[_text(value.getField(f.name), f.dataType) for f in kind.fields], F.lit("}"))
        return F.when(value.isNull(), F.lit("-")).otherwise(inner)
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x: _text(x, kind.elementType))
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("["), F.array_join(each, ""), F.lit("]")))
    if isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(kind, T.BinaryType):
        value = F.hex(value)
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_text(frame: DataFrame, columns: Sequence[str]) -> Column:
    """The named columns of a row as text, in the order of their names."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    parts = [p for c in sorted(columns) for p in (F.lit(f"{c}="), _text(F.col(f"`{c}`"), kinds[c]))]
    return F.concat(F.lit(""), *parts)


def key_hash(frame: DataFrame, keys: Sequence[str], skip: Sequence[str] = ()) -> Column:
    """The hash that places a row; of the whole row where there is no key."""
    return F.sha2(row_text(frame, keys or [c for c in frame.columns if c not in skip]), 256)


def depth_for(rows: int, per_section: int = ROWS) -> int:
    """Hexadecimal digits that cut ``rows`` into sections of ``per_section``."""
    depth = 0
    while per_section * 16**depth < rows:
        depth += 1
    return depth


def _counted(frame: DataFrame, keys: Sequence[str], skip: Sequence[str]) -> DataFrame:
    """(key, hash, n): distinct rows by their hashes."""
    covered = [c for c in frame.columns if c not in skip]
    hashed = frame.select(key_hash(frame, keys, skip).alias("key"), F.sha2(row_text(frame, covered), 256).alias("hash"))
    return hashed.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n"))


def _sections(counted: DataFrame, depth: int) -> DataFrame:
    told = F.concat_ws(":", "hash", F.col("n").cast("string"))
    return _folded(counted.select(F.substring("key", 1, depth).alias("prefix"), F.col("n").alias("rows"), told.alias("told")))


def leaves(frame: DataFrame, keys: Sequence[str], depth: int, skip: Sequence[str] = ()) -> DataFrame:
    """(prefix, rows, digest) of the sections at one depth."""
    return _sections(_counted(frame, keys, skip), depth)


def tree(frame: DataFrame, keys: Sequence[str] = (), skip: Sequence[str] = (), per_section: int = ROWS) -> DataFrame:
    """(depth, prefix, rows, digest): every node of a table, the root at depth 0."""
    counted = keep(_counted(frame, keys, skip))
    depth = depth_for(counted.count(), per_section)
    level = _sections(counted, depth)
    levels = [level.withColumn("depth", F.lit(depth))]
    for above in range(depth - 1, -1, -1):
        told = F.concat_ws(":", "prefix", "digest")
        level = _folded(level.select(F.substring("prefix", 1, above).alias("prefix"), "rows", told.alias("told")))
        levels.append(level.withColumn("depth", F.lit(above)))
    nodes = reduce(DataFrame.unionByName, levels)
    return keep(nodes.select("depth", "prefix", "rows", "digest"))


def same_leaves(one: DataFrame, two: DataFrame, prefix: str) -> bool:
    """Whether two sets of sections agree below a prefix."""
    sides = [n.where(F.startswith("prefix", F.lit(prefix)) | F.startswith(F.lit(prefix), "prefix")) for n in (one, two)]
    both = sides[0].select("prefix", "digest").join(sides[1].select("prefix", F.col("digest").alias("other")), "prefix", "full")
    return both.where(~F.col("digest").eqNullSafe(F.col("other"))).isEmpty()


def _folded(parts: DataFrame) -> DataFrame:
    return parts.groupBy("prefix").agg(
        F.sum("rows").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("told")), ","), 256).alias("digest")
    )


def root(nodes: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a whole table; no rows have an empty digest."""
    found = nodes.where("depth = 0").first()
    return (found.rows, found.digest) if found else (0, "")


def changed_sections(one: DataFrame, two: DataFrame) -> DataFrame:
    """(prefix): the smallest sections both trees have whose digests differ. Children are
    looked at only below nodes that differ."""
    deepest = [n.agg(F.max("depth")).first()[0] or 0 for n in (one, two)]
    differing = None
    for depth in range(min(deepest) + 1):
        sides = [n.where(F.col("depth") == depth).select("prefix", "digest") for n in (one, two)]
        if differing is not None:
            above = differing.withColumnRenamed("prefix", "above")
            sides = [s.join(above, F.substring("prefix", 1, depth - 1) == F.col("above"), "left_semi") for s in sides]
        both = sides[0].join(sides[1].withColumnRenamed("digest", "other"), "prefix", "full")
        differing = both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("prefix")
    return differing


def within(frame: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows of stored sections: a few are named to the scan, which skips the others."""
    named = [r.prefix for r in sections.limit(RANGES + 1).collect()]
    if len(named) > RANGES:
        wide = F.max(F.length("prefix"))
        width = sections.agg(wide).first()[0]
        return frame.join(sections.withColumnRenamed("prefix", "_wanted"), F.substring(SECTION, 1, width) == F.col("_wanted"), "left_semi")
    if not named:
        return frame.where(F.lit(False))
    ranges = [(F.col(SECTION) >= p) & (F.col(SECTION) <= p.ljust(SECTION_DIGITS, "f")) for p in named]
    return frame.where(reduce(Column.__or__, ranges))


def placed(frame: DataFrame, keys: Sequence[str] = (), skip: Sequence[str] = ()) -> DataFrame:
    """Rows with their section, in its order."""
    section = F.substring(key_hash(frame, keys, skip), 1, SECTION_DIGITS)
    return frame.withColumn(SECTION, section).sortWithinPartitions(SECTION)


def differences(one: DataFrame, two: DataFrame, keys: Sequence[str], one_tree: DataFrame, two_tree: DataFrame) -> DataFrame:
    """(keys, change): rows of two stored tables that were 'added', 'removed' or 'changed',
    read from the sections that differ."""
    sections = keep(changed_sections(one_tree, two_tree))
    sides = []
    for frame, side in ((one, "before"), (two, "after")):
        covered = [c for c in frame.columns if c != SECTION]
        rows = within(frame, sections)
        sides.append(rows.select(*keys, F.sha2(row_text(frame, covered), 256).alias(side)))
    both = sides[0].join(sides[1], list(keys), "full").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), F.lit("added")).when(F.col("after").isNull(), F.lit("removed"))
    return both.select(*keys, change.otherwise(F.lit("changed")).alias("change"))
