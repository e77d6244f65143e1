"""Loading inventories and the content their entries point at."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens import schema
from filelens.functions import classify
from filelens.functions import content as digests
from filelens.operators.scale import look_up, number_rows

CORRUPT = "_corrupt"
ID_BITS = 40  # of an id on one machine; machines are numbered above


@dataclass
class Inventory:
    """Rows and the places that could not be read, which travel together."""

    entries: DataFrame
    unread: DataFrame

    def is_complete(self) -> bool:
        return self.unread.isEmpty()


def read_inventory(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str = "parquet",
    unread: Sequence[str] = (),
    renumber: bool = False,
) -> Inventory:
    """Metadata rows of several roots, in order, overlaps kept as they are.

    ``unread`` names the ledgers that belong to Parquet inputs. Lines of JSON or of an
    export ('ndjson') that do not parse become unread places instead of vanishing.
    With ``renumber`` entries get ids of their own, in the order of machine and path.
    Ids must not repeat; ``checked`` refuses those that do, and ``keyed`` makes ids that
    repeat only from machine to machine unique, in entries and in their content alike.
    """
    if not paths:
        raise ValueError("an inventory needs at least one input")
    if fmt == "parquet":
        none = spark.createDataFrame([], schema.UNREAD)
        ledgers = [spark.read.schema(schema.UNREAD).parquet(p) for p in unread]
        entries = [spark.read.schema(schema.ENTRY).parquet(p) for p in paths]
        found = Inventory(_united(entries), _united([*ledgers, none][: len(ledgers) or 1]))
    elif fmt == "ndjson":
        from filelens.sources.ndjson import read_ndjson

        found = Inventory(*map(_united, zip(*[_of_export(read_ndjson, spark, p) for p in paths])))
    elif fmt == "json":
        found = _read_json(spark, paths)
    else:
        raise ValueError("inventories are read from 'parquet', 'json' or 'ndjson'")
    return Inventory(numbered(found.entries), found.unread) if renumber else found


def _united(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _of_export(read: Callable, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    inventory, _, _ = read(spark, path)
    return inventory.entries, inventory.unread


def numbered(entries: DataFrame) -> DataFrame:
    """Entries with unique ids in the order of machine, path and former id."""
    order = [F.col("machine"), F.col("path"), F.col("entry_id")]
    ids = number_rows(entries.withColumnRenamed("entry_id", "_was"), [*order[:2], F.col("_was")], "entry_id")
    return ids.select(*entries.columns)


def checked(entries: DataFrame) -> DataFrame:
    """The same entries; raises if an id repeats, on one machine or on two: content and
    analyses are joined by it."""
    repeated = entries.groupBy("entry_id").count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError("entry ids repeat; read with renumber=True, or make them unique with keyed()")
    return entries


def machine_numbers(entries: DataFrame) -> DataFrame:
    """(machine, number), numbers from zero in the order of names."""
    return number_rows(entries.select("machine").distinct(), [F.col("machine")], "_number")


def keyed(frame: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows with (machine, entry_id) whose ids are unique over all machines: the machine's
    number in the upper bits, the id it had there below. Made where the row is read, from
    a table with a row for each machine, so neither entries nor content move for it; an id
    that does not fit, and a machine without a number, are errors."""
    low = F.lit((1 << ID_BITS) - 1)
    fits = F.col("_number").isNotNull() & (F.col("entry_id").between(F.lit(0), low)) & (F.col("_number") < (1 << (63 - ID_BITS)))
    key = F.shiftleft(F.col("_number"), ID_BITS) + F.col("entry_id")
    told = F.concat(F.lit("no key for entry "), F.col("entry_id").cast("string"), F.lit(" of "), F.col("machine"))
    joined = look_up(frame, numbers, ["machine"], "entry_id")
    made = F.when(fits, key).otherwise(F.raise_error(told).cast("long")).alias("entry_id")
    return joined.select(*[made if c == "entry_id" else F.col(f"`{c}`") for c in frame.columns])


def source_id(key: Column) -> Column:
    """The id that a keyed entry had on its machine."""
    return key.bitwiseAND(F.lit((1 << ID_BITS) - 1))


def write_content(content: DataFrame, table: str, buckets: int) -> None:
    """A content table bucketed by ``entry_id``: what is wanted of it meets it without
    moving content."""
    content.write.bucketBy(buckets, "entry_id").sortBy("entry_id").saveAsTable(table)


def _read_json(spark: SparkSession, paths: Sequence[str]) -> Inventory:
    shape = schema.table(f"{CORRUPT} string")
    for field in schema.ENTRY.fields:
        shape.add(field)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    frames = [
        spark.read.text(p).select(
            F.from_json("value", shape, options).alias("row"),
            F.col("_metadata.file_path").alias("file"),
        )
        for p in paths
    ]
    rows = reduce(DataFrame.unionByName, frames).select("row.*", "file")
    bad = rows.where(F.col(CORRUPT).isNotNull()).select(
        F.lit(None).cast("string").alias("machine"),
        F.col("file").alias("path"),
        F.lit("other").alias("reason"),
        F.col(CORRUPT).alias("detail"),
    )
    good = rows.where(F.col(CORRUPT).isNull()).select(*schema.ENTRY.fieldNames())
    return Inventory(good, bad)


def list_files(spark: SparkSession, path: str, machine: str) -> DataFrame:
    """Entries of a store without links, from a listing; content is not read.
    Ids follow path order inside one call."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )
    numbered = number_rows(listed, [F.col("path")], "entry_id")
    given = {
        "machine": F.lit(machine),
        "entry_id": F.col("entry_id"),
        "path": F.regexp_replace("path", "^[a-zA-Z0-9]+:/+", "/"),
        "kind": F.lit("file"),
        "logical_size": F.col("length"),
        "modified": F.date_trunc("second", F.col("modificationTime")),
        "link_count": F.lit(1),
        "cloud": F.struct(
            F.lit(None).cast("string").alias("provider"),
            F.lit("not_synced").alias("residency"),
            F.lit("unspecified").alias("retention"),
        ),
    }
    return numbered.select(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.ENTRY.fields
        ]
    )


def unread_directories(failures: DataFrame) -> DataFrame:
    """One unread row per folder with a failed listing or child (machine, folder,
    errno, error_kind, message): one failure marks the whole folder."""
    reason = classify.unread_reason(F.col("errno"), F.col("error_kind"))
    first = F.min(F.struct(reason.alias("reason"), F.col("message").alias("message")))
    return (
        failures.groupBy("machine", F.col("folder").alias("path"))
        .agg(first.alias("why"))
        .select(
            "machine",
            "path",
            F.col("why.reason").alias("reason"),
            F.when(F.col("why.reason") == "other", F.col("why.message")).alias("detail"),
        )
    )


def readable(entries: DataFrame) -> DataFrame:
    """Entries whose content can be read without any chance of a download."""
    return entries.where(~classify.read_may_download(F.col("cloud.residency")))


def read_content(entries: DataFrame, content: DataFrame) -> DataFrame:
    """Content of readable entries only; what may download is dropped before the join."""
    return readable(entries).select("entry_id").join(content, "entry_id")


def _open(path: str) -> BinaryIO:
    return open(path, "rb")


def digest_files(
    entries: DataFrame,
    sample: bool = False,
    end_bytes: int = digests.SAMPLE_END_BYTES,
    opener: Callable[[str], BinaryIO] = _open,
) -> DataFrame:
    """(entry_id, digest, trouble) of files opened by path inside tasks.

    For stores mounted on the executors. Whole files are read in pieces; a sample
    seeks to both ends. Agrees with the digests of a content column.
    """
    piece = 1 << 20

    def digest(path: str, size: int) -> str:
        with opener(path) as handle:
            if sample and size > 2 * end_bytes:
                state = hashlib.sha256(str(size).encode())
                state.update(handle.read(end_bytes))
                handle.seek(size - end_bytes)
                state.update(handle.read(end_bytes))
                return state.hexdigest()
            state = hashlib.sha256()
            while block := handle.read(piece):
                state.update(block)
            return state.hexdigest()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                try:
                    out.append((row.entry_id, digest(row.path, row.logical_size), None))
                except OSError as problem:
                    out.append((row.entry_id, None, problem.strerror or str(problem)))
            yield pd.DataFrame(out, columns=["entry_id", "digest", "trouble"])

    return (
        readable(entries)
        .select("entry_id", "path", "logical_size")
        .mapInPandas(each, "entry_id long, digest string, trouble string")
    )
