"""A diffable text companion of an inventory: one JSON record per line."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens import schema
from filelens.sources.inventory import Inventory

SECTIONS = ("header", "cloud_root", "cloud_link", "entry", "unread")
RECORD = (
    "record string, machine string, path struct<text:string,bytes:string>, kind string, "
    "logical_size long, allocated_size long, created string, modified string, "
    "file_id struct<volume:long,index:long>, link_count long, "
    "link_target struct<text:string,bytes:string>, "
    "cloud struct<provider:string,residency:string,retention:string>, "
    "provider string, account string, origin string, "
    "link struct<text:string,bytes:string>, target struct<text:string,bytes:string>, "
    "verdict string, reason string, detail string, entry_id long"
)
CORRUPT = "_corrupt"
KEEP_NULLS = {"ignoreNullFields": "false"}


def path_record(text: Column, raw: Column | None = None) -> Column:
    """A path twice: readable text, and the bytes it really is, in hex."""
    data = text.cast("binary") if raw is None else F.coalesce(raw, text.cast("binary"))
    return F.struct(text.alias("text"), F.lower(F.hex(data)).alias("bytes"))


def _time(column: str) -> Column:
    return F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(
    entries: DataFrame,
    unread: DataFrame | None = None,
    roots: DataFrame | None = None,
    links: DataFrame | None = None,
    header: Mapping | None = None,
) -> DataFrame:
    """(section, position, line): every record as JSON with its place in the file."""
    out = []
    if header is not None:
        spark = entries.sparkSession
        row = [tuple(header[f] for f in schema.HEADER.fieldNames())]
        frame = spark.createDataFrame(row, schema.HEADER)
        body = F.struct(
            F.lit("header").alias("record"),
            F.struct(*frame.columns).alias("header"),
            F.col("path_encoding"),
        )
        out.append((0, F.lit("").alias("position"), frame, body))
    if roots is not None:
        body = F.struct(
            F.lit("cloud_root").alias("record"),
            "machine",
            path_record(F.col("path")).alias("path"),
            "provider",
            "account",
            "origin",
        )
        out.append((1, F.col("path").alias("position"), roots, body))
    if links is not None:
        body = F.struct(
            F.lit("cloud_link").alias("record"),
            "machine",
            path_record(F.col("link")).alias("link"),
            path_record(F.col("target")).alias("target"),
            "provider",
            "verdict",
        )
        out.append((2, F.col("link").alias("position"), links, body))
    body = F.struct(
        F.lit("entry").alias("record"),
        "machine",
        "entry_id",
        path_record(F.col("path"), F.col("path_bytes")).alias("path"),
        "kind",
        "logical_size",
        "allocated_size",
        _time("created").alias("created"),
        _time("modified").alias("modified"),
        "file_id",
        "link_count",
        F.when(F.col("link_target").isNotNull(), path_record(F.col("link_target"))).alias(
            "link_target"
        ),
        "cloud",
    )
    out.append((3, F.lpad(F.col("entry_id").cast("string"), 19, "0").alias("position"), entries, body))
    if unread is not None:
        body = F.struct(
            F.lit("unread").alias("record"),
            "machine",
            path_record(F.col("path")).alias("path"),
            "reason",
            "detail",
        )
        out.append((4, F.col("path").alias("position"), unread, body))
    frames = [
        frame.select(F.lit(rank).alias("section"), position, F.to_json(body, KEEP_NULLS).alias("line"))
        for rank, position, frame, body in out
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def export_ndjson(lines: DataFrame, path: str, replace: bool = False) -> None:
    """Write records in section order; part files concatenate in that order."""
    (
        lines.orderBy("section", "position", "line")
        .select("line")
        .write.mode("overwrite" if replace else "errorifexists")
        .text(path)
    )


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its record and file; lines that do not parse have none."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return (
        spark.read.text(path)
        .select(
            F.from_json("value", f"{RECORD}, {CORRUPT} string", options).alias("row"),
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("file"),
        )
        .where(F.length(F.trim("line")) > 0)
        .select("row.*", "line", "file")
    )


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """The header of an export, or no row."""
    lines = spark.read.text(path).select(
        F.from_json("value", f"record string, header {schema.HEADER.simpleString()}").alias("row")
    )
    return lines.where("row.record = 'header'").select("row.header.*")


def read_ndjson(spark: SparkSession, path: str) -> tuple[Inventory, DataFrame, DataFrame]:
    """An exported inventory back as tables: (inventory, roots, links). A line that is
    no record becomes an unread place; headers are read by ``read_header``."""
    rows = _parsed(spark, path)
    raw = F.unhex("path.bytes")
    entries = rows.where("record = 'entry'").select(
        "machine",
        "entry_id",
        F.col("path.text").alias("path"),
        F.when(F.col("path.text").cast("binary") != raw, raw).alias("path_bytes"),
        "kind",
        "logical_size",
        "allocated_size",
        F.to_timestamp("created").alias("created"),
        F.to_timestamp("modified").alias("modified"),
        "file_id",
        "link_count",
        F.col("link_target.text").alias("link_target"),
        "cloud",
    )
    known = F.col("record").isin(*SECTIONS)
    broken = rows.where(F.col(CORRUPT).isNotNull() | ~F.coalesce(known, F.lit(False))).select(
        F.lit(None).cast("string").alias("machine"),
        F.col("file").alias("path"),
        F.lit("other").alias("reason"),
        F.col("line").alias("detail"),
    )
    unread = (
        rows.where("record = 'unread'")
        .select("machine", F.col("path.text").alias("path"), "reason", "detail")
        .unionByName(broken)
    )
    roots = rows.where("record = 'cloud_root'").select(
        "machine", F.col("path.text").alias("path"), "provider", "account", "origin"
    )
    links = rows.where("record = 'cloud_link'").select(
        "machine",
        F.col("link.text").alias("link"),
        F.col("target.text").alias("target"),
        "provider",
        "verdict",
    )
    return Inventory(entries, unread), roots, links
