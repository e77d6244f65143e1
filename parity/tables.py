"""Inventory, snapshot and analysis tables derived by Spark from the given tables.

One file per document, one symbolic link per page, one unread place per event.
Each table is written once per session as Parquet in the shared folder, the way
stages hand artifacts to each other, and read back by every query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens import schema
from filelens.functions import paths
from filelens.operators import duplicates, scale
from filelens.session import SETTINGS, pin, shared_dir

FIRST_DIRECTORY = 10**15
FIRST_LINK = 2 * 10**15
FIRST_MARKER = 3 * 10**15
END_BYTES = 64

ROOTS = (
    ("/home/src1", "google_drive"),
    ("/home/src1/node_modules", "one_drive"),
    ("/home/src11", "dropbox"),
)
MACHINES = ("mac", "windows")

_written: dict[tuple[str, str, str], str] = {}


def place(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where this session keeps a derived table."""
    tag = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/filelens-{spark.sparkContext.applicationId}/{tag}/{name}"


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Write a derived table once per session, then read it."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _written:
        for setting, value in SETTINGS.items():
            spark.conf.set(setting, value)
        where = place(spark, sf_dir, name)
        build().write.mode("overwrite").parquet(where)
        _written[key] = where
    return spark.read.parquet(_written[key])


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content by entry, straight from the documents."""
    return source(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("entry_id"), F.col("text").alias("content")
    )


def observed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content as the later snapshot has it: German documents were rewritten."""
    text = F.col("text")
    rewritten = F.concat(F.lit("x"), F.substr(text, F.lit(2)))
    return source(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("entry_id"),
        F.when(F.col("lang") == "de", rewritten).otherwise(text).alias("content"),
    )


def _machine(number) -> Column:
    return F.when(F.pmod(number, F.lit(2)) == 0, F.lit("mac")).otherwise(F.lit("windows"))


def _entry(frame: DataFrame, **columns) -> DataFrame:
    empty = {f.name: F.lit(None).cast(f.dataType) for f in schema.ENTRY.fields}
    columns = {**empty, **columns}
    return frame.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in schema.ENTRY.fields]
    )


def _cloud(residency, provider=None) -> Column:
    return F.struct(
        (F.lit(None) if provider is None else provider).cast("string").alias("provider"),
        residency.alias("residency"),
        F.lit("unspecified").alias("retention"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document; every third shares its bytes with the first copy of
    the same text on its machine."""
    doc = F.col("doc_id")
    base = source(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        "lang",
        F.octet_length("text").cast("long").alias("size"),
        F.sha2("text", 256).alias("copy"),
        F.pmod(doc, F.lit(2)).alias("side"),
    )
    firsts = base.groupBy("copy", "side").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    slices = scale.slices_for(source(spark, sf_dir, "documents"))
    docs = scale.join_hot(base, firsts, ["copy", "side"], "copies", "doc_id", slice_rows=slices)
    mod = lambda n: F.pmod(doc, F.lit(n))
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".txt", ".JPG", ".parquet", "", ".tar.gz", ".mov", ".pdf")]),
        (mod(7) + 1).cast("int"),
    )
    place = (
        F.when(mod(17) == 0, F.lit("/node_modules/"))
        .when(mod(13) == 0, F.lit("/old/"))
        .otherwise(F.lit("/"))
    )
    blocks = F.ceil(F.col("size") / 4096.0).cast("long") * 4096
    return _entry(
        docs,
        machine=_machine(doc),
        entry_id=doc,
        kind=F.lit("file"),
        path=F.concat(
            F.lit("/home/"), "source", place, "lang", F.lit("/doc"), doc.cast("string"), suffix
        ),
        logical_size=F.col("size"),
        allocated_size=F.when(mod(11) == 0, F.lit(0)).when(mod(29) != 0, blocks),
        modified=F.timestamp_seconds(
            F.when(mod(37) != 0, F.pmod(doc * 7919, F.lit(100000)) - 5000)
        ),
        file_id=F.struct(
            F.lit(1).cast("long").alias("volume"),
            F.when(mod(3) == 0, F.col("first")).otherwise(doc).alias("index"),
        ),
        link_count=F.lit(1),
        cloud=_cloud(
            F.when(mod(11) == 0, F.lit("remote"))
            .when(mod(23) == 0, F.lit("unknown"))
            .when(mod(3) == 0, F.lit("local"))
            .otherwise(F.lit("not_synced"))
        ),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbolic link per page."""
    page = F.col("page_id")
    text = lambda n: F.pmod(page, F.lit(n)).cast("string")
    turn = F.pmod(page, F.lit(4))
    target = (
        F.when(turn == 0, F.lit("/home/src1/en"))
        .when(turn == 1, F.concat(F.lit("/Volumes/ext"), text(5)))
        .when(turn == 2, F.concat(F.lit("shared/"), text(3)))
        .otherwise(F.concat(F.lit("/home/src"), text(7), F.lit("/old")))
    )
    return _entry(
        source(spark, sf_dir, "pages"),
        machine=_machine(page),
        entry_id=page + FIRST_LINK,
        kind=F.lit("symlink"),
        path=F.concat(F.lit("/home/src"), text(20), F.lit("/link"), page.cast("string")),
        logical_size=F.octet_length(target),
        link_target=target,
        link_count=F.lit(1),
        cloud=_cloud(F.lit("not_synced")),
    )


def region_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One provider cache folder per region."""
    key = F.col("r_regionkey")
    return _entry(
        source(spark, sf_dir, "region"),
        machine=_machine(key),
        entry_id=key + FIRST_MARKER,
        kind=F.lit("directory"),
        path=F.concat(F.lit("/Volumes/ext"), key.cast("string"), F.lit("/.dropbox.cache")),
        logical_size=F.lit(4096),
        allocated_size=F.lit(4096),
        link_count=F.lit(1),
        cloud=_cloud(F.lit("local")),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory: files, links, marker folders, and every folder above them."""

    def build() -> DataFrame:
        leaves = pin(
            document_files(spark, sf_dir)
            .unionByName(page_links(spark, sf_dir))
            .unionByName(region_markers(spark, sf_dir))
        )
        folders = (
            leaves.select("machine", paths.parent(F.col("path")).alias("folder"))
            .distinct()
            .select("machine", F.explode(paths.self_and_ancestors(F.col("folder"))).alias("path"))
            .distinct()
            .join(leaves.where("kind = 'directory'"), ["machine", "path"], "left_anti")
        )
        numbered = scale.number_rows(
            folders, [F.col("machine"), paths.parts(F.col("path"))], "at", start=1
        )
        directories = _entry(
            numbered,
            machine=F.col("machine"),
            entry_id=F.col("at") + FIRST_DIRECTORY,
            kind=F.lit("directory"),
            path=F.col("path"),
            logical_size=F.lit(4096),
            allocated_size=F.lit(4096),
            link_count=F.lit(1),
            cloud=_cloud(F.lit("not_synced")),
        )
        return leaves.unionByName(directories).sortWithinPartitions("machine", "path")

    return stored(spark, sf_dir, "entries", build)


def unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unread place per event."""
    kind = F.col("event_type")
    return source(spark, sf_dir, "events").select(
        _machine(F.col("event_id")).alias("machine"),
        F.concat(
            F.lit("/home/src"),
            F.pmod("user_id", F.lit(20)).cast("string"),
            F.lit("/event"),
            F.col("event_id").cast("string"),
        ).alias("path"),
        F.when(kind == "view", F.lit("permission_denied"))
        .when(kind == "click", F.lit("would_require_download"))
        .when(kind == "signup", F.lit("vanished"))
        .otherwise(F.lit("other"))
        .alias("reason"),
        F.when(kind.isin("purchase", "error"), F.concat(kind, F.lit(" "), "props")).alias("detail"),
    )


def roots(spark: SparkSession) -> DataFrame:
    """Provider directories: a small dimension beside the inventory."""
    rows = [(m, p, v, None, "provider_mount") for m in MACHINES for p, v in ROOTS]
    return spark.createDataFrame(rows, schema.CLOUD_ROOT)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later snapshot: low-quality files vanished, toxic ones grew by a byte, and
    French files of one source refuse to be looked at."""

    def build() -> DataFrame:
        labels = source(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("entry_id"), "quality", "toxic"
        )
        seen = entries(spark, sf_dir).join(labels, "entry_id", "left")
        refused = F.startswith("path", F.lit("/home/src9/fr/"))
        return seen.where(F.coalesce("quality", F.lit(1)) != 0).select(
            *[f.name for f in schema.ENTRY.fields if f.name != "logical_size"],
            (F.col("logical_size") + F.coalesce("toxic", F.lit(0))).alias("logical_size"),
            F.when((F.col("kind") == "file") & refused, F.lit("permission_denied")).alias(
                "refusal"
            ),
        )

    return stored(spark, sf_dir, "observed", build)


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark,
        sf_dir,
        "settled",
        lambda: duplicates.settle(entries(spark, sf_dir), content(spark, sf_dir)),
    )


def analysis(spark: SparkSession, sf_dir: str) -> duplicates.Analysis:
    """The analysis artifact over both machines together."""
    marks = settled(spark, sf_dir)
    found: list[duplicates.Analysis] = []

    def once() -> duplicates.Analysis:
        if not found:
            found.append(duplicates.analysis_of(entries(spark, sf_dir), marks))
        return found[0]

    return duplicates.Analysis(
        marks,
        stored(spark, sf_dir, "duplicate_group", lambda: once().groups),
        stored(spark, sf_dir, "group_member", lambda: once().members),
    )
