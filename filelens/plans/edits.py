"""Edit logs: replaying them, what changes, what was refused, what to do about it.

An edit log is sequential by nature: each edit sees what the earlier ones did.
Only that decision is made in order, per machine, over the log and the entries
that could stand in its way. Where everything ends up is then a join: an entry
nobody named moves only with the nearest folder above it that somebody did.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.functions import paths, wording
from filelens.operators import scale
from filelens.operators.ownership import longest_root
from filelens.plans.plan import operation_frame
from filelens.session import pin

EDIT_KINDS = ("new_directory", "rename", "relocate", "set_aside")
NAMELESS = "that has no name to keep"
NEEDS_NAME = "a folder needs a name of its own"

FOLDED = (
    "machine string, what string, position long, entry_id string, path string, "
    "reason string, detail string, is_folder boolean"
)


@dataclass
class Replayed:
    """``placed``: named entries with their final path, null when set aside.
    ``asked_at`` is the first accepted edit that named them."""

    edits: DataFrame
    placed: DataFrame
    refusals: DataFrame
    new_directories: DataFrame


def in_the_way(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """The entries a log can touch or run into.

    An edit can only be stopped by an entry at its destination. Such an entry
    carries a name the log uses, and sits in a folder the log uses or below a
    folder the log moves; everything else is irrelevant to every decision.
    """
    # A log brings at most three names and three folders per edit, so its own size
    # bounds what is broadcast.
    small = scale.is_small(edits, scale.BROADCAST_ROWS // 4)
    asked = edits.where("entry_id is not null").select("machine", "entry_id").distinct()
    if small:
        asked = F.broadcast(asked)
    named = entries.select("machine", "entry_id", "path", "kind").join(
        asked, ["machine", "entry_id"], "left_semi"
    )
    named = pin(named)
    subject = F.col("path")
    names = (
        edits.where("path is not null").select("machine", paths.file_name(subject).alias("_name"))
        .unionByName(
            edits.where("name is not null").select(
                "machine", paths.trimmed_name(F.col("name")).alias("_name")
            )
        )
        .unionByName(named.select("machine", paths.file_name(subject).alias("_name")))
        .where("_name is not null")
        .distinct()
    )
    folders = (
        edits.where("path is not null").select("machine", subject.alias("_in"))
        .unionByName(
            edits.where("path is not null").select("machine", paths.parent(subject).alias("_in"))
        )
        .unionByName(named.select("machine", paths.parent(subject).alias("_in")))
        .where("_in is not null")
        .distinct()
        .withColumn("_used", F.lit(True))
    )
    moving = named.where("kind = 'directory'").select("machine", "path").distinct()
    near = entries.select(
        "machine",
        "entry_id",
        "path",
        "kind",
        paths.file_name(subject).alias("_name"),
        paths.parent(subject).alias("_in"),
    )
    if small:
        near = near.join(F.broadcast(names), ["machine", "_name"], "left_semi")
        near = near.join(F.broadcast(folders), ["machine", "_in"], "left")
    else:
        names, folders = pin(names), pin(folders)
        near = scale.join_counted(near, names, ["machine", "_name"], "entry_id", "left_semi")
        near = scale.join_counted(near, folders, ["machine", "_in"], "entry_id", "left")
    near = longest_root(near, moving, []).where("_used or owner is not null")
    return near.select("machine", "entry_id", "path", "kind").unionByName(named).distinct()


def _under(path: str, folder: str) -> bool:
    return path.startswith(folder.rstrip("/") + "/")


def _bad_name(name: str) -> str | None:
    if not name:
        return paths.NAME_EMPTY
    if name in (".", ".."):
        return paths.NAME_DOTS
    return paths.NAME_SEPARATOR if "/" in name else None


class _Refused(Exception):
    def __init__(self, reason: str, detail: str | None = None):
        super().__init__(reason)
        self.reason, self.detail = reason, detail


class _Board:
    """Paths of the entries a log can touch, and who holds each path now."""

    def __init__(self, rows: pd.DataFrame):
        self.where = dict(zip(rows["entry_id"], rows["path"], strict=True))
        self.folder = {e for e, k in zip(rows["entry_id"], rows["kind"], strict=True) if k == "directory"}
        self.held: dict[str, object] = {p: e for e, p in self.where.items()}
        self.aside: set = set()

    def living(self, entry) -> str:
        if entry in self.aside:
            raise _Refused("already_aside")
        if entry not in self.where:
            raise _Refused("no_such_entry")
        return self.where[entry]

    def apply(self, kind: str, entry, path: str | None, name: str | None) -> bool:
        """Make one edit; whether anything changed."""
        if kind == "new_directory":
            return self._make(path)
        here = self.living(entry)
        folder, _, own = here.rpartition("/")
        if kind == "set_aside":
            if entry in self.folder:
                raise _Refused("folders_are_not_set_aside")
            self.held.pop(self.where.pop(entry), None)
            self.aside.add(entry)
            return True
        if kind == "rename":
            name = name.strip()
            if trouble := _bad_name(name):
                raise _Refused("not_a_name", trouble)
            return self._put(entry, here, f"{folder}/{name}")
        if not path.startswith("/"):
            raise _Refused("not_absolute")
        into = self.held.get(path)
        if path != "/" and into != "new" and into not in self.folder:
            raise _Refused("not_a_directory")
        if not own:
            raise _Refused("not_a_name", NAMELESS)
        return self._put(entry, here, f"{path.rstrip('/')}/{own}")

    def _make(self, path: str) -> bool:
        if not path.startswith("/"):
            raise _Refused("not_absolute")
        if _bad_name(path.rpartition("/")[2].strip()):
            raise _Refused("not_a_name", NEEDS_NAME)
        if path in self.held:
            raise _Refused("occupied")
        self.held[path] = "new"
        return True

    def _put(self, entry, here: str, there: str) -> bool:
        if here == there:
            return False
        if _under(there, here):
            raise _Refused("into_itself")
        if there in self.held:
            raise _Refused("occupied")
        moving = [here]
        if entry in self.folder:
            moving += [p for p in self.held if _under(p, here)]
        for path, holder in [(p, self.held.pop(p)) for p in moving]:
            lands = there + path[len(here) :]
            self.held[lands] = holder
            if holder != "new":
                self.where[holder] = lands
        return True


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    machine = rows["machine"].iloc[0]
    board = _Board(rows[rows["what"] == "entry"])
    log = rows[rows["what"] == "edit"].sort_values("position")
    out, first_accepted = [], {}
    text = lambda v: None if pd.isna(v) else v
    for row in log.itertuples():
        entry = text(row.entry_id)
        try:
            if board.apply(row.kind, entry, text(row.path), text(row.name)) and entry is not None:
                first_accepted.setdefault(entry, row.position)
        except _Refused as why:
            out.append((machine, "refusal", row.position, entry, None, why.reason, why.detail, None))
    for entry in {e for e in log["entry_id"].dropna()}:
        if entry in board.where or entry in board.aside:
            out.append(
                (
                    machine,
                    "placed",
                    first_accepted.get(entry),
                    entry,
                    board.where.get(entry),
                    None,
                    None,
                    entry in board.folder,
                )
            )
    for path, holder in board.held.items():
        if holder == "new":
            out.append((machine, "new", None, None, path, None, None, True))
    columns = [c.split()[0] for c in FOLDED.split(", ")]
    frame = pd.DataFrame(out, columns=columns)
    return frame.astype({"position": "Int64"})


def replay(entries: DataFrame, edits: DataFrame) -> Replayed:
    """Apply an ordered log; refusals are recorded, never raised."""
    near = in_the_way(entries, edits).select(
        "machine",
        F.lit("entry").alias("what"),
        F.lit(None).cast("long").alias("position"),
        "kind",
        F.col("entry_id").cast("string"),
        "path",
        F.lit(None).cast("string").alias("name"),
    )
    log = edits.select(
        "machine",
        F.lit("edit").alias("what"),
        "position",
        "kind",
        F.col("entry_id").cast("string"),
        "path",
        "name",
    )
    # Ids travel as text: a nullable long would arrive in pandas as a float.
    folded = log.unionByName(near).groupBy("machine").applyInPandas(_fold, FOLDED)
    folded = pin(folded.withColumn("entry_id", F.col("entry_id").cast("long")))
    placed = folded.where("what = 'placed'").select(
        "machine", "entry_id", F.col("path").alias("final"), F.col("position").alias("asked_at"),
        "is_folder",
    )
    refusals = folded.where("what = 'refusal'").select(
        "machine",
        "position",
        "reason",
        wording.refusal(F.col("reason"), F.col("detail")).alias("wording"),
    )
    new = folded.where("what = 'new'").select("machine", "path")
    return Replayed(edits, placed, refusals, new)


def take_back_last(entries: DataFrame, edits: DataFrame) -> Replayed:
    """Replay all but the last edit of each machine's log."""
    last = edits.groupBy("machine").agg(F.max("position").alias("_last"))
    return replay(
        entries, edits.join(last, "machine").where("position < _last").drop("_last")
    )


def arranged(entries: DataFrame, replayed: Replayed) -> DataFrame:
    """Entries with ``now_path``: where the log leaves them, null when set aside."""
    origin = entries.select("machine", "entry_id", "path")
    folders = (
        replayed.placed.where("is_folder")
        .join(origin, ["machine", "entry_id"])
        .select("machine", "path", "final")
    )
    folders = pin(folders)
    own = replayed.placed.select("machine", "entry_id", "final", F.lit(True).alias("_named"))
    rows = longest_root(entries.join(own, ["machine", "entry_id"], "left"), folders, ["final"], name="_with")
    now = (
        F.when(F.col("_named"), F.col("final"))
        .when(
            F.col("_with").isNotNull(),
            paths.rebase(F.col("path"), F.col("_with.path"), F.col("_with.final")),
        )
        .otherwise(F.col("path"))
    )
    return rows.withColumn("now_path", now).select(*entries.columns, "now_path")


def changes(entries: DataFrame, replayed: Replayed) -> DataFrame:
    """Before and after of everything that ends up elsewhere; ``carried`` rows
    moved only because a folder above them did."""
    asked = replayed.edits.where("entry_id is not null").select(
        "machine", "entry_id", F.lit(True).alias("_asked")
    ).distinct()
    return (
        arranged(entries, replayed)
        .where("now_path is null or now_path <> path")
        .join(asked, ["machine", "entry_id"], "left")
        .select(
            "machine",
            "entry_id",
            F.col("path").alias("was"),
            F.col("now_path").alias("becomes"),
            F.col("_asked").isNull().alias("carried"),
        )
    )


def changes_page(found: DataFrame, offset: int, limit: int) -> DataFrame:
    return found.orderBy(paths.parts(F.col("was")), "machine").offset(offset).limit(limit)


def new_directories(replayed: Replayed) -> DataFrame:
    """Folders to make, parents first."""
    return replayed.new_directories.orderBy("machine", paths.parts(F.col("path")))


def edit_operations(entries: DataFrame, replayed: Replayed, settled: DataFrame) -> DataFrame:
    """Operations a log comes to: one per new folder, one per entry whose own edit
    took effect and left it elsewhere, none for what was carried."""
    making = operation_frame(
        replayed.new_directories,
        kind=F.lit("create_directory"),
        machine=F.col("machine"),
        destination=F.col("path"),
        frees_bytes=F.lit(0),
        is_folder=F.lit(True),
    )
    known = settled.where("kind = 'content'").select("machine", "entry_id", "fingerprint")
    acting = (
        entries.join(
            replayed.placed.where("asked_at is not null"), ["machine", "entry_id"]
        )
        .where("final is null or final <> path")
        .join(known, ["machine", "entry_id"], "left")
    )
    aside = F.col("final").isNull()
    moving = operation_frame(
        acting,
        kind=F.when(aside, F.lit("quarantine")).otherwise(F.lit("move")),
        machine=F.col("machine"),
        entry_id=F.col("entry_id"),
        subject_path=F.col("path"),
        destination=F.col("final"),
        content=F.col("fingerprint"),
        logical_size=F.col("logical_size"),
        modified_s=F.unix_seconds("modified"),
        because=F.lit("requested"),
        frees_bytes=F.when(aside, F.coalesce("allocated_size", F.lit(0))).otherwise(F.lit(0)),
        is_folder=F.col("is_folder"),
    )
    return making.unionByName(moving)


def counters(entries: DataFrame, replayed: Replayed) -> DataFrame:
    """Edits asked, differences, new folders and files set aside, per machine."""
    count = lambda frame, name: frame.groupBy("machine").agg(
        F.count(F.lit(1)).alias(name)
    )
    asked = count(replayed.edits, "asked")
    parts = [
        count(replayed.refusals, "refused"),
        count(changes(entries, replayed), "differences"),
        count(replayed.new_directories, "new_folders"),
        count(replayed.placed.where("final is null"), "set_aside"),
    ]
    for part in parts:
        asked = asked.join(part, "machine", "left")
    return asked.na.fill(0)


def listing(entries: DataFrame, replayed: Replayed, folder: str) -> DataFrame:
    """What one folder holds once the log is applied, folders to be made included."""
    rows = arranged(entries, replayed).where(paths.parent(F.col("now_path")) == folder)
    held = rows.select(
        "machine",
        F.lit(1).alias("section"),
        "entry_id",
        paths.file_name(F.col("now_path")).alias("name"),
        (F.col("kind") == "directory").alias("is_folder"),
        F.col("logical_size").alias("size"),
        (F.col("now_path") != F.col("path")).alias("moved"),
    )
    made = replayed.new_directories.where(paths.parent(F.col("path")) == folder).select(
        "machine",
        F.lit(0).alias("section"),
        F.lit(None).cast("long").alias("entry_id"),
        paths.file_name(F.col("path")).alias("name"),
        F.lit(True).alias("is_folder"),
        F.lit(0).cast("long").alias("size"),
        F.lit(True).alias("moved"),
    )
    return made.unionByName(held)


def browse(
    entries: DataFrame, replayed: Replayed, machine: str, folder: str, offset: int, limit: int
) -> tuple[DataFrame, DataFrame]:
    """One page of a folder, new folders first, then folders, then by name; and
    the total as a one-row frame."""
    rows = listing(entries.where(F.col("machine") == machine), replayed, folder).where(
        F.col("machine") == machine
    )
    page = (
        rows.orderBy("section", F.desc("is_folder"), "name", "entry_id")
        .offset(offset)
        .limit(limit)
        .drop("section", "machine")
    )
    return page, rows.agg(F.count(F.lit(1)).alias("total"))

