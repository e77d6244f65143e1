"""Carrying a plan out on a snapshot, and putting it back. No file is touched.

Steps run in order, so a step can be affected by an earlier one: its source left
with a folder, its destination was vacated, taken, or arrived inside a moved
folder. Those few links are joined out by path; all other steps are decided at
once, and linked ones in as many rounds as their links are deep.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens import schema
from filelens.functions import paths
from filelens.functions import content as digests
from filelens.operators import scale
from filelens.operators.duplicates import digest_entries
from filelens.operators.ownership import longest_root
from filelens.plans.preflight import UNREADABLE, looked_at, with_looks
from filelens.session import pin


@dataclass
class Run:
    steps: DataFrame
    after: DataFrame


def _trouble_at_source(
    moves: DataFrame, observed: DataFrame, content: DataFrame | None, slices: int | None
) -> DataFrame:
    """Add ``own``: what a fresh look at the source holds against a move. Only
    content is compared, and only where it was recorded."""
    rows = with_looks(moves, observed, {"from_path": "source"}, "seq", slices=slices)
    if content is None:
        rows = rows.withColumn("actual", F.col("content"))
    else:
        rows = pin(rows)
        wanted = rows.where(
            "content is not null and source is not null and source.refusal is null "
            "and not source.may_download"
        ).select(F.col("source.entry_id").alias("entry_id"))
        again = digest_entries(content, wanted, digests.full_digest(F.col("content")))
        again = again.select(F.col("entry_id").alias("_read"), F.col("digest").alias("actual"))
        rows = rows.join(again, F.col("source.entry_id") == F.col("_read"), "left")
    recorded = F.col("content").isNotNull()
    own = (
        F.when(F.col("source").isNull(), F.lit("source_missing"))
        .when(F.col("source.refusal").isNotNull(), F.lit("other"))
        .when(F.col("source.may_download"), F.lit("content_not_present"))
        .when(recorded & F.col("actual").isNull(), F.lit("other"))
        .when(recorded & (F.col("actual") != F.col("content")), F.lit("source_changed"))
    )
    detail = F.when(
        own == "other", F.coalesce(F.col("source.refusal"), F.lit(UNREADABLE))
    )
    return rows.withColumn("own", own).withColumn("detail", detail)


def _links(moves: DataFrame, observed: DataFrame, slices: int | None) -> DataFrame:
    """Which earlier moves bear on which later ones, and how.

    ``gone``: the source lies in a folder an earlier move takes along.
    ``freed``: the destination, or a folder above it, is moved away earlier.
    ``filled``: an earlier folder move brings something to the destination.
    """
    able = moves.where("own is null")
    movers = able.select(
        "machine",
        F.col("seq").alias("by"),
        F.col("from_path").alias("by_from"),
        F.col("to_path").alias("by_to"),
        "is_folder",
    )
    folders = pin(movers.where("is_folder").drop("is_folder"))
    before = F.col("by") < F.col("seq")
    carried_by = F.array_contains("through", F.col("by"))

    def above(column: str, at: str) -> DataFrame:
        """Moves whose path lies strictly below an earlier folder move's path."""
        points = able.select(
            "machine", "seq", column, "through", F.explode(paths.ancestors(F.col(column))).alias(at)
        )
        return scale.look_up(points, folders, ["machine", at], "seq", "inner").where(before)

    def at_same(column: str) -> DataFrame:
        """Moves whose path is exactly where an earlier move starts."""
        starts = movers.groupBy("machine", F.col("by_from").alias(column)).agg(
            F.min("by").alias("by")
        )
        points = able.select("machine", "seq", column)
        return scale.join_counted(
            points, starts, ["machine", column], "seq", slice_rows=slices
        ).where(before)

    link = lambda frame, how: frame.select("seq", "by", F.lit(how).alias("how"))
    found = [link(at_same("from_path"), "gone"), link(at_same("to_path"), "freed")]
    if not folders.isEmpty():
        arriving = above("to_path", "by_to").withColumn(
            "path", paths.rebase(F.col("to_path"), F.col("by_to"), F.col("by_from"))
        )
        places = arriving.select("machine", "path").distinct()
        existing = looked_at(observed, places).where("seen is not null").select("machine", "path")
        filled = scale.join_counted(
            arriving, existing, ["machine", "path"], "seq", "left_semi", slices
        )
        found += [
            link(above("from_path", "by_from").where(~carried_by), "gone"),
            link(above("to_path", "by_from"), "freed"),
            link(filled, "filled"),
        ]
    return reduce(DataFrame.unionByName, found)


def carry_out(
    moves: DataFrame, observed: DataFrame, slices: int | None = scale.SLICE_ROWS
) -> DataFrame:
    """Add ``done`` and ``reason`` to ordered moves (seq, machine, from_path,
    to_path, is_folder, own, detail). Of several moves to one place the first that
    can be made is made; nothing is ever written over."""
    moves = pin(with_looks(moves, observed, {"to_path": "there"}, "seq", slices=slices))
    links = pin(_links(moves, observed, slices))
    bearing = links.groupBy("by").agg(F.count(F.lit(1)).alias("_rows"))
    claim = ["machine", "to_path"]
    how, able, seq = F.col("how"), F.col("able"), F.col("seq")
    decided = None
    pending = moves.withColumn("won", F.lit(False))
    while True:
        if decided is None:
            known = links.withColumn("by_done", F.lit(None).cast("boolean"))
        else:
            state = decided.select(F.col("seq").alias("by"), F.col("done").alias("by_done"))
            known = scale.join_hot(
                links, state.join(bearing, "by"), ["by"], "_rows", "seq", "left", slices
            )
        did = lambda what: F.coalesce(
            F.bool_or((how == what) & F.col("by_done")), F.lit(False)
        ).alias(what)
        facts = known.groupBy("seq").agg(
            F.count_if(F.col("by_done").isNull()).alias("open"),
            did("gone"),
            did("freed"),
            did("filled"),
        )
        looked = pending.join(facts, "seq", "left").na.fill(False, ["gone", "freed", "filled"])
        looked = looked.withColumn(
            "able",
            F.when(F.col("own").isNotNull(), F.lit(False))
            .when(F.coalesce("open", F.lit(0)) > 0, F.lit(None))
            .otherwise(
                ~F.col("gone")
                & ~F.col("won")
                & ~F.col("filled")
                & (F.col("there").isNull() | F.col("freed"))
            ),
        )
        claims = looked.groupBy(*claim).agg(
            F.min(F.when(able, seq)).alias("winner"),
            F.min(F.when(able.isNull(), seq)).alias("first_open"),
            F.count(F.lit(1)).alias("_rows"),
        )
        taken = F.col("winner").isNotNull() & (
            F.col("first_open").isNull() | (F.col("first_open") > F.col("winner"))
        )
        round_ = pin(
            scale.join_hot(looked, claims, claim, "_rows", "seq", slice_rows=slices)
            .withColumn("taken", taken)
            .withColumn("ready", able.isNotNull() & (~able | F.col("taken")))
        )
        now = round_.where("ready").select(
            *moves.columns,
            (able & (seq == F.col("winner"))).alias("done"),
            F.when(F.col("own").isNotNull(), F.col("own"))
            .when(F.col("gone"), F.lit("source_missing"))
            .when(~able | (seq != F.col("winner")), F.lit("destination_occupied"))
            .alias("reason"),
        )
        decided = now if decided is None else decided.unionByName(now)
        pending = round_.where("not ready").select(
            *moves.columns, (F.col("won") | F.col("taken")).alias("won")
        )
        if pending.isEmpty():
            return decided


def final_places(moved: DataFrame) -> DataFrame:
    """Add ``final`` and ``through`` to moves made: where a moved row ends up once
    later folder moves took it along, and which ones did, in order. As many rounds
    as moves are nested; without folder moves there are none."""
    rows = moved.withColumns(
        {
            "final": F.col("to_path"),
            "through": F.array().cast("array<bigint>"),
            "_since": F.col("seq"),
        }
    )
    folders = pin(
        moved.where("is_folder").select(
            "machine",
            F.col("from_path").alias("_at"),
            F.col("to_path").alias("_lands"),
            F.col("seq").alias("_by"),
        )
    )
    while not folders.isEmpty():
        points = rows.select(
            "machine", "seq", "_since", F.explode(paths.ancestors(F.col("final"))).alias("_at")
        )
        taken = (
            scale.look_up(points, folders, ["machine", "_at"], "seq", "inner")
            .where("_by > _since")
            .groupBy("seq")
            .agg(F.min(F.struct("_by", "_at", "_lands")).alias("_next"))
        )
        rows = pin(rows.join(taken, "seq", "left"))
        last = rows.where("_next is not null").isEmpty()
        moves_on = F.col("_next").isNotNull()
        rows = rows.withColumns(
            {
                "final": F.when(
                    moves_on,
                    paths.rebase(F.col("final"), F.col("_next._at"), F.col("_next._lands")),
                ).otherwise(F.col("final")),
                "through": F.when(
                    moves_on, F.array_append("through", F.col("_next._by"))
                ).otherwise(F.col("through")),
                "_since": F.coalesce("_next._by", "_since"),
            }
        ).drop("_next")
        if last:
            break
    return rows.drop("_since")


def moved_rows(entries: DataFrame, moved: DataFrame) -> DataFrame:
    """Rewrite paths after moves made (seq, machine, from_path, to_path, is_folder):
    a row takes its own move, else the one of the nearest moved folder above it."""
    moved = final_places(moved).withColumn("to_path", F.col("final"))
    own = moved.select(
        "machine", F.col("from_path").alias("path"), F.col("to_path").alias("_own")
    )
    folders = pin(
        moved.where("is_folder").select("machine", F.col("from_path").alias("path"), "to_path")
    )
    rows = longest_root(
        entries.join(own, ["machine", "path"], "left"), folders, ["to_path"], name="_with"
    )
    now = (
        F.when(F.col("_own").isNotNull(), F.col("_own"))
        .when(
            F.col("_with").isNotNull(),
            paths.rebase(F.col("path"), F.col("_with.path"), F.col("_with.to_path")),
        )
        .otherwise(F.col("path"))
    )
    return rows.withColumn("path", now).select(*entries.columns)


def _step_frame(frame: DataFrame, **columns) -> DataFrame:
    columns = {
        "attempt": F.lit(1),
        "at": F.current_timestamp(),
        "detail": F.lit(None),
        "reason": F.lit(None),
        **columns,
    }
    return frame.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in schema.STEP.fields]
    )


def apply_snapshot(
    operations: DataFrame,
    observed: DataFrame,
    quarantine: str,
    content: DataFrame | None = None,
) -> Run:
    """Carry passing operations out on a snapshot: one resolved step each, and the
    snapshot as it would be afterwards. ``operations`` are those a preflight
    passed; every subject is looked at once more first."""
    operations = pin(operations)
    if operations.isEmpty():
        raise ValueError("nothing passed preflight, so there is nothing to carry out")
    slices = scale.slices_for(operations)
    making = with_looks(
        operations.where("kind = 'create_directory'"),
        observed,
        {"destination": "there"},
        "position",
        slices=slices,
    )
    blocked = F.col("there").isNotNull() & (F.col("there.kind") != "directory")
    made = making.withColumn("blocked", blocked)
    make_steps = _step_frame(
        made,
        sequence=F.col("position"),
        operation=F.col("position"),
        machine=F.col("machine"),
        progress=F.when(F.col("blocked"), F.lit("failed")).otherwise(F.lit("done")),
        reason=F.when(F.col("blocked"), F.lit("could not create")),
        from_path=F.col("destination"),
        to_path=F.lit(None),
        content=F.lit(None),
    )
    moves = operations.where("kind <> 'create_directory'").select(
        F.col("position").alias("seq"),
        "machine",
        F.col("subject_path").alias("from_path"),
        F.when(
            F.col("kind") == "quarantine",
            paths.quarantine_place(F.col("subject_path"), F.lit(quarantine)),
        )
        .otherwise(F.col("destination"))
        .alias("to_path"),
        "is_folder",
        "content",
    )
    moves = _trouble_at_source(moves, observed, content, slices).select(
        "seq",
        "machine",
        "from_path",
        "to_path",
        "is_folder",
        "content",
        "own",
        "detail",
        F.array().cast("array<bigint>").alias("through"),
    )
    outcome = pin(carry_out(moves, observed, slices))
    move_steps = _step_frame(
        outcome,
        sequence=F.col("seq"),
        operation=F.col("seq"),
        machine=F.col("machine"),
        progress=F.when(F.col("done"), F.lit("done")).otherwise(F.lit("skipped")),
        reason=F.col("reason"),
        detail=F.col("detail"),
        from_path=F.col("from_path"),
        to_path=F.when(F.col("done"), F.col("to_path")),
        content=F.col("content"),
    )
    after = moved_rows(observed, outcome.where("done"))
    fresh = made.where("there is null").select("machine", F.col("destination").alias("path"))
    after = after.unionByName(_new_folders(fresh, observed), allowMissingColumns=True)
    return Run(make_steps.unionByName(move_steps), after)


def _new_folders(folders: DataFrame, like: DataFrame) -> DataFrame:
    """Folder rows as a scan would find them, without an entry id of their own."""
    cloud = F.struct(
        F.lit(None).cast("string").alias("provider"),
        F.lit("not_synced").alias("residency"),
        F.lit("unspecified").alias("retention"),
    )
    given = {
        "machine": F.col("machine"),
        "path": F.col("path"),
        "kind": F.lit("directory"),
        "logical_size": F.lit(0),
        "link_count": F.lit(1),
        "cloud": cloud,
    }
    return folders.select(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def reversible(steps: DataFrame) -> DataFrame:
    return steps.where("progress = 'done' and to_path is not null")


def reversal_order(steps: DataFrame) -> DataFrame:
    """Reversible steps, newest first."""
    return reversible(steps).orderBy(F.desc("sequence"))


def undo_snapshot(steps: DataFrame, observed: DataFrame, strict_parity: bool = False) -> Run:
    """Put back what a run moved, newest step first; an original path that has
    been taken since is left alone. Folders the run created are removed when
    nothing is in them, unless ``strict_parity`` leaves them like the original."""
    made_moves = reversible(steps).select(
        F.col("sequence").alias("seq"), "operation", "machine", "from_path", "to_path", "content"
    )
    made_moves = pin(made_moves)
    slices = scale.slices_for(made_moves)
    if made_moves.isEmpty():
        raise ValueError("this run changed nothing, so there is nothing to put back")
    # A folder stays a folder wherever it went, so what lies below its place in
    # the snapshot went with it.
    above = (
        observed.select("machine", paths.parent(F.col("path")).alias("path"))
        .where("path is not null")
        .distinct()
        .select("machine", F.explode(paths.self_and_ancestors(F.col("path"))).alias("to_path"))
        .distinct()
    )
    listed = observed.where("kind = 'directory'").select("machine", F.col("path").alias("to_path"))
    holding = above.unionByName(listed).distinct().withColumn("is_folder", F.lit(True))
    made_moves = made_moves.join(holding, ["machine", "to_path"], "left").na.fill(
        False, ["is_folder"]
    )
    placed = final_places(pin(made_moves)).select(
        (-F.col("seq")).alias("seq"),
        "operation",
        "machine",
        F.col("to_path").alias("recorded"),
        F.col("final").alias("from_path"),
        F.col("from_path").alias("to_path"),
        "content",
        F.transform("through", lambda s: -s).alias("through"),
    )
    back = with_looks(placed, observed, {"from_path": "source"}, "seq", slices=slices)
    moves = back.select(
        "seq",
        "operation",
        "machine",
        "from_path",
        "to_path",
        "recorded",
        F.coalesce(F.col("source.kind") == "directory", F.lit(False)).alias("is_folder"),
        "content",
        F.when(F.col("source").isNull(), F.lit("could not move")).alias("own"),
        F.lit(None).cast("string").alias("detail"),
        "through",
    )
    outcome = pin(carry_out(moves, observed, slices))
    after = moved_rows(observed, outcome.where("done"))
    failed = F.col("reason") == "could not move"
    put_back = _step_frame(
        outcome,
        sequence=F.col("seq"),
        operation=F.col("operation"),
        machine=F.col("machine"),
        progress=F.when(F.col("done"), F.lit("done"))
        .when(failed, F.lit("failed"))
        .otherwise(F.lit("skipped")),
        reason=F.col("reason"),
        from_path=F.col("recorded"),
        to_path=F.when(F.col("done"), F.col("to_path")),
        content=F.col("content"),
    )
    if strict_parity:
        return Run(put_back, after)
    made = steps.where("progress = 'done' and to_path is null").select(
        "sequence", "operation", "machine", F.col("from_path").alias("path")
    )
    removal, after = _remove_empty(made, after)
    return Run(put_back.unionByName(removal), after)


def _remove_empty(made: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove created folders that hold nothing but created folders."""
    ours = made.select("machine", "path").distinct()
    kept_above = (
        after.select("machine", "path")
        .join(ours, ["machine", "path"], "left_anti")
        .select("machine", paths.parent(F.col("path")).alias("path"))
        .where("path is not null")
        .distinct()
        .select("machine", F.explode(paths.self_and_ancestors(F.col("path"))).alias("path"))
        .distinct()
    )
    held = kept_above.withColumn("held", F.lit(True))
    judged = made.join(held, ["machine", "path"], "left")
    removal = _step_frame(
        judged,
        sequence=-F.col("sequence"),
        operation=F.col("operation"),
        machine=F.col("machine"),
        progress=F.when(F.col("held"), F.lit("skipped")).otherwise(F.lit("done")),
        reason=F.when(F.col("held"), F.lit("other")),
        detail=F.when(F.col("held"), F.lit("left in place")),
        from_path=F.col("path"),
        to_path=F.lit(None),
        content=F.lit(None),
    )
    gone = judged.where("held is null").select("machine", "path")
    return removal, after.join(gone, ["machine", "path"], "left_anti").select(*after.columns)
