from __future__ import annotations

import random

import pytest

from filelens import schema
from filelens.plans import carry, preflight
from filelens.sources import journal
from tests.conftest import entry, folder, rows, sha


def operations(frame, *items):
    """(kind, entry_id, subject, destination, content, is_folder) rows."""
    out = []
    for i, (kind, e, subject, place, content, is_dir) in enumerate(items):
        out.append((i, kind, "mac", e, subject, place, content, 10, 1000, "requested", None, 5, is_dir))
    return frame(out, schema.OPERATION)


def move(e, subject, place, content=None, is_dir=False):
    return ("move", e, subject, place, content, is_dir)


def quarantine(e, subject, content=None):
    return ("quarantine", e, subject, None, content, False)


def make(path):
    return ("create_directory", None, None, path, None, True)


def verdicts(frame, observed, *items, **given):
    found = preflight.preflight(operations(frame, *items), observed, **given)
    return {r.operation: (r.grade, r.impediment) for r in found.collect()}


def test_impediments_in_their_fixed_order(frame):
    observed = frame([
        folder("/d", 0), entry("/d/ok", 1), entry("/d/changed", 2, 11), entry("/d/cloud", 3, residency="remote"),
        entry("/d/taken", 4), entry("/d/leaving", 5), entry("/d/old", 6, modified=5), entry("/file", 7),
    ])
    got = verdicts(
        frame, observed, quarantine(1, "/d/ok"), quarantine(8, "/d/gone"), quarantine(2, "/d/changed"),
        quarantine(3, "/d/cloud"), move(1, "/d/ok", "/d/taken"), move(1, "/d/ok", "/d/leaving"),
        move(5, "/d/leaving", "/d/free"), move(1, "/d/ok", "/nowhere/x"), move(1, "/d/ok", "/made/x"),
        make("/made"), make("/d"), make("/file"), quarantine(6, "/d/old"), move(1, "/d/ok", "/d/cloud/x"),
    )
    assert got == {
        0: ("pass", None), 1: ("hold", "source_missing"), 2: ("hold", "source_changed"),
        3: ("hold", "content_not_present"), 4: ("hold", "destination_occupied"), 5: ("pass", None),
        6: ("pass", None), 7: ("hold", "destination_unreachable"), 8: ("pass", None), 9: ("pass", None),
        10: ("pass", None), 11: ("hold", "destination_occupied"), 12: ("hold", "source_changed"),
        13: ("hold", "destination_unreachable"),
    }


def test_a_refused_source_fails_and_a_refused_destination_holds(spark, frame):
    from pyspark.sql import functions as F

    observed = frame([folder("/d", 0), entry("/d/a", 1), entry("/d/b", 2)]).withColumn(
        "refusal", F.when(F.col("path") == "/d/b", F.lit("permission_denied"))
    )
    got = verdicts(frame, observed, quarantine(2, "/d/b"), move(1, "/d/a", "/d/b"), make("/d/b"))
    assert got == {
        0: ("fail", "permission_denied"), 1: ("hold", "permission_denied"), 2: ("fail", "permission_denied")
    }


def test_a_plan_row_without_a_time_is_held(frame):
    row = list(operations(frame, quarantine(1, "/a")).first())
    row[8] = None
    observed = frame([entry("/a", 1, modified=None)])
    found = preflight.preflight(frame([tuple(row)], schema.OPERATION), observed).first()
    assert (found.grade, found.impediment) == ("hold", "source_changed")


def test_content_is_read_again_only_where_it_was_recorded(frame, contents):
    observed = frame([entry("/a", 1), entry("/b", 2), entry("/c", 3)])
    content = contents([(1, "new"), (2, "same")])
    got = verdicts(
        frame, observed, quarantine(1, "/a", sha("old")), quarantine(2, "/b", sha("same")),
        quarantine(3, "/c"), quarantine(3, "/c", sha("unreadable")), rigour="content", content=content,
    )
    assert got == {
        0: ("hold", "source_changed"), 1: ("pass", None), 2: ("pass", None), 3: ("fail", "other")
    }


def test_ungraded_operations_do_not_pass(frame):
    both = operations(frame, quarantine(1, "/a"), quarantine(2, "/b"))
    graded = preflight.preflight(both.where("position = 0"), frame([entry("/a", 1)]))
    assert rows(preflight.passing(both, graded), "position") == [(0,)]
    total = preflight.standing(graded).first()
    assert (total.passing, total.total, total.clear) == (1, 1, True)


def run(frame, observed, *items, content=None):
    return carry.apply_snapshot(operations(frame, *items), observed, "/q", content)


def progress(steps):
    return {r.sequence: (r.progress, r.reason) for r in steps.collect()}


def test_apply_then_undo_restores_the_snapshot(frame):
    observed = frame([
        folder("/d", 0), entry("/d/a", 1), entry("/d/b", 2), folder("/d/in", 3), entry("/d/in/c", 4)
    ])
    done = run(
        frame, observed, make("/new"), move(3, "/d/in", "/new/in", None, True), move(1, "/d/a", "/d/z"),
        quarantine(2, "/d/b"),
    )
    assert rows(done.after, "path") == sorted([
        ("/d",), ("/d/z",), ("/q/d/b",), ("/new/in",), ("/new/in/c",), ("/new",)
    ])
    back = carry.undo_snapshot(done.steps, done.after)
    assert rows(back.after) == rows(observed)
    assert journal.tally(back.steps).first().done == 4
    strict = carry.undo_snapshot(done.steps, done.after, strict_parity=True)
    assert strict.after.where("path = '/new'").count() == 1


def test_a_created_folder_in_use_is_left(frame):
    done = run(frame, frame([entry("/a", 1)]), make("/new"), move(1, "/a", "/b"))
    used = done.after.unionByName(frame([entry("/new/mine", 9)]))
    back = carry.undo_snapshot(done.steps, used)
    assert rows(back.after, "path") == [("/a",), ("/new",), ("/new/mine",)]


def test_nothing_is_written_over(frame):
    observed = frame([entry("/a", 1), entry("/b", 2), entry("/c", 3)])
    steps = progress(run(frame, observed, move(1, "/a", "/z"), move(2, "/b", "/z"), move(3, "/c", "/b")).steps)
    assert steps == {0: ("done", None), 1: ("skipped", "destination_occupied"), 2: ("skipped", "destination_occupied")}
    done = run(frame, observed, move(1, "/a", "/z"))
    again = done.after.unionByName(frame([entry("/a", 9)]))
    assert progress(carry.undo_snapshot(done.steps, again).steps) == {0: ("skipped", "destination_occupied")}


def test_changed_content_is_skipped_at_the_last_moment(frame, contents):
    observed = frame([entry("/a", 1), entry("/b", 2)])
    steps = run(
        frame, observed, quarantine(1, "/a", sha("old")), quarantine(2, "/b"),
        content=contents([(1, "new"), (2, "any")]),
    ).steps
    assert progress(steps) == {0: ("skipped", "source_changed"), 1: ("done", None)}


def test_nothing_to_carry_out_is_refused(frame):
    with pytest.raises(ValueError):
        carry.apply_snapshot(frame([], schema.OPERATION), frame([entry("/a", 1)]), "/q")
    with pytest.raises(ValueError):
        carry.undo_snapshot(frame([], schema.STEP), frame([entry("/a", 1)]))


def one_by_one(paths, moves):
    """The plain way: every move in turn on a set of paths."""
    now, out = dict(paths), {}
    for seq, e, source, place, is_dir in moves:
        holder = next((k for k, p in now.items() if p == source), None)
        if holder is None:
            out[seq] = ("skipped", "source_missing")
        elif place in now.values():
            out[seq] = ("skipped", "destination_occupied")
        else:
            for k, p in list(now.items()):
                if p == source:
                    now[k] = place
                elif is_dir and p.startswith(source + "/"):
                    now[k] = place + p[len(source):]
            out[seq] = ("done", None)
    return now, out


@pytest.mark.parametrize("seed", range(8))
def test_carrying_out_equals_the_plain_way(frame, seed):
    dice = random.Random(seed)
    listed = [(0, "/r", True), (1, "/r/a", True), (2, "/r/b", True), (3, "/r/a/c", True)]
    for i in range(4, 14):
        listed.append((i, f"{dice.choice(['/r', '/r/a', '/r/b', '/r/a/c'])}/f{i}", False))
    subjects = dice.sample(listed[1:], 9)
    free = ["/r/n1", "/r/n2", "/r/b/n3", "/r/a/f9"]
    items = []
    for e, path, is_dir in subjects:
        place = dice.choice([*free, dice.choice(subjects)[1]])
        if place != path and not place.startswith(path + "/"):
            items.append(move(e, path, place, None, is_dir))
    # A path that only comes to hold a file during the run is no plan's subject.
    observed = frame([(folder if d else entry)(p, i) for i, p, d in listed])
    plain = [(i, e, s, p, d) for i, (_, e, s, p, _, d) in enumerate(items)]
    now, out = one_by_one({i: p for i, p, _ in listed}, plain)
    done = run(frame, observed, *items)
    assert progress(done.steps) == out
    assert {r.entry_id: r.path for r in done.after.collect()} == now
