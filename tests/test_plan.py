from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from filelens import schema
from filelens.operators import duplicates
from filelens.plans import plan
from tests.conftest import entry, rows, sha

TEXT = "x" * 10


@pytest.fixture(scope="module")
def pair(frame, contents):
    """Three copies: deep and old, shallow and new, undated; one with two names."""
    e = frame([
        entry("/D/old/copy/t.pdf", 0, modified=100),
        entry("/D/t.pdf", 1, modified=900, file_id=(1, 7)),
        entry("/D/z/t.pdf", 2, modified=900, file_id=(1, 7), allocated=10),
        entry("/D/b/t.pdf", 3, modified=None),
    ])
    return e, duplicates.analyze(e, contents((i, TEXT) for i in range(4)))


def kept(pair, rule, under=None):
    return [r.kept for r in plan.kept(*pair, rule, under).collect()]


def test_each_rule_keeps_its_own(pair):
    assert kept(pair, "oldest") == ["/D/old/copy/t.pdf"]
    assert kept(pair, "shallowest") == ["/D/t.pdf"]
    assert kept(pair, "under", "/D/old") == ["/D/old/copy/t.pdf"]
    assert kept(pair, "under", "/D/ol") == ["/D/t.pdf"]


def test_newest_keeps_what_has_no_date(pair):
    assert kept(pair, "newest") == ["/D/b/t.pdf"]


def test_ties_break_by_component_order(frame, contents):
    e = frame([entry("/a-b", 0), entry("/a/b", 1), entry("/c", 2)])
    found = duplicates.analyze(e, contents((i, TEXT) for i in range(3)))
    assert kept((e, found), "oldest") == ["/a/b"]


def test_every_name_of_a_redundant_object_is_set_aside(pair):
    operations = plan.resolve(*pair, "oldest")
    assert rows(operations, "entry_id", "content", "frees_bytes") == [
        (1, sha(TEXT), 10), (2, sha(TEXT), 10), (3, sha(TEXT), 10)
    ]
    total = plan.effect(operations, pair[1].members).first()
    assert (total.quarantined, total.frees_bytes, total.frees_bytes_distinct) == (3, 30, 20)


def test_reclaimable_skips_the_first_listed_not_the_kept(frame, contents):
    e = frame([entry("/a", 0, modified=9, allocated=1), entry("/b", 1, modified=1, allocated=5)])
    found = duplicates.analyze(e, contents((i, TEXT) for i in range(2)))
    assert found.groups.first().reclaimable_bytes == 5
    assert plan.effect(plan.resolve(e, found, "oldest")).first().frees_bytes == 1


def test_candidates_are_left_alone(frame, contents):
    e = frame([entry("/a", 0), entry("/b", 1, residency="remote")])
    found = duplicates.analyze(e, contents([(0, TEXT)]))
    assert plan.resolve(e, found, "oldest").count() == 0


def operations(frame, *items):
    """(kind, entry_id, subject, destination) rows."""
    out = [
        (i, kind, "mac", e, subject, place, None, 10, 1000, "requested", None, 0, False)
        for i, (kind, e, subject, place) in enumerate(items)
    ]
    return frame(out, schema.OPERATION)


def test_what_was_asked_for_wins(frame):
    asked = operations(frame, ("create_directory", None, None, "/n"), ("move", 1, "/a", "/n/a"))
    ruled = operations(
        frame, ("quarantine", 1, "/a", None), ("quarantine", 2, "/b", None),
        ("create_directory", None, None, "/n"), ("create_directory", None, None, "/m"),
        ("create_directory", None, None, "/m"),
    )
    both = plan.combine(ruled, asked)
    assert rows(both.where("entry_id is not null"), "kind", "entry_id") == [
        ("move", 1), ("quarantine", 2)
    ]
    assert sorted(r.destination for r in both.where("kind = 'create_directory'").collect()) == ["/m", "/n"]


def test_ids_of_other_machines_are_other_entries(frame):
    asked = operations(frame, ("move", 5, "/a", "/n"))
    ruled = operations(frame, ("quarantine", 5, "/a", None), ("quarantine", 6, "/b", None))
    elsewhere = ruled.withColumn("machine", F.lit("pc"))
    both = plan.combine(ruled.unionByName(elsewhere), asked)
    assert rows(both, "machine", "kind", "entry_id") == [
        ("mac", "move", 5), ("mac", "quarantine", 6), ("pc", "quarantine", 5), ("pc", "quarantine", 6)
    ]


def test_folders_then_moves_then_quarantines_by_path(frame):
    made = plan.ordered(operations(
        frame, ("quarantine", 1, "/a", None), ("move", 2, "/z", "/b-c/x"), ("move", 3, "/y", "/b/x"),
        ("create_directory", None, None, "/n/m"), ("create_directory", None, None, "/n"),
    ))
    got = [r[0] for r in made.orderBy("position").select(F.coalesce("destination", "subject_path")).collect()]
    assert got == ["/n", "/n/m", "/b/x", "/b-c/x", "/a"]
    assert rows(made, "position") == [(i,) for i in range(5)]


def test_conflicts_are_double_claims_and_taken_places(frame):
    e = frame([entry("/a", 0), entry("/b", 1), entry("/c", 2), entry("/d", 3)])
    asked = operations(
        frame, ("move", 0, "/a", "/b"), ("move", 1, "/b", "/e"), ("move", 2, "/c", "/d"),
        ("move", 5, "/p", "/q"), ("move", 6, "/r", "/q"),
    )
    assert rows(plan.conflicts(e, asked), "destination", "claimants", "occupied_by") == [
        ("/d", 1, 3), ("/q", 2, None)
    ]
    assert rows(plan.conflict_claims(e, asked), "position") == [(2,), (3,), (4,)]


def test_a_comparison_is_planned_nowhere(pair):
    with pytest.raises(ValueError):
        plan.plan(*pair, merged=True)
    with pytest.raises(ValueError):
        plan.plan(*pair, rule=None)
    with pytest.raises(ValueError):
        plan.keep_key("under")


def test_the_same_intent_gives_the_same_plan(pair):
    e, found = pair
    again = duplicates.Analysis(found.settled, found.groups.repartition(3), found.members.repartition(5))
    one, two = plan.plan(e, found, "oldest"), plan.plan(e.repartition(4), again, "oldest")
    assert rows(one, "position", "entry_id", "kept") == rows(two, "position", "entry_id", "kept")
