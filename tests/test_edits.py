from __future__ import annotations

import random

import pytest

from filelens import schema
from filelens.operators import ownership
from filelens.plans import edits
from tests.conftest import entry, folder, rows

HOME = "/Users/me"


@pytest.fixture(scope="module")
def small(frame):
    return frame([
        folder(f"{HOME}/Documents", 0), entry(f"{HOME}/Documents/tax.pdf", 1),
        folder(f"{HOME}/Documents/old", 2), entry(f"{HOME}/Documents/old/tax.pdf", 3),
        folder(f"{HOME}/Desktop", 4), entry(f"{HOME}/Desktop/notes.txt", 5),
    ])


def log(frame, *steps, machine="mac"):
    """(kind, entry_id, path, name) steps."""
    return frame([(machine, i, *s) for i, s in enumerate(steps)], schema.EDIT)


def rename(e, name):
    return ("rename", e, None, name)


def relocate(e, into):
    return ("relocate", e, into, None)


def make(path):
    return ("new_directory", None, path, None)


def aside(e):
    return ("set_aside", e, None, None)


def outcome(small, steps):
    found = edits.replay(small, steps)
    now = {r.entry_id: r.now_path for r in edits.arranged(small, found).collect()}
    refused = {r.position: r.reason for r in found.refusals.collect()}
    return now, refused, found


def test_renaming_a_folder_carries_what_is_inside(frame, small):
    now, refused, found = outcome(small, log(frame, rename(0, "Papers")))
    assert now[3] == f"{HOME}/Papers/old/tax.pdf" and not refused
    assert rows(edits.changes(small, found), "entry_id", "carried") == [
        (0, False), (1, True), (2, True), (3, True)
    ]


def test_one_operation_per_change_never_per_carried_file(frame, small):
    _, _, found = outcome(small, log(frame, rename(0, "Papers")))
    none = frame([], schema.SETTLED)
    assert rows(edits.edit_operations(small, found, none), "kind", "entry_id", "destination") == [
        ("move", 0, f"{HOME}/Papers")
    ]


def test_renaming_twice_is_one_move(frame, small):
    _, _, found = outcome(small, log(frame, rename(1, "a.pdf"), rename(1, "b.pdf")))
    operations = edits.edit_operations(small, found, frame([], schema.SETTLED))
    assert rows(operations, "subject_path", "destination") == [
        (f"{HOME}/Documents/tax.pdf", f"{HOME}/Documents/b.pdf")
    ]


def test_every_refusal(frame, small):
    _, refused, _ = outcome(small, log(
        frame, rename(99, "x"), rename(1, "a/b"), rename(1, " "), rename(1, "old"),
        relocate(0, f"{HOME}/Documents/old"), relocate(1, f"{HOME}/nowhere"),
        relocate(1, f"{HOME}/Desktop/notes.txt"), relocate(1, "Desktop"), aside(0), aside(5),
        aside(5), rename(5, "z"), make("x"), make(f"{HOME}/Desktop"), make("/"),
    ))
    assert refused == {
        0: "no_such_entry", 1: "not_a_name", 2: "not_a_name", 3: "occupied", 4: "into_itself",
        5: "not_a_directory", 6: "not_a_directory", 7: "not_absolute",
        8: "folders_are_not_set_aside", 10: "already_aside", 11: "already_aside",
        12: "not_absolute", 13: "occupied", 14: "not_a_name",
    }


def test_a_vacated_name_is_free_and_a_new_folder_can_be_filled(frame, small):
    now, refused, found = outcome(small, log(
        frame, rename(1, "kept.pdf"), relocate(3, f"{HOME}/Documents"), make(f"{HOME}/New"),
        relocate(5, f"{HOME}/New"), rename(4, "Desk"),
    ))
    assert not refused
    assert now[3] == f"{HOME}/Documents/tax.pdf" and now[5] == f"{HOME}/New/notes.txt"
    assert rows(found.new_directories, "path") == [(f"{HOME}/New",)]


def test_asking_for_the_name_it_has_changes_nothing(frame, small):
    now, refused, found = outcome(small, log(frame, rename(1, "tax.pdf")))
    assert not refused and edits.changes(small, found).count() == 0
    assert edits.edit_operations(small, found, frame([], schema.SETTLED)).count() == 0


def test_a_new_folder_moves_with_the_folder_above_it(frame, small):
    _, _, found = outcome(small, log(frame, make(f"{HOME}/Desktop/in"), rename(4, "Desk")))
    assert rows(found.new_directories, "path") == [(f"{HOME}/Desk/in",)]


def test_a_folder_moved_twice_leaves_nobody_behind(frame, small):
    now, refused, _ = outcome(small, log(
        frame, rename(2, "mid"), rename(2, "end"), make(f"{HOME}/Documents/mid"),
        relocate(5, f"{HOME}/Documents/mid"),
    ))
    assert not refused and now[3] == f"{HOME}/Documents/end/tax.pdf"


def test_taking_back_is_replaying_the_rest(frame, small):
    steps = [rename(0, "Papers"), rename(1, "a.pdf")]
    one = edits.arranged(small, edits.take_back_last(small, log(frame, *steps)))
    two = edits.arranged(small, edits.replay(small, log(frame, *steps[:1])))
    assert rows(one, "entry_id", "now_path") == rows(two, "entry_id", "now_path")


def test_browsing_shows_new_folders_first_then_folders_then_names(frame, small):
    _, _, found = outcome(small, log(frame, make(f"{HOME}/Zed"), rename(0, "Papers")))
    page, total = edits.browse(small, found, "mac", HOME, 0, 10)
    assert [r.name for r in page.collect()] == ["Zed", "Desktop", "Papers"]
    assert total.first().total == 3
    assert [r.name for r in edits.browse(small, found, "mac", HOME, 1, 2)[0].collect()] == ["Desktop", "Papers"]


def test_machines_do_not_share_a_log(frame, small):
    other = frame([folder("/x", 10, machine="pc"), entry("/x/f", 11, machine="pc")])
    both = small.unionByName(other)
    steps = log(frame, rename(0, "P")).unionByName(log(frame, rename(10, "y"), machine="pc"))
    now, refused, _ = outcome(both, steps)
    assert now[11] == "/y/f" and now[1] == f"{HOME}/P/tax.pdf" and not refused


class Whole:
    """The plain way: every entry's path, changed edit by edit."""

    def __init__(self, entries):
        self.path = {e: p for e, p, _ in entries}
        self.dirs = {e for e, _, d in entries if d}
        self.new, self.aside, self.refused = set(), set(), {}

    def at(self, path):
        if path in self.new:
            return "new"
        return next((e for e, p in self.path.items() if p == path), None)

    def put(self, e, there):
        here = self.path[e]
        if here == there:
            return None
        if there.startswith(here + "/"):
            return "into_itself"
        if self.at(there) is not None:
            return "occupied"
        if e in self.dirs:
            for o, p in list(self.path.items()):
                if p.startswith(here + "/"):
                    self.path[o] = there + p[len(here):]
            self.new = {there + p[len(here):] if p.startswith(here + "/") else p for p in self.new}
        self.path[e] = there
        return None

    def step(self, kind, e, path, name):
        if kind == "new_directory":
            if self.at(path) is not None:
                return "occupied"
            self.new.add(path)
            return None
        if e in self.aside:
            return "already_aside"
        if e not in self.path:
            return "no_such_entry"
        parent, _, own = self.path[e].rpartition("/")
        if kind == "set_aside":
            if e in self.dirs:
                return "folders_are_not_set_aside"
            del self.path[e]
            self.aside.add(e)
            return None
        if kind == "rename":
            return self.put(e, f"{parent}/{name}")
        holder = self.at(path)
        if holder != "new" and holder not in self.dirs:
            return "not_a_directory"
        return self.put(e, f"{path}/{own}")


@pytest.mark.parametrize("seed", range(6))
def test_replay_equals_the_plain_way(frame, seed):
    dice = random.Random(seed)
    names = ["a", "b", "c"]
    listed = [(0, "/r", True)]
    for _ in range(14):
        above = dice.choice([p for _, p, d in listed if d])
        path = f"{above}/{dice.choice(names)}"
        if all(p != path for _, p, _ in listed):
            listed.append((len(listed), path, dice.random() < 0.6))
    steps = []
    for _ in range(25):
        e = dice.randrange(len(listed) + 1)
        somewhere = f"{dice.choice(listed)[1]}/{dice.choice(names)}"
        steps.append(dice.choice([
            rename(e, dice.choice(names)), relocate(e, dice.choice([dice.choice(listed)[1], somewhere])),
            make(somewhere), aside(e),
        ]))
    whole = Whole(listed)
    for i, s in enumerate(steps):
        if why := whole.step(*s):
            whole.refused[i] = why
    e = frame([(folder if d else entry)(p, i) for i, p, d in listed])
    now, refused, found = outcome(e, log(frame, *steps))
    assert refused == whole.refused
    assert now == {i: whole.path.get(i) for i, _, _ in listed}
    assert {r.path for r in found.new_directories.collect()} == whole.new


def test_many_moved_folders_are_matched_by_join(frame, small, monkeypatch):
    steps = log(frame, rename(0, "P"), rename(2, "o"), rename(4, "D"))
    one = rows(edits.arranged(small, edits.replay(small, steps)), "entry_id", "now_path")
    monkeypatch.setattr(ownership.longest_root, "__defaults__", ("path", "owner", 0))
    assert rows(edits.arranged(small, edits.replay(small, steps)), "entry_id", "now_path") == one
