from __future__ import annotations

import shutil
import tempfile

import pytest

from filelens import schema
from filelens.operators import compare, duplicates, ownership
from tests.conftest import entry, folder, rows, sha


def recorded(frame, label, items):
    """A machine's thorough analysis from (path, text) items."""
    e = frame([entry(p, i, len(t), machine=label) for i, (p, t) in enumerate(items)])
    marks = frame([(label, i, "content", sha(t)) for i, (_, t) in enumerate(items)], schema.SETTLED)
    return compare.Recorded(label, e, marks)


def test_one_shared_file_and_one_of_its_own_each(frame):
    merged, found = compare.comparison([
        recorded(frame, "mac", [("/a", "shared bytes ok"), ("/b", "only mac")]),
        recorded(frame, "pc", [("/c", "shared bytes ok"), ("/d", "only on pc")]),
    ])
    assert tuple(compare.shared(found.groups, found.members).first()) == (1, 15, 0)
    assert rows(compare.exclusive(merged.settled), "machine", "files") == [("mac", 1), ("pc", 1)]
    assert rows(compare.exclusive_entries(merged.settled), "entry_id") == [(1,), (3,)]
    assert rows(compare.machines_among(found.members), "machines") == [(["mac", "pc"],)]
    assert rows(merged.source, "label", "first_entry", "entry_count") == [("mac", 0, 2), ("pc", 2, 2)]
    assert rows(compare.source_of(merged.entries.select("entry_id"), merged.source)) == [
        (0, "mac"), (1, "mac"), (2, "pc"), (3, "pc")
    ]


def test_a_hard_link_makes_a_machine_look_partial(frame):
    e = frame([entry("/a", 0, file_id=(1, 1)), entry("/b", 1, file_id=(1, 1))])
    marks = frame([("mac", 0, "sample", sha("x"))], schema.SETTLED)
    assert tuple(compare.coverage(e, marks).first()) == ("mac", 2, 1, 1, 1, True)


def test_a_duplicate_on_one_machine_only_is_still_exclusive(frame):
    merged = compare.merge([
        recorded(frame, "mac", [("/a", "x"), ("/b", "x")]), recorded(frame, "pc", [("/c", "y")])
    ])
    assert rows(compare.exclusive(merged.settled)) == [("mac", 2), ("pc", 1)]


def test_what_a_comparison_refuses(frame):
    one = recorded(frame, "mac", [("/a", "x")])
    with pytest.raises(ValueError):
        compare.merge([one])
    with pytest.raises(ValueError):
        compare.merge([one, one])
    again = recorded(frame, "pc", [("/a", "x")])
    again.merged = True
    with pytest.raises(ValueError):
        compare.merge([one, again])


def test_unread_sizes_meeting_across_machines_are_refused_candidates(frame):
    a = recorded(frame, "mac", [("/a", "0123456789")])
    b = recorded(frame, "pc", [("/b", "0123456789")])
    b.settled = frame([], schema.SETTLED)
    _, found = compare.comparison([a, b])
    group = found.groups.first()
    assert group.certainty == "candidate" and group.settled_of_same_size == 1
    assert [tuple(u) for u in group.unsettled] == [("refused", 1, 0)]
    assert duplicates.findings(found.groups).first().to_settle == 0


def test_two_scans_differ_by_path(frame):
    before = frame([entry("/a", 0), entry("/b", 1), entry("/c", 2), entry("/c", 3)])
    after = frame([entry("/a", 7), entry("/b", 1, 11), entry("/d", 2)])
    assert rows(compare.inventory_diff(before, after), "path", "change") == [
        ("/b", "changed"), ("/c", "removed"), ("/d", "added")
    ]


ROOTS = [
    ("mac", "/iCloud", "icloud", None, "provider_mount"),
    ("mac", "/iCloud/App", "icloud", "App", "app_container"),
    ("mac", "/Drive", "google_drive", "me", "provider_mount"),
]


@pytest.mark.parametrize("in_place", [64, 0])
def test_the_longest_root_owns(frame, in_place):
    e = frame([
        entry("/iCloud/App/f", 0), entry("/iCloud/f", 1), entry("/iCloudX/f", 2), folder("/Drive", 3),
        entry("/iCloud/App/f", 4, machine="pc"), folder("/", 5),
    ])
    owned = ownership.owner_of(e, frame(ROOTS, schema.CLOUD_ROOT), in_place)
    assert rows(owned, "entry_id", "root_path", "account") == [
        (0, "/iCloud/App", "App"), (1, "/iCloud", None), (2, None, None), (3, "/Drive", "me"),
        (4, None, None), (5, None, None),
    ]


def test_links_lead_out_or_are_plumbing(frame):
    roots = frame(ROOTS, schema.CLOUD_ROOT)
    e = frame([
        entry("/Drive/in", 0, kind="symlink", target="/iCloud/x"),
        entry("/Drive/out", 1, kind="symlink", target="/Volumes/a"),
        entry("/Drive/own", 2, kind="symlink", target="/Volumes/b"),
        entry("/Drive/no", 3, kind="symlink", target="/Volumes/b"),
        entry("/Drive/rel", 4, kind="symlink", target="sub/x"),
        entry("/Drive/sub/deep", 5, kind="symlink", target="/Volumes/a"),
        folder("/Volumes/b/.tmp.drivedownload", 6),
    ])
    links = ownership.outward_links(e, roots)
    ignored = frame([("mac", "/Drive/no", "", "", "")], schema.CLOUD_LINK)
    found = ownership.link_verdicts(links, e, ignored)
    assert rows(found, "link", "verdict") == [
        ("/Drive/no", "excluded_by_provider"), ("/Drive/out", "unsettled"), ("/Drive/own", "provider_owned")
    ]
    assert tuple(ownership.provider_report(roots, found).first()) == ("mac", 3, 1, 1, 1)


def test_roots_are_recognised_in_a_home(spark, frame):
    h = "/Users/me"
    e = frame([
        folder(f"{h}/Library/Mobile Documents/com~apple~CloudDocs", 0),
        folder(f"{h}/Library/Mobile Documents/.Trash", 1),
        folder(f"{h}/Library/Mobile Documents/iCloud~pages", 2),
        folder(f"{h}/Library/CloudStorage/GoogleDrive-me@x-y.com", 3), folder(f"{h}/Dropbox", 4),
        entry(f"{h}/OneDrive", 5, kind="symlink", target=f"{h}/Library/CloudStorage/OneDrive"),
        entry(f"{h}/Desktop", 6, kind="symlink", target=f"{h}/Library/Mobile Documents/com~apple~CloudDocs/Desktop"),
        entry(f"{h}/Documents", 7, kind="symlink", target="/elsewhere"),
    ])
    homes = spark.createDataFrame([("mac", h)], "machine string, home string")
    got = rows(ownership.mac_roots(e, homes), "origin", "provider", "account")
    assert got == [
        ("app_container", "icloud", "iCloud~pages"), ("home_redirect", "icloud", "Desktop"),
        ("legacy_location", "dropbox", None), ("provider_mount", "google_drive", "me@x-y.com"),
        ("provider_mount", "icloud", None), ("provider_trash", "icloud", None),
    ]


def test_published_folders_count_once(spark, frame):
    e = frame([folder("/U/OneDrive", 0), folder("/U/Work", 1), folder("/U/Dropbox", 2)])
    homes = spark.createDataFrame([("mac", "/U")], "machine string, home string")
    variables = spark.createDataFrame(
        [("mac", "OneDrive", "/U/OneDrive"), ("mac", "OneDriveConsumer", "/U/OneDrive"),
         ("mac", "OneDriveCommercial", "/gone")],
        "machine string, variable string, value string",
    )
    assert rows(ownership.windows_roots(e, homes, variables), "path", "account") == [
        ("/U/Dropbox", None), ("/U/OneDrive", "personal")
    ]


def test_stored_analyses_merge_in_one_scan_whatever_their_number(spark, frame):
    place = tempfile.mkdtemp(prefix="spark-")
    e = frame([entry("/a", 0), entry("/b", 1), entry("/c", 7)])
    e.coalesce(1).write.parquet(f"{place}/m0/entries")
    spark.createDataFrame([("mac", 1, "content", "f")], schema.SETTLED).coalesce(1).write.parquet(f"{place}/m0/settled")
    for n in range(1, 120):
        shutil.copytree(f"{place}/m0", f"{place}/m{n}")
    folders = {f"machine{n}": f"{place}/m{n}" for n in range(120)}
    merged = compare.merge_stored(spark, folders)
    assert rows(merged.source, "label", "first_entry", "entry_count")[:2] == [("machine0", 0, 3), ("machine1", 8, 3)]
    labelled = compare.source_of(merged.entries, merged.source).where("machine = label")
    assert labelled.count() == 360 == merged.entries.select("entry_id").distinct().count()
    assert rows(merged.settled.where("machine = 'machine5'"), "entry_id") == [(41,)]
    plan = lambda m: m.entries._jdf.queryExecution().executedPlan().toString().count("Scan parquet")
    few = compare.merge_stored(spark, dict(list(folders.items())[:2]))
    assert plan(few) == plan(merged)
    outside = spark.createDataFrame([(-1,), (120 * 8,), (2,), (7,)], "entry_id long")
    assert {r.entry_id: r.label for r in compare.source_of(outside, merged.source).collect()} == {-1: None, 960: None, 2: "machine0", 7: "machine0"}
