from __future__ import annotations

from filelens import schema
from filelens.operators import summaries, survey
from tests.conftest import entry, folder, rows


def test_totals_split_here_and_in_the_cloud(frame):
    e = frame([
        entry("/a", 0, 10, allocated=4096), entry("/b", 1, 500, allocated=0, residency="remote"),
        entry("/c", 2, 7, allocated=None, residency="unknown"), folder("/d", 3),
        entry("/p", 4, 9, allocated=0, residency="partial"), entry("/z", 5, 0),
    ])
    assert tuple(survey.survey(e).totals.first()) == (5, 4612, 3, 4103, 2, 509)


def test_one_deep_file_names_only_its_own_folder(frame):
    found = survey.survey(frame([entry("/a/b/c/f", 0, 100)])).folders
    assert rows(found, "folder") == [("/a/b/c",)]


def test_a_parent_explained_by_its_child_is_dropped(frame):
    e = frame([entry("/h/one/a", 0, 107_000), entry("/h/b", 1, 1_700)])
    weights = survey.folders(survey.weighted(e))
    assert rows(survey.worth_showing(weights), "folder") == [("/h/one",)]


def test_a_parent_of_two_equal_children_is_kept(frame):
    e = frame([entry("/h/one/a", 0, 100), entry("/h/two/a", 1, 100)])
    top = survey.survey(e).folders
    assert [r.folder for r in top.collect()] == ["/h", "/h/one", "/h/two"]


def test_huge_folders_do_not_overflow(frame):
    e = frame([entry("/h/one/a", 0, 2**62), entry("/h/b", 1, 1)])
    weights = survey.folders(survey.weighted(e))
    assert weights.where("folder = '/h'").first().bytes == 2**62 + 1
    assert survey.worth_showing(weights).count() >= 0


def test_kinds_tie_by_declaration_order(frame):
    e = frame([entry("/a.mp3", 0, 5), entry("/a.png", 1, 5), entry("/a.zip", 2, 9)])
    assert [r.category for r in survey.survey(e).kinds.collect()] == ["archives", "images", "audio"]


def test_folder_counts_add_up_however_they_are_partitioned(frame):
    made = [entry(f"/h/{i % 7}/{i % 3}/f{i}", i, i) for i in range(200)]
    one = survey.folders(survey.weighted(frame(made)))
    two = survey.folders(survey.weighted(frame(made).repartition(9)))
    assert rows(one) == rows(two)
    assert one.where("folder = '/'").first().bytes == sum(range(200))


def test_reclaimable_counts_shared_bytes_once_by_first_name(frame):
    e = frame([
        entry("/b", 1, file_id=(1, 5), allocated=8), entry("/a", 0, file_id=(1, 5), allocated=3),
        entry("/c", 2, allocated=None), entry("/d", 3, allocated=4), folder("/e", 4),
    ])
    assert summaries.reclaimable(e).first()[0] == 7


def test_cloud_is_counted_differently_by_each_report(frame):
    e = frame([
        entry("/a", 0, 1, residency="remote"), entry("/b", 1, 1, residency="partial"),
        entry("/c", 2, 1, residency="unknown"), folder("/d", 3, residency="remote"),
    ])
    assert summaries.scan_summary(e).first().not_downloaded == 2
    assert summaries.window_summary(e).first().in_cloud == 2
    assert survey.survey(e).totals.first().cloud_files == 2


def test_every_unread_reason_is_listed(frame):
    places = [("mac", f"/{r}{i}", r, "why") for r in schema.UNREAD_REASONS for i in range(5)]
    unread = frame(places, schema.UNREAD)
    assert rows(summaries.unread_by_reason(unread), "reason", "places") == [
        (r, 5) for r in sorted(schema.UNREAD_REASONS)
    ]
    assert summaries.unread_samples(unread).count() == 12
    assert not summaries.is_complete(unread)
    assert summaries.unread_list(unread, 7).count() == 7
