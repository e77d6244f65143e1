from __future__ import annotations

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from filelens import schema
from filelens.operators import duplicates, scale
from tests.conftest import entry, folder, rows, sha


def exact(analysis):
    return rows(analysis.groups.where("certainty = 'exact'"), "logical_size", "objects", "reclaimable_bytes")


def test_same_bytes_group_and_a_size_collision_does_not(frame, contents):
    e = frame([entry("/a", 0), entry("/b", 1), entry("/c", 2)])
    found = duplicates.analyze(e, contents([(0, "x" * 10), (1, "x" * 10), (2, "y" * 10)]))
    assert exact(found) == [(10, 2, 10)]
    assert rows(found.members, "entry_id", "object_id") == [(0, 0), (1, 1)]


def test_hard_links_are_one_object(frame, contents):
    e = frame([
        entry("/a", 0, file_id=(1, 5)), entry("/b", 1, file_id=(1, 5)), entry("/c", 2, file_id=(1, 6))
    ])
    text = "x" * 10
    found = duplicates.analyze(e, contents([(0, text), (1, text), (2, text)]))
    assert exact(found) == [(10, 2, 10)]
    assert rows(found.members, "object_id", "entry_id", "first_name") == [(0, 0, 0), (0, 1, 0), (1, 2, 2)]
    only = frame([entry("/a", 0, file_id=(1, 5)), entry("/b", 1, file_id=(1, 5))])
    assert duplicates.analyze(only, contents([(0, text), (1, text)])).groups.count() == 0


def test_equal_file_ids_on_two_machines_stay_apart(frame):
    e = frame([entry("/a", 0, file_id=(1, 5)), entry("/a", 1, file_id=(1, 5), machine="pc")])
    assert duplicates.storage_objects(e).count() == 2


def test_the_first_name_gives_size_and_allocation(frame):
    e = frame([
        entry("/b", 1, 20, file_id=(1, 5), allocated=None), entry("/a", 0, 10, file_id=(1, 5), allocated=7)
    ])
    assert rows(duplicates.storage_objects(e), "first_name", "names", "logical_size", "allocated_size") == [
        (0, 2, 10, 7)
    ]


def test_empty_files_folders_and_links_never_group(frame):
    e = frame([
        entry("/a", 0, 0), entry("/b", 1, 0), folder("/d", 2), entry("/l", 3, kind="symlink"),
        entry("/m", 4, kind="symlink"),
    ])
    assert duplicates.storage_objects(e).count() == 0


def test_a_cloud_twin_makes_a_candidate_and_is_never_read(frame, contents):
    e = frame([entry("/a", 0), entry("/b", 1, residency="remote"), entry("/c", 2, residency="unknown")])
    assert rows(duplicates.candidates(e), "entry_id") == [(0,)]
    found = duplicates.analyze(e, contents([(0, "x" * 10)]))
    group = found.groups.first()
    assert (group.certainty, group.objects, group.settled_of_same_size) == ("candidate", 2, 1)
    assert group.reclaimable_bytes == 0
    assert [tuple(u) for u in group.unsettled] == [("would_require_download", 2, 20)]
    assert duplicates.findings(found.groups).first().to_settle == 20


def test_a_lone_cloud_file_gives_no_group(frame, contents):
    e = frame([entry("/a", 0), entry("/b", 1, 11, residency="remote")])
    assert duplicates.analyze(e, contents([(0, "x")])).groups.count() == 0


def test_missing_allocation_frees_nothing(frame, contents):
    e = frame([entry("/a", 0, allocated=None), entry("/b", 1, allocated=None), entry("/c", 2, allocated=9)])
    found = duplicates.analyze(e, contents((i, "x" * 10) for i in range(3)))
    assert exact(found) == [(10, 3, 9)]


def test_only_agreeing_ends_are_read_whole(frame, contents):
    texts = ["aaaa" + m * 20 + "bbbb" for m in "xyx"] + ["cccc" + "x" * 20 + "dddd"]
    e = frame([entry(f"/{i}", i, 28) for i in range(4)])
    marks = duplicates.settle(e, contents(enumerate(texts)), end_bytes=4)
    assert rows(marks, "entry_id", "kind") == [(0, "content"), (1, "content"), (2, "content"), (3, "sample")]
    found = duplicates.analysis_of(e, marks)
    assert rows(found.groups, "certainty", "objects", "digest") == [("exact", 2, sha(texts[0]))]
    all_of_it = duplicates.settle(e, contents(enumerate(texts)), end_bytes=4, confirm_all=True)
    assert rows(all_of_it, "kind") == [("content",)] * 4


def test_digesting_is_the_same_when_the_list_is_too_long_to_broadcast(frame, contents):
    content = contents((i, str(i)) for i in range(20))
    wanted = frame([entry(f"/{i}", i) for i in range(0, 20, 3)]).select("entry_id")
    digest = F.sha2("content", 256)
    assert rows(duplicates.digest_entries(content, wanted, digest)) == rows(
        duplicates.digest_entries(content, wanted, digest, limit=2)
    )


def test_nothing_unwanted_is_digested_at_any_size(spark, contents):
    seen = spark.sparkContext.accumulator(0)

    def mark(text):
        seen.add(1)
        return text

    content = contents((i, str(i)) for i in range(50))
    wanted = spark.range(0, 50, 10).withColumnRenamed("id", "entry_id")
    for limit in (100, 0):
        before = seen.value
        assert duplicates.digest_entries(content, wanted, F.udf(mark)("content"), limit).count() == 5
        duplicates.digest_entries(content, wanted, F.udf(mark)("content"), limit).collect()
        assert seen.value - before == 5


def test_groups_are_numbered_by_size_then_digest_candidates_last(frame, contents):
    e = frame(
        [entry(f"/{i}", i, 5) for i in range(5)] + [entry(f"/b{i}", 10 + i, 3) for i in range(2)]
        + [entry("/r", 20, 5, residency="remote")]
    )
    found = duplicates.analyze(
        e, contents([(0, "p" * 5), (1, "q" * 5), (2, "p" * 5), (3, "q" * 5), (4, "z" * 5), (10, "aaa"), (11, "aaa")])
    )
    small, large = sha("aaa"), sorted([sha("p" * 5), sha("q" * 5)])
    assert rows(found.groups, "group_id", "digest") == [(0, small), (1, large[0]), (2, large[1]), (3, None)]


def test_the_later_of_equal_findings_is_the_largest(frame, contents):
    e = frame([entry(f"/{i}", i, 5) for i in range(4)])
    found = duplicates.analyze(e, contents([(0, "p" * 5), (1, "p" * 5), (2, "q" * 5), (3, "q" * 5)]))
    shown = duplicates.largest_finding(found.groups, duplicates.group_copies(e, found.members))
    assert {r.group_id for r in shown.collect()} == {1}


def test_a_group_holding_most_rows_is_sliced(frame, contents, monkeypatch):
    monkeypatch.setattr(scale, "slices_for", lambda frame: 4)
    e = frame([entry(f"/{i}", i, 5, file_id=(1, i // 3)) for i in range(60)])
    texts = [(i, "hot!!" if i < 45 else f"{i // 3:05d}") for i in range(60)]
    found = duplicates.analyze(e, contents(texts))
    assert exact(found) == [(5, 15, 70)]
    assert rows(found.members, "entry_id", "object_id") == [(i, i // 3) for i in range(45)]


ENTRIES = st.lists(
    st.tuples(
        st.sampled_from(["local", "remote", "unknown", "not_synced"]),
        st.sampled_from(["aa", "ab", "ccc", "ddd", ""]),
        st.one_of(st.none(), st.integers(0, 3)),
        st.sampled_from(["mac", "pc"]),
    ),
    max_size=12,
)


def brute_force(listed):
    objects, where = [], {}
    for i, (residency, text, index, machine) in enumerate(listed):
        if not text:
            continue
        if index is not None and (machine, index) in where:
            where[machine, index]["names"].append(i)
            continue
        o = {"names": [i], "size": len(text), "residency": residency, "text": text}
        objects.append(o)
        if index is not None:
            where[machine, index] = o
    sizes = defaultdict(list)
    for o in objects:
        sizes[o["size"]].append(o)
    out = []
    for size, bucket in sizes.items():
        if len(bucket) < 2:
            continue
        by_text, unread = defaultdict(list), []
        for o in bucket:
            if o["residency"] in ("remote", "unknown"):
                unread.append(o)
            else:
                by_text[o["text"]].append(o)
        out += [(size, "exact", len(v), sum(len(o["names"]) for o in v)) for v in by_text.values() if len(v) > 1]
        if unread:
            out.append((size, "candidate", len(unread), sum(len(o["names"]) for o in unread)))
    return sorted(out)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(ENTRIES)
def test_groups_equal_brute_force(spark, listed):
    e = spark.createDataFrame(
        [
            entry(f"/{i}", i, len(t), residency=r, machine=m, file_id=None if x is None else (1, x))
            for i, (r, t, x, m) in enumerate(listed)
        ],
        schema.ENTRY,
    )
    content = spark.createDataFrame(
        [(i, t) for i, (_, t, _, _) in enumerate(listed)], "entry_id long, content string"
    )
    marks = duplicates.settle(e, content)
    groups, _ = duplicates.group_tables(e, marks)
    got = groups.select(
        "logical_size", F.when(F.col("tier") == 0, "exact").otherwise("candidate"), "objects", "names"
    )
    assert sorted(tuple(r) for r in got.collect()) == brute_force(listed)


def test_input_partitioning_does_not_change_the_answer(frame, contents):
    made = [entry(f"/{i}", i, 5, modified=i) for i in range(120)]
    content = contents((i, f"{i % 40:05d}") for i in range(120))
    one = duplicates.analyze(frame(made), content)
    two = duplicates.analyze(frame(made).repartition(7, "path"), content.repartition(3))
    assert rows(one.groups, "group_id", "digest", "objects") == rows(two.groups, "group_id", "digest", "objects")
    assert one.groups.count() == 40


def test_a_pass_reports_its_progress(frame, contents):
    seen = Observation("sampling")
    e = frame([entry("/a", 0), entry("/b", 1), entry("/c", 2, 99)])
    duplicates.settle(e, contents((i, "x" * 10) for i in range(3)), progress=seen)
    assert seen.get == {"files": 2, "bytes": 20}


def test_unknown_depth_is_refused(frame):
    with pytest.raises(ValueError):
        duplicates.candidates(frame([entry("/a", 0)]), "deep")
