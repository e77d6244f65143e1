from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from filelens import schema
from filelens.functions import content as digests
from filelens.operators import duplicates
from filelens.plans import lineage
from filelens.sources import artifacts, inventory, journal, ndjson
from filelens.streaming import live_tally
from tests.conftest import entry, folder, rows, second, sha


@pytest.fixture
def place():
    return tempfile.mkdtemp(prefix="spark-")


@pytest.fixture(scope="module")
def shapes(frame):
    """Every shape of an entry, in one inventory."""
    e = frame([
        entry("/ü", 0, created=-158000000, file_id=(-1, -2)),
        entry("/cloud", 1, 8 * 10**9, allocated=0, residency="remote", provider="icloud"),
        entry("/link", 2, kind="symlink", target="/ü", modified=None), folder("/d", 3),
        tuple([*entry("/bad�", 4)[:3], b"/bad\xff", *entry("/bad�", 4)[4:]]),
    ])
    unread = frame([("mac", "/no", "other", "why")], schema.UNREAD)
    roots = frame([("mac", "/d", "icloud", None, "provider_mount")], schema.CLOUD_ROOT)
    links = frame([("mac", "/l", "/v", "icloud", "excluded_by_provider")], schema.CLOUD_LINK)
    return {"entries": e, "unread": unread, "roots": roots, "links": links}


def test_an_inventory_comes_back_as_it_was(spark, shapes, place):
    written = artifacts.write(spark, f"{place}/a", "scan", shapes, ["mac"])
    back = artifacts.read(spark, f"{place}/a", "inventory")
    assert back.digest == written.digest
    for name, table in shapes.items():
        assert rows(back.tables[name], *table.columns) == rows(table)
    assert back.is_executable_on("mac") and not back.is_executable_on("pc") and back.is_native("bytes")
    back.register("x_")
    assert spark.sql("SELECT count(*) FROM x_entries WHERE kind = 'file'").first()[0] == 3


def test_taken_names_changed_content_and_foreign_versions_are_refused(spark, shapes, place, frame):
    where = f"{place}/a"
    artifacts.write(spark, where, "scan", shapes, ["mac"])
    with pytest.raises(artifacts.ArtifactError):
        artifacts.write(spark, where, "scan", shapes, ["mac"])
    artifacts.write(spark, where, "scan", shapes, ["mac"], replace=True)
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read(spark, where, "analysis")
    frame([entry("/new", 9)]).write.mode("append").parquet(f"{where}/entries")
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read(spark, where)
    header = spark.read.parquet(f"{where}/header").withColumn("schema_version", F.lit(99))
    header = spark.createDataFrame(header.collect(), header.schema)
    header.write.mode("overwrite").parquet(f"{where}/header")
    with pytest.raises(artifacts.ArtifactError, match="version"):
        artifacts.read(spark, where, verify=False)
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read(spark, f"{place}/none")


def test_digests_ignore_order_and_see_every_fact(frame, shapes):
    e = shapes["entries"]
    one = lineage.content_digest({"entries": e})
    assert one == lineage.content_digest({"entries": e.repartition(5).withColumn("entry_id", F.col("entry_id") + 9)})
    assert one != lineage.content_digest({"entries": e.unionByName(e.limit(1))})
    assert one != lineage.content_digest({"unread": e})
    assert one != lineage.content_digest({"entries": e}, ("parent",))
    blank = lambda c: e.withColumn(c, F.when(F.col("path") != "/cloud", F.col(c)))
    assert one != lineage.content_digest({"entries": blank("allocated_size")})
    flip = e.withColumn("created", F.timestamp_seconds(-F.unix_seconds("created")))
    assert one != lineage.content_digest({"entries": flip})
    steps = frame([(0, "rename", "a"), (1, "rename", "b")], "position long, kind string, name string")
    turned = frame([(1, "rename", "a"), (0, "rename", "b")], "position long, kind string, name string")
    assert lineage.content_digest({"edits": steps}) != lineage.content_digest({"edits": turned})


def test_deep_digest_folds_agree(spark):
    many = spark.range(9000).selectExpr("id AS value")
    assert lineage.content_digest({"t": many}) == lineage.content_digest({"t": many.repartition(3)})


def test_an_analysis_names_its_parent_and_comes_back(spark, frame, contents, place):
    e = frame([entry("/a", 0), entry("/b", 1)])
    found = duplicates.analyze(e, contents([(0, "x" * 10), (1, "x" * 10)]))
    base = artifacts.write(spark, f"{place}/mac.inv", "scan", {"entries": e}, ["mac"])
    tables = {
        "settled": artifacts.with_paths(found.settled, e), "groups": found.groups,
        "members": artifacts.with_paths(found.members, e),
    }
    written = artifacts.write(spark, f"{place}/mac.an", "analyze", tables, ["mac"], [base])
    assert written.header["parents"] == [base.digest]
    artifacts.write(spark, f"{place}/pc.an", "analyze", tables, ["pc"], [base])
    loaded = artifacts.read_analyses(spark, [f"{place}/mac.an", f"{place}/pc.an"])
    assert [label for label, _ in loaded] == ["mac", "pc"]
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read_analyses(spark, [f"{place}/mac.an"])
    with pytest.raises(artifacts.ArtifactError):
        artifacts.write(spark, f"{place}/x", "analyze", {"entries": e}, ["mac"])


def test_moved_members_and_wrong_parents_are_refused(spark, frame, contents, place):
    e = frame([entry(f"/{i}", i) for i in range(4)])
    base = artifacts.write(spark, f"{place}/m.inv", "scan", {"entries": e}, ["mac"])
    found = duplicates.analyze(e, contents([(0, "x" * 10), (1, "x" * 10), (2, "y" * 10), (3, "y" * 10)]))
    members = artifacts.with_paths(found.members, e)
    tables = {"groups": found.groups, "members": members}
    artifacts.write(spark, f"{place}/m.an", "analyze", tables, ["mac"], [base])
    swap = {0: 2, 2: 0}
    for column in ("entry_id", "group_id"):
        of = F.create_map(*[F.lit(x) for kv in swap.items() for x in kv]) if column == "entry_id" else None
        new = F.coalesce(F.try_element_at(of, F.col(column)), F.col(column)) if of is not None else -F.col(column)
        spark.createDataFrame(members.withColumn(column, new.cast("long")).collect(), members.schema) \
            .write.mode("overwrite").parquet(f"{place}/m.an/members")
        with pytest.raises(artifacts.ArtifactError, match="not what its header"):
            artifacts.read(spark, f"{place}/m.an")
    with pytest.raises(artifacts.ArtifactError, match="inputs"):
        artifacts.write(spark, f"{place}/m.2", "analyze", tables, ["mac"], [base, base])
    with pytest.raises(artifacts.ArtifactError, match="follows"):
        artifacts.write(spark, f"{place}/m.3", "plan", {}, ["mac"], [base])


def test_broken_lines_of_an_export_are_unread_places(spark, shapes, place):
    lines = ndjson.records(shapes["entries"], shapes["unread"])
    broken = spark.createDataFrame([("{broken",), ('{"record": "no such"}',), ("[1]",)], "line string")
    lines.select("line").unionByName(broken).write.mode("overwrite").text(place)
    found = inventory.read_inventory(spark, [place], "ndjson")
    assert found.entries.count() + found.unread.count() == lines.count() + 3
    assert {r.detail for r in found.unread.collect()} >= {"{broken", '{"record": "no such"}', "[1]"}
    again = inventory.read_inventory(spark, [place, place], "ndjson", renumber=True)
    assert rows(again.entries, "entry_id") == [(i,) for i in range(2 * found.entries.count())]
    inventory.checked(again.entries)
    with pytest.raises(ValueError, match="repeat"):
        inventory.checked(inventory.read_inventory(spark, [place, place], "ndjson").entries)


def test_a_ledger_travels_with_parquet(spark, shapes, place):
    shapes["entries"].write.mode("overwrite").parquet(f"{place}/e")
    shapes["unread"].write.mode("overwrite").parquet(f"{place}/u")
    found = inventory.read_inventory(spark, [f"{place}/e"], unread=[f"{place}/u"])
    assert rows(found.unread) == rows(shapes["unread"]) and not found.is_complete()


def test_text_export_and_back(spark, shapes, place):
    lines = ndjson.records(shapes["entries"], shapes["unread"], shapes["roots"], shapes["links"])
    ndjson.export_ndjson(lines, place, replace=True)
    back, roots, links = ndjson.read_ndjson(spark, place)
    assert rows(back.entries) == rows(shapes["entries"])
    assert rows(back.unread) == rows(shapes["unread"])
    assert rows(roots) == rows(shapes["roots"]) and rows(links) == rows(shapes["links"])
    text = [r.value for r in spark.read.text(place).collect()]
    assert sum('"bytes":"2f626164ff"' in t for t in text) == 1


def test_bad_rows_become_unread_places(spark, place):
    spark.createDataFrame([('{"entry_id": 1, "path": "/a", "kind": "file"}',), ("{broken",)], "value string") \
        .write.mode("overwrite").text(place)
    found = inventory.read_inventory(spark, [place], "json")
    assert rows(found.entries, "entry_id") == [(1,)]
    assert rows(found.unread, "reason", "detail") == [("other", "{broken")]
    assert not found.is_complete()


def test_roots_are_concatenated_without_removing_overlaps(spark, frame, place):
    frame([entry("/a", 0)]).write.mode("overwrite").parquet(place)
    found = inventory.read_inventory(spark, [place, place])
    assert found.entries.count() == 2 and found.is_complete()


def test_files_are_listed_and_digested_like_their_content(spark, place):
    texts = {"a": "x" * 50, "b": "short"}
    for name, text in texts.items():
        with open(f"{place}/{name}", "w", encoding="utf-8") as out:
            out.write(text)
    e = inventory.list_files(spark, place, "mac")
    assert rows(e, "entry_id", "logical_size") == [(0, 50), (1, 5)]
    whole = inventory.digest_files(e)
    assert rows(whole, "entry_id", "digest") == [(0, sha(texts["a"])), (1, sha("short"))]
    content = spark.createDataFrame([(0, texts["a"]), (1, "short")], "entry_id long, content string")
    size = F.octet_length("content").cast("long")
    column = content.select("entry_id", digests.sample_digest(F.col("content"), size, 4))
    assert rows(inventory.digest_files(e, True, 4), "entry_id", "digest") == rows(column)
    missing = e.withColumn("path", F.lit("/nowhere"))
    assert inventory.digest_files(missing).where("trouble is not null").count() == 2


def test_content_that_may_download_is_never_joined(frame, contents):
    e = frame([entry("/a", 0), entry("/b", 1, residency="remote"), entry("/c", 2, residency="unknown")])
    assert rows(inventory.read_content(e, contents((i, "x") for i in range(3))), "entry_id") == [(0,)]


def test_one_failure_marks_a_folder_unread(spark):
    failures = spark.createDataFrame(
        [("mac", "/d", 60, None, "late"), ("mac", "/d", None, "other", "odd"), ("mac", "/e", None, "other", "odd")],
        "machine string, folder string, errno int, error_kind string, message string",
    )
    assert rows(inventory.unread_directories(failures), "path", "reason", "detail") == [
        ("/d", "other", "odd"), ("/e", "other", "odd")
    ]


def steps(frame, *items):
    """(sequence, attempt, progress, reason) rows."""
    return frame(
        [(s, a, s, "mac", p, r, None, f"/{s}", f"/q/{s}", None, second(a)) for s, a, p, r in items],
        schema.STEP,
    )


def test_a_later_record_replaces_an_earlier_one(spark, frame, place):
    log = f"{place}/log"
    journal.append_steps(steps(frame, (0, 0, "intended", None), (1, 0, "intended", None), (2, 0, "intended", None)), log)
    journal.append_steps(steps(frame, (0, 1, "done", None), (1, 1, "skipped", "source_missing")), log)
    latest = journal.latest_steps(journal.read_steps(spark, log))
    assert tuple(journal.tally(latest, F.lit(5)).first()) == (1, 1, 0, 1, 5, False)
    assert rows(journal.unresolved(journal.read_steps(spark, log)), "sequence") == [(2,)]
    assert rows(journal.stop_reasons(latest), "steps") == [(1,)]


def test_the_live_tally_follows_the_log(spark, frame, place):
    log, out, state = f"{place}/log", f"{place}/out", f"{place}/state"
    journal.append_steps(steps(frame, *[(i, 0, "intended", None) for i in range(4)]), log)

    def tally():
        live_tally.start(spark, log, out, state).awaitTermination()
        return tuple(live_tally.tally(spark.read.schema(live_tally.CHANGE).parquet(out)).first())

    assert tally() == (0, 0, 0, 4, 0, False)
    # A very late, a repeated and an out-of-date record.
    journal.append_steps(
        steps(frame, (0, 1, "done", None), (1, 1, "failed", "x"), (2, 2, "done", None), (2, 1, "failed", "y"),
              (0, 0, "intended", None)), log,
    )
    assert tally() == (2, 0, 1, 1, 0, False)


def header(digest, stage, kind, parents, version=schema.SCHEMA_VERSION, machines=("mac",), merged=False):
    return (digest, version, stage, kind, list(parents), list(machines), merged)


HEADER = (
    "content_digest string, schema_version int, stage string, kind string, parents array<string>, "
    "machines array<string>, merged boolean"
)


def test_chains_are_audited(frame):
    headers = frame([
        header("i1", "scan", "inventory", []), header("i2", "scan", "inventory", [], version=0),
        header("a1", "analyze", "analysis", ["i1"]), header("a2", "analyze", "analysis", ["i2"]),
        header("m", "merge", "analysis", ["a1", "a2"], machines=("mac", "pc"), merged=True),
        header("m1", "merge", "analysis", ["a1"]), header("p", "plan", "plan", ["i1"]),
    ], HEADER)
    supplied = frame(
        [("a1", 0, "i1"), ("a2", 0, "i2"), ("m", 0, "a2"), ("m", 1, "a1"), ("m1", 0, "a1"), ("p", 0, "i1")],
        "child string, ordinal long, digest string",
    )
    assert rows(lineage.chain_audit(headers, supplied)) == [
        ("i2", "schema_mismatch", -1), ("m", "parent_digest_mismatch", 0), ("m", "parent_digest_mismatch", 1),
        ("m1", "wrong_parent_count", -1), ("p", "wrong_input_kind", 0),
    ]
    run = frame([("a1", "mac"), ("a2", "pc"), ("m", "mac")], "content_digest string, machine string")
    assert rows(lineage.executability_audit(headers, run), "artifact", "violation") == [
        ("a2", "foreign_machine"), ("m", "merged_scope_not_executable")
    ]
