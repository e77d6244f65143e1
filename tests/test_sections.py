from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from filelens.sources import artifacts, sections
from tests.conftest import entry, rows


@pytest.fixture(scope="module")
def many(frame):
    return frame([entry(f"/f{i}", i, size=i) for i in range(600)])


@pytest.fixture(scope="module")
def altered(many):
    grown = F.when(F.col("entry_id") == 77, F.col("logical_size") + 1).otherwise(F.col("logical_size"))
    return many.where("entry_id <> 500").withColumn("logical_size", grown)


def test_a_changed_row_changes_its_section_and_the_nodes_above(many, altered):
    one, two = (sections.tree(f, ("machine", "entry_id"), per_section=4) for f in (many, altered))
    assert sections.root(one)[0] == 600 and sections.root(two)[0] == 599
    depth = one.agg(F.max("depth")).first()[0]
    assert depth == 2 and sections.changed_sections(one, one).count() == 0
    hit = {r.prefix for r in sections.changed_sections(one, two).collect()}
    keys = many.where("entry_id IN (77, 500)").select(F.substring(sections.key_hash(many, ("machine", "entry_id")), 1, depth))
    assert hit == {r[0] for r in keys.collect()}


def test_trees_ignore_order_and_count_repeats(many):
    again = sections.tree(many.repartition(7), per_section=16)
    assert rows(again) == rows(sections.tree(many, per_section=16))
    assert sections.root(sections.tree(many.unionByName(many)))[1] != sections.root(sections.tree(many))[1]
    assert sections.root(sections.tree(many.limit(0))) == (0, "")


def test_differences_of_artifacts_are_read_from_their_sections(spark, many, altered, monkeypatch):
    monkeypatch.setattr(sections.tree, "__defaults__", ((), (), 4))
    place = tempfile.mkdtemp(prefix="spark-")
    for name, frame in (("one", many), ("two", altered)):
        artifacts.write(spark, f"{place}/{name}", "scan", {"entries": frame}, ["mac"])
    found = artifacts.differences(spark, f"{place}/one", f"{place}/two", "entries")
    assert rows(found) == [("mac", 77, "changed"), ("mac", 500, "removed")]
    back = artifacts.differences(spark, f"{place}/two", f"{place}/one", "entries")
    assert rows(back) == [("mac", 77, "changed"), ("mac", 500, "added")]
    some = sections.within(artifacts.stored(spark, f"{place}/one", "entries"), spark.createDataFrame([("a",)], "prefix string"))
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(_section,a)" in plan and "LessThanOrEqual(_section,afffffff)" in plan
    assert 0 < some.count() < 120


def test_many_changed_sections_are_joined(spark, many, monkeypatch):
    monkeypatch.setattr(sections, "RANGES", 1)
    placed = sections.placed(many, ("machine", "entry_id"))
    wanted = spark.createDataFrame([("a",), ("3",)], "prefix string")
    assert rows(sections.within(placed, wanted), "entry_id") == rows(placed.where("_section LIKE 'a%' OR _section LIKE '3%'"), "entry_id")


def test_a_section_is_checked_alone(spark, many, monkeypatch):
    monkeypatch.setattr(sections.tree, "__defaults__", ((), (), 4))
    place = tempfile.mkdtemp(prefix="spark-") + "/a"
    artifacts.write(spark, place, "scan", {"entries": many}, ["mac"])
    assert artifacts.section_holds(spark, place, "entries", "4f") and artifacts.section_holds(spark, place, "entries", "")
    extra = many.where("entry_id = 3").withColumn("logical_size", F.lit(9).cast("long"))
    sections.placed(extra, ("machine", "entry_id")).write.mode("append").parquet(f"{place}/entries")
    hit = extra.select(F.substring(sections.key_hash(extra, ("machine", "entry_id")), 1, 2)).first()[0]
    other = "00" if hit != "00" else "01"
    assert not artifacts.section_holds(spark, place, "entries", hit) and artifacts.section_holds(spark, place, "entries", other)
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read(spark, place)
