"""Hot keys: one key holds a third of all rows and more."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from filelens.operators import scale
from filelens.plans import carry, preflight
from tests.conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows, 1,000 of them on one key."""
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id") % 97).alias("key")
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_sliced_joins_equal_plain_joins(hot, how):
    one = hot.where("key <> 5").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    plain = hot.join(one, "key", how)
    sliced = scale.join_hot(hot, one, ["key"], "n", "id", how, slice_rows=50)
    assert sliced.columns == plain.columns
    assert rows(sliced) == rows(plain)
    counted = scale.join_counted(hot, one.select("key", "m"), ["key"], "id", how)
    assert rows(counted, "id", "key") == rows(plain, "id", "key")


def test_a_hot_key_is_cut_into_slices(hot):
    one = hot.groupBy("key").agg(F.count("*").alias("n"))
    sliced = scale.join_hot(hot, one, ["key"], "n", "id", slice_rows=50)
    plan = sliced._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "explode" in plan


def test_numbers_are_consecutive_over_a_total_order(hot):
    numbered = scale.number_rows(hot, [F.desc("key"), F.col("id")], "n", start=7)
    got = [(r.key, r.id) for r in numbered.orderBy("n").collect()]
    assert got == sorted(got, key=lambda p: (-p[0], p[1]))
    assert [r.n for r in numbered.orderBy("n").collect()] == list(range(7, 3007))


def test_positions_inside_groups(hot):
    placed = scale.number_within(hot, ["key"], [F.col("id")], "at", "id")
    by_key: dict[int, list] = {}
    for r in placed.orderBy("key", "id").collect():
        by_key.setdefault(r.key, []).append(r.at)
    assert all(v == list(range(len(v))) for v in by_key.values())
    assert len(by_key[0]) > 1000


def test_first_rows_are_limited_before_the_shuffle(hot):
    first = scale.first_rows(hot, ["key"], [F.col("id")], 3)
    assert first.groupBy("key").count().agg(F.max("count")).first()[0] == 3
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_look_up_is_the_same_small_or_large(hot):
    one = hot.groupBy("key").agg(F.max("id").alias("m")).where("key < 50")
    small = scale.look_up(hot, one, ["key"], "id")
    large = scale.look_up(hot, one, ["key"], "id", limit=1)
    assert rows(small, "id", "m") == rows(large, "id", "m")


def test_looking_at_many_places_broadcasts_none_of_them(spark):
    """Sides of a few MB would pass through the driver, once for every join."""
    observed = spark.range(100_000).selectExpr(
        "'mac' machine", "concat('/home/', repeat('x', 40), id) path", "id entry_id", "'file' kind", "id logical_size",
        "timestamp_seconds(id) modified", "named_struct('residency', 'local') cloud",
    )
    moves = observed.selectExpr("entry_id position", "machine", "path subject_path")
    seen = preflight.with_looks(moves, observed, {"subject_path": "source"}, "position", slices=None)
    found = seen.where("source.entry_id = position")
    assert len(found.collect()) == 100_000
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in final and "BroadcastExchange" not in final


def test_looking_again_before_a_run_broadcasts_no_places(spark):
    """The look that a run takes at every source, which its steps and their reversal follow."""
    observed = spark.range(100_000).selectExpr(
        "'mac' machine", "concat('/home/', repeat('x', 40), id) path", "id entry_id", "'file' kind", "id logical_size",
        "timestamp_seconds(id) modified", "named_struct('residency', 'local') cloud",
    )
    moves = observed.selectExpr("entry_id seq", "machine", "path from_path", "cast(null as string) content")
    troubled = carry._trouble_at_source(moves, observed, None, None).where("own is null and source.entry_id = seq")
    assert len(troubled.collect()) == 100_000
    final = troubled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in final and "BroadcastExchange" not in final
