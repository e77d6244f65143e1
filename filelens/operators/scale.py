"""Joins, numbering and broadcasting that survive hot keys.

A single key, source or group may hold a third of all rows. Nothing here collects
a group: heavy keys are found by a pre-aggregated count, split into slices for
joins, and ordering within or across groups is done by range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelens.session import pin

# A key outside the heaviest HEAVY_KEYS holds at most 1/HEAVY_KEYS of the rows,
# so this fixed number bounds the broadcast (a few MB) and leaves nothing hot behind.
HEAVY_KEYS = 100_000
SLICE_ROWS = 2_000_000
BROADCAST_ROWS = 1_000_000


_forced: list[int] = []


@contextmanager
def sliced(rows: int) -> Iterator[None]:
    """While plans are built inside, joins cut every key above ``rows`` rows, however
    small the frames are: the plan of large inputs, on small ones."""
    _forced.append(rows)
    try:
        yield
    finally:
        _forced.pop()


def join_hot(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    rows: str,
    spread_by: str,
    how: str = "inner",
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Equi-join ``many`` rows per key to the ``one`` row of that key.

    ``rows`` is a column of ``one`` bounding how many ``many`` rows its key has.
    Keys above ``slice_rows`` are cut into slices by a hash of ``spread_by``; the
    single row of such a key is repeated once per slice. The result is the plain
    join's. ``how`` may be inner, left or left_semi. ``slice_rows`` is None where
    a count has shown that no key can be hot (see ``slices_for``).
    """
    keys = list(keys)
    slice_rows = _forced[-1] if _forced else slice_rows
    if slice_rows is None:
        return many.join(one, keys, how)
    heavy = (
        one.select(*keys, F.col(rows).alias("_n"))
        .orderBy(F.desc("_n"))
        .limit(HEAVY_KEYS)
        .where(F.col("_n") > slice_rows)
        .select(*keys, F.ceil(F.col("_n") / slice_rows).cast("int").alias("_slices"))
    )
    heavy = F.broadcast(heavy)
    left = many.join(heavy, keys, "left").withColumn(
        "_slice",
        F.when(F.col("_slices").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(spread_by), F.col("_slices")).cast("int")
        ),
    )
    right = one.join(heavy, keys, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    )
    return left.drop("_slices").join(right.drop("_slices"), [*keys, "_slice"], how).drop("_slice")


def number_rows(
    frame: DataFrame, order: Sequence[Column], name: str, start: int = 0
) -> DataFrame:
    """Consecutive numbers over a total order, without one task seeing every row.

    Rows are range-partitioned and sorted, pinned so that both passes see the same
    partitions, then numbered by position plus the rows of earlier partitions. The
    only broadcast has one row per partition.
    """
    spark = frame.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = pin(frame.repartitionByRange(width, *order).sortWithinPartitions(*order))
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    place = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (place + F.col("_before") + start).cast("long"))
        .drop("_part", "_row", "_before")
    )


def number_within(
    frame: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str,
    spread_by: str,
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Positions from zero inside each group, however large a group is: number
    everything once, then subtract each group's first number."""
    numbered = number_rows(frame, [*[F.col(g) for g in group], *order], "_at")
    firsts = numbered.groupBy(*group).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    return (
        join_hot(numbered, firsts, group, "_rows", spread_by, slice_rows=slice_rows)
        .withColumn(name, F.col("_at") - F.col("_first"))
        .drop("_at", "_first", "_rows")
    )


def first_rows(
    frame: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """The first ``n`` rows per group. Spark keeps ``n`` per task before the
    shuffle (window group limit), so a hot group ships ``n`` rows per task."""
    ranked = frame.withColumn(
        name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    )
    return ranked.where(F.col(name) <= n)


def is_small(frame: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most ``limit`` rows. A plain count: each task adds
    up its own rows and nothing else moves. For scans and pinned frames."""
    return frame.count() <= limit


def slices_for(frame: DataFrame, slice_rows: int = SLICE_ROWS) -> int | None:
    """Slice size for joins of a frame's rows; None when the whole frame is no
    larger than one slice, so that none of its keys can be hot."""
    if _forced:
        return _forced[-1]
    return None if is_small(frame, slice_rows) else slice_rows


def join_counted(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    how: str = "inner",
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """``join_hot`` where nobody knows yet how many rows each key has."""
    if slice_rows is None:
        return many.join(one, list(keys), how)
    rows = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    counted = one.join(rows, list(keys))
    joined = join_hot(many, counted, keys, "_rows", spread_by, how, slice_rows)
    return joined.drop("_rows")


def look_up(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    how: str = "left",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join many rows to a unique-key side that is usually small: broadcast it
    behind a check of its size, otherwise join by counted slices. ``one`` should
    be cheap to count."""
    if is_small(one, limit):
        return many.join(F.broadcast(one), list(keys), how)
    return join_counted(many, one, keys, spread_by, how)
