from __future__ import annotations

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from filelens.operators import duplicates
from filelens.sources import inventory
from tests.conftest import entry, rows

TWO = "machine string, entry_id long, content string"


@pytest.fixture
def entries(frame):
    """Ids from zero on each of two machines."""
    same = frame([entry("/a1", 0, 10), entry("/a2", 1, 10), entry("/a3", 2, 10)])
    return same.unionByName(same.where("entry_id < 2").withColumn("machine", F.lit("pc")))


def test_equal_ids_on_two_machines_are_two_entries(spark, entries):
    with pytest.raises(ValueError, match="repeat"):
        inventory.checked(entries)
    texts = [("mac", 0, "x" * 10), ("mac", 1, "x" * 10), ("mac", 2, "y" * 10), ("pc", 0, "x" * 10), ("pc", 1, "y" * 10)]
    content = spark.createDataFrame(texts, TWO)
    numbers = inventory.machine_numbers(entries)
    keyed = inventory.checked(inventory.keyed(entries, numbers))
    assert keyed.schema == entries.schema
    found = duplicates.analyze(keyed, inventory.keyed(content, numbers).select("entry_id", "content"))
    sizes = found.members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(r.n for r in sizes.collect()) == [2, 3]
    back = found.members.select("machine", inventory.source_id(F.col("entry_id")).alias("entry_id"))
    assert rows(back) == [("mac", 0), ("mac", 1), ("mac", 2), ("pc", 0), ("pc", 1)]


def test_ids_that_do_not_fit_and_unknown_machines_are_errors(spark, entries):
    numbers = inventory.machine_numbers(entries)
    for row in (("mac", 1 << inventory.ID_BITS, "x"), ("mac", -1, "x"), ("mars", 1, "x")):
        with pytest.raises(SparkRuntimeException, match="no key for entry"):
            inventory.keyed(spark.createDataFrame([row], TWO), numbers).collect()
    assert inventory.keyed(spark.createDataFrame([], TWO), numbers).count() == 0
