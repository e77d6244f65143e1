from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from filelens.sources.datasource import LIST, StoredTable
from tests.conftest import entry, folder, rows


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(StoredTable)


@pytest.fixture
def place():
    return tempfile.mkdtemp(prefix="spark-") + "/t"


@pytest.fixture(scope="module")
def entries(frame):
    return frame([entry("/ü", 0, created=-158000000, file_id=(-1, -2)), folder("/d", 1), *[entry(f"/f{i}", 2 + i) for i in range(50)]])


def files(place):
    return sorted(f for f in os.listdir(place) if f.startswith("part-"))


def test_rows_come_back_as_they_were(spark, entries, place):
    entries.repartition(3).write.format("filelens").mode("append").save(place)
    back = spark.read.format("filelens").load(place)
    assert back.schema == entries.schema and rows(back) == rows(entries)
    assert len(files(place)) == 3 and len({r[0] for r in back.select(F.spark_partition_id()).collect()}) == 3
    assert back.where("kind = 'directory'").select("path").first().path == "/d"
    entries.limit(1).write.format("filelens").mode("append").save(place)
    assert spark.read.format("filelens").load(place).count() == 53
    entries.limit(2).write.format("filelens").mode("overwrite").save(f"file:{place}")
    assert spark.read.format("filelens").load(f"file:{place}").count() == 2 == sum(map(bool, files(place))) + 1
    entries.limit(0).write.format("filelens").mode("overwrite").save(place)
    assert spark.read.format("filelens").load(place).count() == 0


def test_a_failed_write_leaves_nothing(spark, entries, place):
    entries.limit(3).write.format("filelens").mode("append").save(place)
    held = files(place)
    broken = entries.repartition(4).withColumn("link_count", F.when(F.col("path") == "/f7", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("link_count")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            broken.write.format("filelens").mode(mode).save(place)
        assert files(place) == held and spark.read.format("filelens").load(place).count() == 3


def test_changed_files_and_foreign_versions_are_refused(spark, entries, place):
    entries.coalesce(1).write.format("filelens").mode("append").save(place)
    with pytest.raises(Exception, match="another shape"):
        entries.select("path").write.format("filelens").mode("append").save(place)
    (name,) = files(place)
    data = open(f"{place}/{name}", "rb").read()
    entries.limit(1).coalesce(1).toPandas()[["path"]].to_parquet(f"{place}/{name}")
    with pytest.raises(PythonException, match="not what the list says"):
        spark.read.format("filelens").load(place).collect()
    open(f"{place}/{name}", "wb").write(data)
    assert spark.read.format("filelens").option("verify", "false").load(place).count() == 52
    told = json.load(open(f"{place}/{LIST}", encoding="utf-8"))
    json.dump({**told, "version": 99}, open(f"{place}/{LIST}", "w", encoding="utf-8"))
    with pytest.raises(Exception, match="version 99"):
        spark.read.format("filelens").load(place)
    with pytest.raises(Exception, match="no finished table"):
        spark.read.format("filelens").load(f"{place}-none")
