from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from filelens import schema
from filelens.sources import steplog
from tests.conftest import rows


@pytest.fixture
def place():
    return tempfile.mkdtemp(prefix="spark-") + "/log"


@pytest.fixture(scope="module")
def steps(spark):
    wide = spark.range(3000).select(F.col("id").alias("sequence"), F.lit(1).alias("attempt"), F.lit("done").alias("progress"))
    return wide.select(*[
        (F.col(f.name) if f.name in wide.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.STEP.fields
    ])


def test_a_log_is_opened_added_to_and_sealed(spark, steps, place):
    log = steplog.begin(spark, place, "plan")
    assert steplog.load(spark, place).steps(spark).count() == 0 and steplog.state(spark, log) == "unsealed"
    log = steplog.append(spark, log, steps.where("sequence < 1000"))
    log = steplog.append(spark, log, steps.where("sequence >= 1000").repartition(3))
    log = steplog.append(spark, log, steps.limit(0))
    back = steplog.load(spark, place)
    assert back.records == log.records and steplog.state(spark, back) == "unsealed"
    assert rows(back.steps(spark), "sequence", "progress") == rows(steps, "sequence", "progress")
    sealed = steplog.seal(spark, back)
    assert sealed.records[-1]["rows"] == 3000 and steplog.state(spark, steplog.load(spark, place)) == "sealed"
    for change in (steplog.append, lambda s, o, _: steplog.seal(s, o)):
        with pytest.raises(steplog.LogError):
            change(spark, sealed, steps)


def test_two_writers_cannot_take_one_number(spark, steps, place):
    one = steplog.begin(spark, place, "plan")
    two = steplog.load(spark, place)
    steplog.append(spark, one, steps.where("sequence < 10"))
    with pytest.raises(steplog.LogError, match="another"):
        steplog.append(spark, two, steps.where("sequence >= 10"))
    with pytest.raises(steplog.LogError):
        steplog.begin(spark, place, "plan")
    found = steplog.load(spark, place)
    assert found.steps(spark).count() == 10 and steplog.state(spark, found) == "unsealed"
    assert steplog.append(spark, found, steps.where("sequence >= 10")).steps(spark).count() == 3000


@pytest.mark.parametrize("damage", ["row", "file", "folder", "record", "rewritten", "cut"])
def test_changes_behind_the_back_of_a_log_show(spark, steps, place, damage):
    log = steplog.begin(spark, place, "plan")
    for at in range(3):
        log = steplog.append(spark, log, steps.where(f"sequence % 3 = {at}").coalesce(1))
    steplog.seal(spark, log)
    assert steplog.state(spark, steplog.load(spark, place)) == "sealed"
    record = lambda n: f"{place}/records/{n:09d}"
    parts = [[f"{f}/{p}" for p in os.listdir(f) if p.endswith(".parquet")] for f in log.folders]
    if damage == "row":
        changed = spark.read.parquet(log.folders[1]).withColumn("progress", F.when(F.col("sequence") == 4, "failed").otherwise(F.col("progress")))
        changed.coalesce(1).write.parquet(f"{place}-new")
        os.replace(next(f"{place}-new/{p}" for p in os.listdir(f"{place}-new") if p.endswith(".parquet")), parts[1][0])
    elif damage == "file":
        steps.limit(1).write.mode("append").parquet(log.folders[1])
    elif damage == "folder":
        for part in os.listdir(log.folders[1]):
            os.unlink(f"{log.folders[1]}/{part}")
        os.rmdir(log.folders[1])
    elif damage == "record":
        os.unlink(record(2))
    elif damage == "rewritten":
        text = open(record(2), encoding="utf-8").read().replace('"rows": 1000', '"rows": 1001')
        open(record(2), "w", encoding="utf-8").write(text)
    else:
        os.unlink(record(0))
    for name in os.listdir(f"{place}/records") + [f"../steps/{os.path.basename(f)}/{p}" for f in log.folders if os.path.isdir(f) for p in os.listdir(f)]:
        path = f"{place}/records/{name}"
        if os.path.basename(path).startswith(".") and path.endswith(".crc"):
            os.unlink(path)
    assert steplog.state(spark, steplog.load(spark, place)) == "tampered"


def test_a_folder_without_a_record_is_not_read(spark, steps, place):
    log = steplog.append(spark, steplog.begin(spark, place, "plan"), steps.limit(5))
    steps.write.parquet(f"{place}/steps/000000002-lost")
    found = steplog.load(spark, place)
    assert found.steps(spark).count() == 5 and steplog.state(spark, found) == "unsealed"
    assert steplog.append(spark, found, steps.limit(7)).steps(spark).count() == 12
    with pytest.raises(steplog.LogError):
        steplog.load(spark, f"{place}-none")
    assert log.is_sealed is False
