"""A step log that is opened, added to, and sealed.

Every addition is a Parquet folder of its own and counts once its record stands: a small
file named by its number, put there whole and only if no other writer took the number. A
folder without a record (a writer that was lost) is never read. Each record holds the
digest of its folder's rows and of the record before it, so what was changed, added or
left out later shows. A log without a seal belongs to a run that stopped part-way: it is
read like any other, for what was done must stay undoable.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens import schema
from filelens.sources import sections

RECORD = "number int, kind string, folder string, rows long, digest string, before string"
FOLD_DIGITS = 3


class LogError(ValueError):
    """A log that may not be opened, added to or sealed."""


@dataclass
class StepLog:
    """A log as its records tell it; ``state`` says whether the rows agree."""

    path: str
    records: list[dict]
    chained: bool

    @property
    def is_sealed(self) -> bool:
        return bool(self.records) and self.records[-1]["kind"] == "seal"

    @property
    def folders(self) -> list[str]:
        return [f"{self.path}/steps/{r['folder']}" for r in self.records if r["kind"] == "steps"]

    def steps(self, spark: SparkSession) -> DataFrame:
        """All steps whose records stand, whether or not the run finished."""
        if not self.folders:
            return spark.createDataFrame([], schema.STEP)
        return spark.read.schema(schema.STEP).parquet(*self.folders)


def _digests(steps: DataFrame, by: str) -> DataFrame:
    """(by, rows, digest) of many folders in one pass, in no order of rows. Equal rows are
    counted first; hashes are gathered by their beginnings, then folder by folder."""
    hashed = steps.select(by, F.sha2(sections.row_text(steps, schema.STEP.fieldNames()), 256).alias("hash"))
    counted = hashed.groupBy(by, "hash").agg(F.count(F.lit(1)).alias("n"))
    told, rows = F.concat_ws(":", "hash", F.col("n").cast("string")), F.sum("n").alias("rows")
    gathered = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    parts = counted.groupBy(by, F.substring("hash", 1, FOLD_DIGITS).alias("part")).agg(rows, gathered(told).alias("digest"))
    parts = parts.select(by, F.col("rows").alias("n"), F.concat_ws(":", "part", "digest").alias("told"))
    return parts.groupBy(by).agg(rows, gathered("told").alias("digest"))


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place, whole, if there is none of its name."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        made = f"{where.path}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        with open(made, "w", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(made, where.path)
        except FileExistsError:
            return False
        finally:
            os.unlink(made)
        return True
    # A rename that does not replace, as streaming queries commit their batches.
    files = spark._jvm.org.apache.hadoop.fs
    context = files.FileContext.getFileContext(spark._jvm.java.net.URI(path), spark._jsc.hadoopConfiguration())
    made = files.Path(f"{path}.{uuid.uuid4().hex}")
    system = made.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
        none = spark._sc._gateway.new_array(rename, 0)
        context.rename(made, files.Path(path), none)
    except Exception:  # noqa: BLE001 - whatever the store raises, the file that stands decides
        system.delete(made, False)
        return False
    return True


def load(spark: SparkSession, path: str) -> StepLog:
    """The records of a log, one small file each, in order."""
    try:
        lines = spark.read.text(f"{path}/records/[0-9]*", wholetext=True).collect()
    except AnalysisException as problem:
        raise LogError(f"{path} holds no log") from problem
    told = sorted((json.loads(r.value)["number"], r.value) for r in lines if not r.value.isspace())
    before, chained, records = "", True, []
    for place, (number, text) in enumerate(told):
        record = json.loads(text)
        chained &= number == place and record["before"] == before
        before = hashlib.sha256(text.encode()).hexdigest()
        records.append({**record, "_own": before})
    chained &= all(r["kind"] != "seal" for r in records[:-1]) and records[0]["kind"] == "open"
    return StepLog(path, records, chained)


def _commit(spark: SparkSession, log: StepLog, kind: str, folder: str, rows: int, digest: str) -> StepLog:
    before = log.records[-1]["_own"] if log.records else ""
    number = len(log.records)
    record = {"number": number, "kind": kind, "folder": folder, "rows": rows, "digest": digest, "before": before}
    text = json.dumps(record, sort_keys=True)
    if not _put(spark, f"{log.path}/records/{number:09d}", text):
        raise LogError(f"record {number} of {log.path} was written by another")
    own = hashlib.sha256(text.encode()).hexdigest()
    return StepLog(log.path, [*log.records, {**record, "_own": own}], log.chained)


def begin(spark: SparkSession, path: str, plan_digest: str) -> StepLog:
    """Open a log before anything is done; ``plan_digest`` names what it carries out."""
    return _commit(spark, StepLog(path, [], True), "open", "", 0, plan_digest)


def append(spark: SparkSession, log: StepLog, steps: DataFrame) -> StepLog:
    """Add steps as one record. The log as it was loaded decides the number: who finds it
    taken loads again. A task that is lost and run again leaves one copy of its rows."""
    if log.is_sealed:
        raise LogError(f"{log.path} is sealed")
    folder = f"{len(log.records):09d}-{uuid.uuid4().hex}"
    place = f"{log.path}/steps/{folder}"
    steps.select(*[F.col(f.name).cast(f.dataType) for f in schema.STEP.fields]).write.parquet(place)
    written = spark.read.schema(schema.STEP).parquet(place)
    found = _digests(written.withColumn("folder", F.lit(folder)), "folder").first()
    return _commit(spark, log, "steps", folder, found.rows if found else 0, found.digest if found else "")


def seal(spark: SparkSession, log: StepLog) -> StepLog:
    """Mark a run as finished. The seal covers all records before it."""
    if log.is_sealed:
        raise LogError(f"{log.path} is sealed")
    if not agrees(spark, log):
        raise LogError(f"{log.path} is not what its records say it is")
    rows = sum(r["rows"] for r in log.records)
    return _commit(spark, log, "seal", "", rows, log.records[-1]["_own"])


def agrees(spark: SparkSession, log: StepLog) -> bool:
    """Whether records follow each other and every folder holds the rows they tell of."""
    if not log.chained:
        return False
    told = {r["folder"]: (r["rows"], r["digest"]) for r in log.records if r["kind"] == "steps"}
    if not told:
        return True
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    try:
        rows = log.steps(spark).select(*schema.STEP.fieldNames(), folder.alias("folder"))
        found = {r.folder: (r.rows, r.digest) for r in _digests(rows, "folder").collect()}  # a row a record
    except AnalysisException:  # a folder is gone
        return False
    return found == {k: v for k, v in told.items() if v[0]}


def state(spark: SparkSession, log: StepLog) -> str:
    """'sealed', 'unsealed', or 'tampered' where rows or records were changed since."""
    if not agrees(spark, log):
        return "tampered"
    return "sealed" if log.is_sealed else "unsealed"
