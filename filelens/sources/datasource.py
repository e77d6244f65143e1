"""``spark.read.format("filelens")``: stored tables as a data source.

A table is a folder of Parquet files and a list of them, which is put in place last and at
once. A writer that fails or is lost leaves no list, and its files are removed; what is
not on the list is not read. The list carries the version of the tables, the shape of the
rows and a digest of every file, so a reader refuses a version it does not know before it
looks at anything else, and each task checks the file it reads before it hands on a row.

    spark.dataSource.register(StoredTable)
    entries.write.format("filelens").mode("overwrite").save(path)
    spark.read.format("filelens").load(path)

Options: ``path``; ``verify`` ('true'), whether files are checked. Modes: ``append`` adds
files to the list, ``overwrite`` makes a new one; both remove nothing that is on the list
they replace before theirs stands. The tables of an artifact are written by
``artifacts.write``, whose digests cover rows; this one serves single tables that other
tools hand on, and covers files.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from filelens import schema

LIST = "_files.json"
FILE_ROWS = 500_000  # rows of a file, about


class StoredTableError(ValueError):
    """A table that may not be read or written."""


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if not re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _listed(path: str) -> dict | None:
    files, place = _store(path)
    if files.get_file_info(f"{place}/{LIST}").type == pafs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{place}/{LIST}") as file:
        return json.loads(file.read())


@dataclass
class StoredFile(WriterCommitMessage):
    """One file of a table."""

    name: str
    rows: int
    digest: str


@dataclass
class FilesOfTask(WriterCommitMessage):
    files: list[StoredFile]


class FilePartition(InputPartition):
    def __init__(self, name: str, digest: str):
        self.name, self.digest = name, digest


class TableReader(DataSourceReader):
    def __init__(self, path: str, shape: StructType, files: list[dict], verify: bool):
        self.path, self.shape, self.files, self.verify = path, shape, files, verify

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f["name"], f["digest"]) for f in self.files if f["rows"]] or [FilePartition("", "")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, place = _store(self.path)
        with files.open_input_stream(f"{place}/{partition.name}") as file:
            data = file.read()  # a writer keeps files small
        if self.verify and hashlib.sha256(data).hexdigest() != partition.digest:
            raise StoredTableError(f"{partition.name} of {self.path} is not what the list says it is")
        wanted = to_arrow_schema(self.shape)
        for batch in pq.ParquetFile(pa.BufferReader(data)).iter_batches(columns=self.shape.names):
            yield from pa.Table.from_batches([batch]).select(self.shape.names).cast(wanted).to_batches()


class TableWriter(DataSourceArrowWriter):
    def __init__(self, path: str, shape: StructType, overwrite: bool):
        self.path, self.shape, self.overwrite = path, shape, overwrite
        self.token = uuid.uuid4().hex  # in the names of all files of this write
        before = _listed(path)
        if before and before["version"] != schema.SCHEMA_VERSION and not overwrite:
            raise StoredTableError(f"{path} has version {before['version']}, this writes {schema.SCHEMA_VERSION}")
        if before and not overwrite and before["shape"] != shape.json():
            raise StoredTableError(f"{path} holds rows of another shape")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FilesOfTask:
        """Runs in a task: one file for every so many rows. A task that fails removes its
        own; one that is lost leaves files that are on no list."""
        files, place = _store(self.path)
        files.create_dir(place, recursive=True)
        written: list[StoredFile] = []
        held: list[pa.RecordBatch] = []

        def put() -> None:
            sink = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_batches(held, to_arrow_schema(self.shape)), sink, compression="zstd")
            data = sink.getvalue().to_pybytes()
            name = f"part-{self.token}-{uuid.uuid4().hex}.parquet"
            written.append(StoredFile(name, sum(map(len, held)), hashlib.sha256(data).hexdigest()))
            with files.open_output_stream(f"{place}/{name}") as file:
                file.write(data)
            held.clear()

        try:
            for batch in iterator:
                held.append(batch)
                if sum(map(len, held)) >= FILE_ROWS:
                    put()
            if held:
                put()
        except BaseException:
            self._remove(written)
            raise
        return FilesOfTask(written)

    def commit(self, messages: list[FilesOfTask | None]) -> None:
        files, place = _store(self.path)
        files.create_dir(place, recursive=True)
        before = _listed(self.path)
        kept = [] if before is None or self.overwrite else before["files"]
        made = [asdict(f) for message in messages if message for f in message.files]
        told = {"version": schema.SCHEMA_VERSION, "shape": self.shape.json(), "files": kept + made}
        name = f"{place}/_{uuid.uuid4().hex}.json"
        with files.open_output_stream(name) as file:
            file.write(json.dumps(told).encode())
        files.move(name, f"{place}/{LIST}")
        if before is not None and self.overwrite:
            self._remove([StoredFile(**f) for f in before["files"]])

    def abort(self, messages: list[FilesOfTask | None]) -> None:
        files, place = _store(self.path)
        for found in files.get_file_info(pafs.FileSelector(place, allow_not_found=True)):
            if found.base_name.startswith(f"part-{self.token}-"):
                files.delete_file(found.path)

    def _remove(self, made: list[StoredFile]) -> None:
        files, place = _store(self.path)
        for file in made:
            if files.get_file_info(f"{place}/{file.name}").type == pafs.FileType.File:
                files.delete_file(f"{place}/{file.name}")


class StoredTable(DataSource):
    """The data source; see the module."""

    @classmethod
    def name(cls) -> str:
        return "filelens"

    def _found(self) -> dict:
        path = self.options.get("path")
        found = _listed(path) if path else None
        if found is None:
            raise StoredTableError(f"{path} holds no finished table")
        if found["version"] != schema.SCHEMA_VERSION:
            raise StoredTableError(f"{path} has version {found['version']}, this reads {schema.SCHEMA_VERSION}")
        return found

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._found()["shape"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        verify = str(self.options.get("verify", "true")).lower() != "false"
        return TableReader(self.options["path"], schema, self._found()["files"], verify)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TableWriter(self.options["path"], schema, overwrite)
