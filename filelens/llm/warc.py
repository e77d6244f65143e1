"""WARC archives with a two-level capture index.

Records are gzip members, so each can be read alone. Captures are sorted by reversed
host key (SURT) into compressed blocks of lines; a sparse directory holds one row a
block, and the first key of every index file is the level above. A key is found by
binary search: for its file, then for its block, then in the block; only then are the
ranges of its records read.

Files are written by the tasks, each attempt under a name of its own, into the folder
all executors share; rows name the files, so what a lost attempt left is never read.

Rows: a null payload is empty, a null url has the empty key, a null page_id is kept;
repeated rows are records of their own; among equal payloads the largest page_id is
the response (rows that share it too); other columns are ignored; an empty table
gives an empty archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm import text as tx
from filelens.session import keep, shared_dir

LEAST_REVISIT = 1000  # bytes of payload from which an equal one is a revisit
BLOCK_LINES = 1000
FILE_BYTES = 256 << 20
GAP, READ = 64 << 10, 8 << 20  # ranges this near are read together, up to so many bytes
SALTS = 16  # parts that the lookups in one index file may be dealt to
DATE = "1970-01-01T00:00:00Z"

CAPTURE = "surt string, page_id long, file string, offset long, length long"
FIELDS = ["surt", "page_id", "file", "offset", "length"]


@dataclass(frozen=True)
class Archive:
    """``directory``: (file, first_surt, offset, length, lines), one row a block."""

    directory: DataFrame
    captures: DataFrame


def surt(url: str | None) -> str:
    """Sort key: host reversed, port, then path and query; no scheme, user or fragment."""
    match = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    if not match:
        return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (url or "").split("#")[0])
    host, _, port = match[1].rpartition("@")[2].lower().partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (match[2] or "/")
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def _store(place: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, by Hadoop's way of writing it or a plain path."""
    if ":" not in place.split("/")[0]:
        return pafs.LocalFileSystem(), place
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", place))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, compressed as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[3:3] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:x-page:{refers_to}>",
        ]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def parsed(member: bytes) -> dict:
    """What a record says; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n") + 4
    told = int(re.search(rb"Content-Length: (\d+)", block[:cut])[1])
    payload = block[cut:]
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != told or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    number = lambda text: int(text[len("<urn:x-page:") : -1]) if len(text) > len("<urn:x-page:>") else None
    return {
        "page_id": number(head["WARC-Record-ID"]),
        "url": head["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
        "payload_bytes": told,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(head["WARC-Refers-To"]) if kind == "revisit" else None,
    }


# --- writing ------------------------------------------------------------------------


def _decided(pages: DataFrame, least: int) -> DataFrame:
    """Pages with digests and, for revisits, the page that is referred to."""
    html = F.coalesce("html", F.lit(""))
    told = pages.select(
        F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes")
    )
    repeated = keep(
        told.where(F.col("bytes") >= least).groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").drop("_n")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_response")), F.col("_response"))
    return told.join(repeated, ["digest", "bytes"], "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archive(pages: DataFrame, least: int = LEAST_REVISIT, block_lines: int = BLOCK_LINES) -> Archive:
    place = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(place)
        store.create_dir(folder, recursive=True)
        out, at, name = None, 0, ""
        for batch in batches:
            rows = []
            for page, url, html, digest, refers in zip(*[tx.column(batch, c) for c in batch.schema.names], strict=True):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                member = record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                out.write(member)
                rows.append((surt(url), page, name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r, strict=True)) for r in rows], _ARROW)
        if out is not None:
            out.close()

    captures = keep(_decided(pages, least).mapInArrow(write, CAPTURE))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(place)
        out, at, name, lines, first = None, 0, f"{uuid.uuid4().hex}.cdx.gz", [], None

        def block():
            nonlocal at
            packed = gzip.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6, mtime=0)
            out.write(packed)
            row = {"file": name, "first_surt": first, "offset": at, "length": len(packed), "lines": len(lines)}
            at += len(packed)
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for row in zip(*[tx.column(batch, c) for c in FIELDS], strict=True):
                if out is None:
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                if not lines:
                    first = row[0]
                lines.append("\t".join("" if v is None else str(v) for v in row))
                if len(lines) == block_lines:
                    yield block()
                    lines = []
        if lines:
            yield block()
        if out is not None:
            out.close()

    ordered = captures.repartitionByRange("surt", "page_id", "file", "offset").sortWithinPartitions("surt", "page_id", "file", "offset")
    directory = keep(ordered.mapInArrow(index, "file string, first_surt string, offset long, length long, lines long"))
    return Archive(directory.withColumn("folder", F.lit(place)), captures.withColumn("folder", F.lit(place)))


_ARROW = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


# --- reading ------------------------------------------------------------------------


def _in_block(store, folder: str, name: str, offset: int, length: int) -> list[list[str]]:
    with store.open_input_file(f"{folder}/{name}") as file:
        raw = file.read_at(length, offset)
    return [line.split("\t") for line in zlib.decompress(raw, 31).decode("utf-8", "surrogatepass").split("\n")]


def lookup(keys: DataFrame, archive: Archive) -> DataFrame:
    """Captures (``CAPTURE`` and folder) of the distinct ``surt`` values of ``keys``."""
    # One row an index file, and there is one for each task that wrote the index.
    tops = archive.directory.groupBy("file").agg(F.min("first_surt").alias("first")).orderBy("first", "file").collect()
    firsts, files = [t["first"] for t in tops], [t["file"] for t in tops]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, names = [], []
            for key in tx.column(batch, "surt"):
                # A key may begin in the file before the one that it also opens.
                low, high = max(bisect.bisect_left(firsts, key) - 1, 0), bisect.bisect_right(firsts, key)
                for name in files[low:high]:
                    found.append(key)
                    names.append(name)
            yield pa.record_batch([pa.array(found, pa.string()), pa.array(names, pa.string())], ["surt", "file"])

    wanted = keys.select("surt").where("surt IS NOT NULL").distinct().mapInArrow(locate, "surt string, file string")
    salted = wanted.withColumn("salt", F.pmod(F.xxhash64("surt"), F.lit(SALTS)).cast("int"))
    spread = archive.directory.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def search(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        rows: list[list[str]] = []
        if len(asked) and len(blocks):
            blocks = blocks.sort_values("offset")
            heads = blocks.first_surt.tolist()
            store, folder = _store(blocks.folder.iloc[0])
            by_block: dict[int, set[str]] = {}
            for key in asked.surt:
                for at in range(max(bisect.bisect_left(heads, key) - 1, 0), bisect.bisect_right(heads, key)):
                    by_block.setdefault(at, set()).add(key)
            for at, keys_here in by_block.items():
                lines = _in_block(store, folder, *blocks[["file", "offset", "length"]].iloc[at])
                column = [line[0] for line in lines]
                for key in keys_here:
                    rows += lines[bisect.bisect_left(column, key) : bisect.bisect_right(column, key)]
        out = pd.DataFrame(rows, columns=FIELDS)
        return out.assign(
            page_id=pd.to_numeric(out.page_id.replace("", None)).astype("Int64"),
            offset=out.offset.astype("int64"), length=out.length.astype("int64"),
            folder=blocks.folder.iloc[0] if len(blocks) else "",
        )

    return salted.groupBy("file", "salt").cogroup(spread.groupBy("file", "salt")).applyInPandas(search, CAPTURE + ", folder string")


READ_BACK = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of captures: near ranges of a file are read together."""
    names = [f.split()[0] for f in READ_BACK.split(", ")] + ["payload"] * with_payload
    shape = READ_BACK + ", payload binary" * with_payload
    schema = pa.schema(
        [(n, {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string(), "payload": pa.binary()}.get(n, pa.int64())) for n in names]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            columns = [tx.column(batch, c) for c in ("folder", "file", "offset", "length")]
            ranges = list(zip(*columns, strict=True))
            at = 0
            while at < len(ranges):
                folder, name, start, long = ranges[at]
                end, stop = start + long, at + 1
                while stop < len(ranges) and ranges[stop][:2] == (folder, name) and start <= ranges[stop][2] <= end + GAP and ranges[stop][2] - start < READ:
                    end = max(end, ranges[stop][2] + ranges[stop][3])
                    stop += 1
                if opened != (folder, name):
                    store, path = _store(folder)
                    file, opened = store.open_input_file(f"{path}/{name}"), (folder, name)
                raw = file.read_at(end - start, start)
                rows = [parsed(raw[o - start : o - start + n]) for _, _, o, n in ranges[at:stop]]
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)
                at = stop

    placed = captures.select("folder", "file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, shape)


def surts(urls: DataFrame) -> DataFrame:
    """A ``surt`` column for a ``url`` column."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([surt(u) for u in tx.column(batch, "url")], pa.string())], ["surt"])

    return urls.select("url").mapInArrow(convert, "surt string")


def archive_and_read(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write an archive of pages, find every page's captures through the index, and
    read the records back."""
    archive = write_archive(pages, least)
    return read_records(keep(lookup(surts(pages), archive)))
