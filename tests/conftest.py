"""One session for all tests, and small hand-written inventories."""

from __future__ import annotations

import hashlib
import os
import sys
from datetime import datetime, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from filelens import schema  # noqa: E402
from filelens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    # Tiny inputs: compiling each plan would take longer than running it.
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def second(value: int | None):
    return None if value is None else datetime.fromtimestamp(value, timezone.utc)


def entry(path, entry_id, size=10, **given):
    """An entry row; unnamed facts get plain values."""
    allocated = given.get("allocated", size)
    file_id = given.get("file_id")
    return (
        given.get("machine", "mac"),
        entry_id,
        path,
        None,
        given.get("kind", "file"),
        size,
        allocated,
        second(given.get("created")),
        second(given.get("modified", 1000)),
        file_id,
        1,
        given.get("target"),
        (given.get("provider"), given.get("residency", "local"), "unspecified"),
    )


def folder(path, entry_id, **given):
    return entry(path, entry_id, 0, kind="directory", **given)


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, shape=schema.ENTRY):
        return spark.createDataFrame(rows, shape)

    return make


@pytest.fixture(scope="session")
def contents(spark):
    def make(pairs):
        return spark.createDataFrame(list(pairs), "entry_id long, content string")

    return make


def rows(frame, *columns):
    """Sorted tuples of some columns."""
    return sorted(
        (tuple(r) for r in frame.select(*(columns or frame.columns)).collect()),
        key=lambda r: tuple((v is None, v if v is not None else 0) for v in r),
    )
