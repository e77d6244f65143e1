"""Every registered query against its SQL over the smallest given tables."""

from __future__ import annotations

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def db():
    from parity.check import connect

    return connect(SF_DIR)


def registered():
    from parity.queries import QUERIES

    return list(QUERIES)


@pytest.mark.parametrize("key", registered())
def test_matches_its_sql(spark, db, key):
    from parity.check import compare

    verdict, note = compare(spark, db, key, SF_DIR)
    assert verdict in ("ok", "rows-only"), note


def test_the_entry_query_answers(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == [
        "logical_size", "digest", "objects", "names", "first_entry", "reclaimable_bytes"
    ]
    assert set(contract.oracle_sql()) <= set(contract.queries())
