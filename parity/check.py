"""Run registered queries against DuckDB over the same files and compare them.

``python -m parity.check [sf_dir] [name ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from filelens.session import local_session
from parity.queries import ORACLE, QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def _rows(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def compare(spark, db, key: str, sf_dir: str) -> tuple[str, str]:
    frame = QUERIES[key](spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    if key not in ORACLE:
        return "rows-only", f"{len(got)} rows"
    result = db.execute(ORACLE[key])
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return "COLUMNS", f"{sorted(frame.columns)} vs {sorted(names)}"
    mine, theirs = _rows(frame.columns, got), _rows(names, want)
    if mine == theirs:
        return "ok", f"{len(got)} rows"
    only_mine = [r for r in mine if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(mine)][:3]
    return "DIFFERS", f"{len(got)} vs {len(want)} rows; mine {only_mine}; theirs {only_theirs}"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, db = local_session(), connect(sf_dir)
    bad = 0
    for key in args or QUERIES:
        began = time.time()
        try:
            verdict, note = compare(spark, db, key, sf_dir)
        except Exception as problem:  # noqa: BLE001
            verdict, note = "ERROR", f"{type(problem).__name__}: {str(problem)[:600]}"
        bad += verdict in ("COLUMNS", "DIFFERS", "ERROR")
        print(f"{verdict:9} {key:24} {time.time() - began:6.2f}s  {note}", flush=True)
    print(f"{bad} problems", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
