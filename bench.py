"""Headline queries over the given tables; prints one JSON line.

``ingest`` derives the inventory from the tables and is timed on its own; every
other query reads the inventory (and the analysis, plan or snapshot it follows) as
a stage reads the artifact of the one before.
"""

from __future__ import annotations

import json
import os
import time

from filelens.session import local_session
from parity import tables
from parity.queries import QUERIES, Given, applied, combined_plan

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "objects",
    "size_buckets",
    "readable_candidates",
    "settled",
    "settled_by_ends",
    "exact_groups",
    "candidate_groups",
    "group_members",
    "findings",
    "survey_totals",
    "survey_kinds",
    "survey_folders",
    "survey_top_folders",
    "survey_largest",
    "inventory_reclaimable",
    "compare_coverage",
    "compare_exclusive",
    "owner_of_root",
    "keep_oldest",
    "quarantine_operations",
    "plan_ordered",
    "edits_applied",
    "preflight_metadata",
    "preflight_content",
    "apply_steps",
    "undo_state",
    "inventory_diff",
)


def main() -> None:
    spark = local_session(CPUS, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    given = Given(spark, SF_DIR)
    queries: dict[str, float] = {}

    def timed(name, work) -> None:
        began = time.perf_counter()
        work()
        queries[name] = round(time.perf_counter() - began, 3)

    timed("ingest", lambda: tables.entries(spark, SF_DIR))
    timed("analyze", lambda: tables.analysis(spark, SF_DIR))
    timed("observe", lambda: tables.observed(spark, SF_DIR))
    timed("plan", lambda: combined_plan(given))
    timed("apply", lambda: applied(given))
    for name in HEADLINE:
        timed(name, lambda name=name: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())

    entries = tables.entries(spark, SF_DIR)
    count = entries.count()
    files = entries.where("kind = 'file'").selectExpr("sum(logical_size)").first()[0]
    read = tables.settled(spark, SF_DIR).join(entries, "entry_id").selectExpr("sum(logical_size)")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": SF_DIR.rpartition("sf")[2],
                "entries": count,
                "entries_per_sec": {
                    q: round(count / queries[q]) for q in ("objects", "exact_groups", "survey_folders")
                },
                "bytes_digested_share": round((read.first()[0] or 0) / max(files or 1, 1), 4),
            }
        )
    )


if __name__ == "__main__":
    main()
