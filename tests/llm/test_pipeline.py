"""The pipeline against its stages done by hand, and the registered queries."""

from __future__ import annotations

import os
import re

import pytest

import corpus_pipeline
from filelens.llm import queries
from .conftest import SF_DIR
from .test_jaccard import brute
from .test_packing import check
from .test_secrets import brute as secret_spans

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")


def test_each_stage_on_its_own_input(spark, given):
    docs, labels = given("documents"), {r.doc_id: r.toxic for r in given("labels").collect()}
    columns = docs.columns
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(docs.collect())
        docs = corpus_pipeline.keep(stage(spark, docs, SF_DIR))
        assert docs.columns == columns
    seen.append(docs.collect())
    ids = [{r.doc_id for r in rows} for rows in seen]
    assert len(corpus_pipeline.STAGES) == 5
    # Toxicity: hardly any clean document went (accuracy is tested elsewhere; here
    # there are too few labels to learn from).
    gone = ids[0] - ids[1]
    clean = {d for d, t in labels.items() if t == 0}
    assert len(gone & clean) <= 0.03 * len(clean)
    # One of each component stays.
    of = brute([(r.doc_id, r.text) for r in seen[1]], 5, 80)
    assert ids[2] == {d for d, (_, component) in of.items() if component == d}
    # No item stays whole.
    items = [r.text for r in given("benchmark").collect()]
    assert ids[3] == {r.doc_id for r in seen[2] if not any(i in r.text for i in items)}
    # Secrets are masked, other text stays.
    before = {r.doc_id: r for r in seen[3]}
    for r in seen[4]:
        assert not secret_spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id].text) == (not secret_spans(before[r.doc_id].text))
    assert ids[4] == ids[3]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    check(rows, [(r.doc_id, r.text) for r in seen[4]], 2048)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_each_stage_alone_asks_for_small_batches(spark, given, name, stage):
    """The stages are also run one by one, and executors keep what a large batch took."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(rows)
    stage(spark, given("documents").limit(20), SF_DIR)
    assert int(spark.conf.get(rows)) == corpus_pipeline.BATCH_ROWS


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_matches_its_sql(spark, key):
    from parity.check import _rows, connect

    frame = queries.QUERIES[key](spark, SF_DIR)
    result = connect(SF_DIR).execute(queries.ORACLE[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert _rows(frame.columns, [tuple(r) for r in frame.collect()]) == _rows(names, result.fetchall())


def test_every_operator_has_one_query():
    numbers = [int(m[1]) for k in queries.QUERIES if (m := re.match(r"op(\d+)_", k))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in queries.QUERIES
