from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from filelens.llm import jaccard


def brute(rows, width, percent):
    """Component of every id by comparing all pairs."""
    sets, up = {}, {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(width, len(words))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
        up[doc] = doc

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed: int):
    """Chains and clusters of near copies, a passage that many share, short texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 4)))
    passage = [word() for _ in range(25)]
    rows, texts = [], []
    for _ in range(90):
        if texts and draw.random() < 0.6:
            own = list(draw.choice(texts))
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                own[draw.randrange(len(own))] = word()
        else:
            own = [word() for _ in range(draw.choice([1, 2, 3, 5, 40, 80]))] + (passage if draw.random() < 0.4 else [])
        texts.append(own)
        rows.append((len(rows) * 3 + 1, " ".join(w.upper() if draw.random() < 0.1 else w for w in own)))
    return rows


@pytest.mark.parametrize("seed,width,percent,block", [(1, 3, 90, 150_000), (2, 5, 80, 150_000), (3, 3, 90, 200), (4, 2, 60, 100)])
def test_equals_all_pairs(spark, monkeypatch, seed, width, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_frequent_tokens_do_not_change_the_result(spark, monkeypatch):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "frequent_tokens", lambda *a: jaccard.np.zeros(0, "uint64"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, 3, 90).collect()}
    assert got == brute(rows, 3, 90)


def test_odd_rows(odd_docs, no_docs):
    rows = jaccard.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    of = {r.doc_id: r.component_id for r in rows}
    assert of[1] == 1 and of[2] == 2 and of[3] == 3 and of[4] == 4 and of[None] is None
    assert of[5] == of[6] == of[7] == of[8] == of[9] == 5 and of[10] == 10
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 10, 12, 13, 14, None}
    assert jaccard.near_duplicates(no_docs).collect() == [] and jaccard.keep_one(no_docs).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select((F.col("id") * 7 % 201).alias("a"), ((F.col("id") + 1) * 7 % 201).alias("b"))
    assert {r.component for r in jaccard.components(edges).collect()} == {0}
