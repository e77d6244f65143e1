from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from filelens.llm import collocations


def brute(rows, least, top=2000):
    """The contract in plain Python: every phrase of every piece."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        frequent = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        hidden = {q[i : i + k] for q, a in frequent.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
                  if 100 * a >= 100 * count[q[i : i + k]]}
        found = []
        for p, a in frequent.items():
            if p not in hidden:
                cuts = [(1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed: int, docs: int = 150):
    draw = random.Random(seed)
    words = ["of", "the", "à", "x" * 30, "\x01", "日本", *("abcdefghijkl")]
    passage = [draw.choice(words) for _ in range(12)]
    rows = []
    for _ in range(docs):
        held = []
        for _ in range(draw.randint(0, 60)):
            held += passage if draw.random() < 0.03 else [draw.choice(words).upper() if draw.random() < 0.1 else draw.choice(words)]
            if draw.random() < 0.1:
                held[-1] += draw.choice(".,;:!?\n\r\x0b")
        text = "".join(w + draw.choice([" ", " ", "\t ", "  "]) for w in held)
        rows.append((text, draw.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("seed,least,task", [(1, 20, 1_000_000), (2, 5, 50), (3, 5, 7), (4, 2, 400)])
def test_equals_plain_counting(spark, monkeypatch, seed, least, task):
    """Small tasks, so that runs go over the ends of ranges."""
    monkeypatch.setattr(collocations, "RANGE", task)
    monkeypatch.setattr(collocations, "SAMPLED_EVERY", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = brute(rows, least)
    assert len(want) > 20
    assert rows_of(collocations.collocations(docs, least)) == want


def test_small_blocks_and_full_filters_change_nothing(spark, monkeypatch):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(collocations, "BLOCK", 200)
    monkeypatch.setattr(collocations, "filter_of", lambda *_: np.full((1 << collocations.FILTER_BITS) // 8, 255, np.uint8))
    assert rows_of(collocations.collocations(docs, 5, 30)) == brute(rows, 5, 30)


def test_packed_suffixes_come_back():
    words = ["a", "b", "ß", "日本"]
    columns = [np.array(c) for c in ([0, 1, 3], [1, 1, 3], [-1, 3, 3], [-1, -1, 0], [-1, -1, -1])]
    n = np.array([1, 70_000, 3])
    count, *parts = collocations.packed(words, columns, n)
    own, numbers = collocations.unpacked(*parts)
    assert count == 3 and numbers[-1].tolist() == n.tolist()
    spelled = [[own[i] if i >= 0 else None for i in row] for row in numbers[:-1].T.tolist()]
    assert spelled == [["a", "b", None, None, None], ["b", "b", "日本", None, None], ["日本", "日本", "日本", "a", None]]


def test_quicksort_counts_equal_runs():
    draw = np.random.default_rng(1)
    rows = draw.integers(-1, 4, (3000, 4))
    for at in range(1, 4):  # nothing follows the end of a row
        rows[rows[:, at - 1] < 0, at] = -1
    weights = draw.integers(1, 5, 3000)
    want = Counter()
    for row, weight in zip(rows.tolist(), weights.tolist(), strict=True):
        for depth in range(1, 5):
            if row[depth - 1] >= 0:
                want[tuple(row[:depth])] += weight
    columns = [rows[:, i] for i in range(4)]
    for least in (1, 50, 10_000):
        got = [(tuple(rows[r, :d].tolist()), n) for d, r, n in collocations.quicksort_counts(columns, weights, least)]
        assert sorted(got) == sorted((k, n) for k, n in want.items() if n >= least)


def test_scores_beyond_64_bits_are_exact(spark):
    a, l, r, n = 9_123_456_789_012, 99_999_999_999_977, 88_888_888_888_889, 9_876_543_210_987_654
    phrases = spark.createDataFrame([("en", "p q", 2, a)], "lang string, phrase string, words int, a long")
    words = spark.createDataFrame([("en", "p", l), ("en", "q", r)], "lang string, word string, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    assert collocations.scored(phrases, words, totals).first().score == 1000 * a * n // (l * r)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    assert rows_of(collocations.collocations(odd_docs, 3)) == brute(rows, 3)
    empty = collocations.collocations(no_docs)
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0


def test_query_equals_its_sql(spark, given):
    from filelens.llm.queries import ORACLE, QUERIES
    from parity.check import _rows, connect
    from tests.llm.conftest import SF_DIR

    frame = QUERIES["op11_suffix_collocations"](spark, SF_DIR)
    result = connect(SF_DIR).execute(ORACLE["op11_suffix_collocations"])
    names = [d[0] for d in result.description]
    assert _rows(frame.columns, [tuple(r) for r in frame.collect()]) == _rows(names, result.fetchall())
