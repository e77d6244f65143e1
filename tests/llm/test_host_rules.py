from __future__ import annotations

import re

from filelens.llm import host_rules


def brute(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(words) < 2000 else set()
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(odd_docs):
    given = {(r.doc_id, r.text) for r in odd_docs.collect()}
    by_id = {i: brute(t) for i, t in given}
    rows = host_rules.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == by_id[r.doc_id]
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])


def test_overlapping_and_touching_repeats(spark):
    texts = ["a b c d e f a b c d e g a b c d e", "x " * 40, "a b c d e a b c d e", "a#b |$ x"]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in host_rules.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good, "fine") for i in range(40)]
    rows += [(100 + i, "too short" if i < 38 else good, "bad") for i in range(40)]
    rows += [(200, good, None), (201, good, "tiny")]
    kept = {r.doc_id: r.kept for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(40))
    assert kept[200] and kept[201]


def test_empty_table(no_docs):
    assert host_rules.judge(no_docs).collect() == []
