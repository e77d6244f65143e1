from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from filelens.llm import variants


def one_edit(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    if len(a) == len(b):
        return a != b and a[at + 1 :] == b[at + 1 :]
    return len(b) == len(a) + 1 and a[at:] == b[at + 1 :]


def brute(rows):
    """Every row of the contract by comparing all pairs of words."""
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    near = {w: sorted((x for x in words if one_edit(w, x)), key=lambda x: (-words[x], x)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= 10 * words[w] else None for w in words}
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def rows_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def crowded(seed: int):
    """Few letters, so that most words have many near ones, at every place and length."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(5, 10))) for _ in range(250)]
    for i in range(30):  # neighbours of the words that are used most
        at = draw.randrange(len(words[i % 10]))
        words.append(words[i % 10][:at] + draw.choice(["", "a", "éb"]) + words[i % 10][at + 1 :])
    rows = []
    for doc in range(60):
        held = draw.choices(words, [40 if i < 10 else 1 for i in range(len(words))], k=120)
        rows.append((doc, draw.choice(" .-1").join(w.upper() if draw.random() < 0.1 else w for w in held)))
    return rows


@pytest.mark.parametrize("seed,most", [(1, variants.GROUP), (2, 12), (3, 2)])
def test_equals_all_pairs(spark, seed, most):
    rows = crowded(seed)
    want = brute(rows)
    assert max(n for *_, n, _ in want.values()) >= 5 and any(f for f, *_ in want.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(variants.variants(docs, most)) == want


def test_chains_of_forms_reach_their_root(spark):
    text = " ".join(["abcdefg"] * 3000 + ["abcdefgh"] * 250 + ["abcdefghi"] * 20 + ["abcdefghij"] * 2)
    rows = [(doc, text) for doc in range(40)]
    want = brute(rows)
    assert want["abcdefghij"][:2] == ("abcdefghi", "abcdefg")
    assert rows_of(variants.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_no_pair_is_in_two_groups(spark):
    words = sorted({w for _, t in crowded(5) for w in re.findall("[a-zé]{7,}", t)})
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    held = {}
    for row in variants.groups(frame, 10).collect():
        held.setdefault(row.key, []).append((row.word, row.n, row.base, row.lo, row.hi, row.core))
    found = Counter()
    for members in held.values():
        found.update({word: near for word, near, *_ in variants.near_in_group(members)})
    assert found == Counter({w: k for w in words if (k := sum(one_edit(w, x) for x in words))})


def test_odd_rows(spark, odd_docs, no_docs):
    frame = variants.variants(odd_docs)
    assert rows_of(frame) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variants.variants(no_docs).count() == 0


def test_query_equals_its_sql(spark, given):
    from filelens.llm.queries import ORACLE, QUERIES
    from parity.check import _rows, connect
    from tests.llm.conftest import SF_DIR

    frame = QUERIES["op13_bit_sliced_variants"](spark, SF_DIR)
    result = connect(SF_DIR).execute(ORACLE["op13_bit_sliced_variants"])
    names = [d[0] for d in result.description]
    assert _rows(frame.columns, [tuple(r) for r in frame.collect()]) == _rows(names, result.fetchall())
