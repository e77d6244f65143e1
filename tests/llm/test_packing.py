from __future__ import annotations

import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from filelens.llm import packing


@cache
def reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def reference_ids(text: str | None) -> list[int]:
    return reference_tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, texts, capacity):
    """Pieces are the documents' ids, sequences are gapless and within bounds."""
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece), []).append(r)
    for doc, text in texts:
        ids = reference_ids(text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            row = got[doc, piece].pop()
            assert (row.start, row.length) == (start, len(part))
            assert row.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert not any(got.values())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_given_documents(given):
    docs = given("documents")
    rows = packing.pack(docs).collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, 64).collect()
    check(rows, [(r.doc_id, r.text) for r in odd_docs.collect()], 64)
    assert packing.pack(no_docs).collect() == []


def test_word_by_word_equals_whole_texts():
    draw = random.Random(5)
    letters = "aAzZ0 9'.,;<|>\n\t%*&-_½éÉİΣςß日本\u0301\xa0\u200b'sstd'll\U0001f600endoftext"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    texts += ["It's  I'LL\n\tgo, now... \u0085x<|endoftext|>.y", "İΣ ΑΣ, été! a!!, <|STARTOFTEXT|>", "日本語。テスト 12345", ""]
    for text, ids in zip(texts, packing.token_ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference_ids(text)[:-1]


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_exactly_what_there_is(seed):
    draw = random.Random(seed)
    lengths = [draw.choice([2048, draw.randint(1, 60), draw.randint(200, 700), draw.randint(700, 2047)]) for _ in range(3000)]
    counts = Counter(lengths)
    runs = packing.plan(dict(counts), 2048)
    held = Counter()
    for times, own in runs:
        assert times > 0 and sum(own) <= 2048
        for length in own:
            held[length] += times
    assert held == counts
    assert sum(t for t, _ in runs) <= 1.06 * sum(lengths) / 2048 + 1


def test_the_grouped_plan_is_as_good_as_plain_best_fit(given):
    """On the given documents, and on a thousand times as many."""
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = given("documents").sparkSession.read.parquet(f"{sf_dir}/documents.parquet")
        counts = {r[0]: r[1] for r in packing.pieces(docs).groupBy("length").count().collect()}
        tokens = sum(n * c for n, c in counts.items())
        used = sum(t for t, _ in packing.plan(counts))
        assert used <= sum(t for t, _ in packing.best_fit(counts, [], 2048))
        assert used <= 1.01 * tokens / 2048 + 1
        many = sum(t for t, _ in packing.plan({n: 1000 * c for n, c in counts.items()}))
        assert many <= 1.01 * 1000 * tokens / 2048


def test_configurations_hold_most_long_pieces():
    draw = random.Random(3)
    long = Counter(draw.randint(513, 2047) for _ in range(5000))
    left = dict(long)
    sizes = [g[0][0] for g in packing.groups_of_equal_size(long, 40)]
    made = packing.configurations(sizes, [len(long) and 125] * len(sizes), 2048)
    runs = packing.substituted(left, sizes, [(m, int(t)) for m, t in made if t >= 1], 2048)
    assert sum(left.values()) < 0.05 * 5000
    assert sum(t * len(lengths) for t, lengths in runs) + sum(left.values()) == 5000


def test_large_counts_make_small_plans():
    counts = {n: 10**9 + n for n in range(1, 2049)}
    runs = packing.plan(counts, 2048)
    assert len(runs) < 30_000 and sum(t for t, _ in runs) <= 1.04 * sum(n * c for n, c in counts.items()) / 2048


def test_configurations_reach_the_optimum():
    # 3 x 600 + 248 free, 2 x 900, 900 + 600 ...: a third of the 600s in each bin.
    made = packing.configurations([900, 600], [300, 300], 2048)
    assert sum(times for _, times in made) == pytest.approx(250, abs=1)


def test_groups_have_equal_cardinality():
    groups = packing.groups_of_equal_size({10: 7, 9: 1, 5: 4}, 4)
    assert [sum(n for _, n in g) for g in groups] == [3, 3, 3, 3] and groups[0] == [[10, 3]]


def test_a_worker_encodes_a_bounded_stretch_at_a_time():
    sizes = [10, 0, 400_000, 99_990, 300_000, 2_000_000, 5, 0]
    found = list(packing.stretches(["x" * n for n in sizes]))
    assert [i for at, end in found for i in range(at, end)] == list(range(len(sizes)))
    assert all(end == at + 1 or sum(sizes[at:end]) < 500_000 for at, end in found)
    assert not list(packing.stretches([]))
