from __future__ import annotations

import random
import re

import pytest

from filelens.llm import pii

TEXT = (
    "call +1 (262) 555-3752, ip 42.144.35.254!! bosbt.42@mail8.example.com 4041894974608795 4337166598464399 2024-02-29 "
    "31/12/1999 5.3.2001 32/01/2000 123-45-6789 000-12-3456 DE89370400440532013000 4.0. 4111 1111 1111 1111. 12/25/2020 300.1.1.1"
)


def test_what_is_valid_is_replaced_within_its_format():
    new, counts = pii.Pseudonyms().text(TEXT)
    assert counts == {"mail": 1, "iban": 1, "card": 3, "phone": 1, "ssn": 1, "date": 4, "ip": 1}
    assert re.sub(r"[0-9]", "9", re.sub(r"\d+\.\d+\.\d+\.\d+|\S+@", "", new)) == re.sub(r"[0-9]", "9", re.sub(r"\d+\.\d+\.\d+\.\d+|\S+@", "", TEXT))
    for alone in ("32/01/2000", "000-12-3456", "4.0.", "300.1.1.1"):
        assert alone in new
    for private in ("262", "42.144.35.254", "bosbt.42", "2024-02-29", "31/12/1999", "123-45-6789", "4111 1111"):
        assert private not in new
    assert pii.Pseudonyms().text(new)[1] == counts  # still valid


def test_pseudonyms_can_be_undone_with_the_key_only():
    new, _ = pii.Pseudonyms(b"k").text(TEXT)
    assert pii.Pseudonyms(b"k", back=True).text(new)[0] == TEXT
    assert pii.Pseudonyms(b"other", back=True).text(new)[0] != TEXT


@pytest.mark.parametrize("size", [1, 2, 10, 97, 1000])
def test_the_network_permutes(size):
    network = pii.Feistel(b"k")
    images = [network.permute(v, size, "t") for v in range(size)]
    assert sorted(images) == list(range(size))
    assert [network.permute(v, size, "t", back=True) for v in images] == list(range(size))


def test_cards_stay_valid_and_distinct():
    draw, network, seen = random.Random(2), pii.Feistel(), {}
    for _ in range(500):
        body = "4" + "".join(draw.choice("0123456789") for _ in range(14))
        number = body + str(-pii._luhn_sum(body + "0") % 10)
        seen[number] = pii.card(number, network)
        assert pii.luhn(seen[number]) and seen[number][0] == "4"
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(
    "number, around",
    [("4111111111111111", a) for a in ("card {} 12/25", "{} 123", "5 {}", "No.{}", "{} 4111111111111112 7", "{} 2024-02-29", "1 22 {} 123-45-6789")]
    + [("4111 1111 1111 1111", a) for a in ("{} 123", "{} 12/25", "9 {} 1225", "{}")]
    + [("AT61 1904 3002 3457 3201", a) for a in ("{} BIC", "{} EUR 100", "REF AB12 {}")]
    + [("AT611904300234573201", a) for a in ("{} USD", "{}")],
)
def test_numbers_beside_other_groups_are_replaced_and_restored(number, around):
    for key in (b"a", b"b", b"c", b"d", b"e", b"f"):
        text = around.format(number)
        new, counts = pii.Pseudonyms(key).text(text)
        assert number not in new and counts["card"] + counts["iban"] == 1
        assert len(new) == len(text) and pii.Pseudonyms(key, back=True).text(new) == (text, counts)


def test_tables(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "a 4111111111111111"), (2, "b 4111111111111111 c"), (2, "b 4111111111111111 c"), (3, None), (None, "")], "doc_id long, text string")
    rows = pii.report(docs).collect()
    assert len(rows) == 5 and sum(r.n_card for r in rows) == 3
    made = {re.sub(r"\D", "", r.text) for r in rows if r.text}
    assert len(made) == 1 and made != {"4111111111111111"}
    kept = pii.pseudonymise(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, odd_docs.collect()))
    assert pii.report(no_docs).collect() == []
