from __future__ import annotations

import gzip
import hashlib

import pytest

from filelens.llm import warc

SHAPE = "page_id long, url string, html string, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "é<p>" * 400, "x" * 1000
    rows = [
        (1, "http://b.example.com/a", big), (5, "http://b.example.com/a", big), (3, "https://user@B.example.com:8080/a?q=1#frag", big),
        (4, None, None), (6, "not a url \t\n", ""), (7, "http://a.org", "short"), (8, "http://a.org", "short"), (9, "http://z.org/x y", other),
        (9, "http://z.org/x y", other), (None, "http://n.org/", other), (11, "http://a.org/" + "p" * 3000, "y" * 300_000),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], SHAPE)


def expected(rows):
    out = []
    payloads = [(r.page_id, (r.html or "").encode()) for r in rows]
    for page, payload in payloads:
        largest = max((p for p, other in payloads if other == payload and p is not None), default=None)
        revisit = len(payload) >= 1000 and largest is not None and page != largest
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", largest if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(pages):
    rows = warc.archive_and_read(pages).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    assert got == expected(pages.collect())


def test_payloads_come_back(pages):
    archive = warc.write_archive(pages, block_lines=2)
    assert archive.directory.count() >= 5
    rows = warc.read_records(archive.captures, with_payload=True).where("record_type = 'response'").collect()
    given = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert all(bytes(r.payload) == given[r.page_id] for r in rows)


@pytest.mark.parametrize("lines", [1, 2, 1000])
def test_lookup_finds_all_captures_of_a_key_and_no_others(spark, pages, lines):
    archive = warc.write_archive(pages, block_lines=lines)
    keys = [warc.surt(u) for u in ("http://a.org", "http://b.example.com/a", "http://z.org/x y", None)] + ["zz)", "", "com,example,b)/"]
    found = warc.lookup(spark.createDataFrame([(k,) for k in keys], "surt string"), archive).collect()
    want = sorted((warc.surt(r.url), r.page_id) for r in pages.collect() if warc.surt(r.url) in keys)
    assert sorted((r.surt, r.page_id) for r in found) == want


def test_keys_and_records():
    assert warc.surt("https://user@B.Example.com:8080/a?q=1#frag") == "com,example,b:8080)/a?q=1"
    assert warc.surt("http://a.org") == "org,a)/" and warc.surt(None) == "" and "\t" not in warc.surt("a\tb")
    member = warc.record(3, "http://a.org\r\nX: y", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert warc.parsed(member)["payload"] == b"hello" and warc.parsed(member)["page_id"] == 3
    raw = gzip.decompress(member).replace(b"hello", b"jello")
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(gzip.compress(raw))


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], SHAPE)).collect() == []
