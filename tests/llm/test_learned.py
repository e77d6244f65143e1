"""Toxicity, quality and language: held-out accuracy, folds, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from filelens.llm import labels as lb
from filelens.llm import language, quality, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    y = np.array(labels) == 1
    return (order[y].mean() - order[~y].mean()) / len(y) + 0.5


def test_folds_and_samples(spark):
    docs = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in docs.select("doc_id", lb.held_out()).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)} | {None: True}
    given = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(3, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    sample = lb.labelled_sample(given, "toxic", 20).collect()
    assert len(sample) == 20 == len({r.doc_id for r in sample}) and not any(got[r.doc_id] for r in sample)


def test_logistic_curve():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w = lb.fit_logistic(x, np.array([0, 0, 1, 1.0]), 0.01)
    assert w[0] > 1 and lb.sigmoid(x @ w[:1] + w[1]).round().tolist() == [0, 0, 1, 1]
    assert lb.fit_logistic(x, np.zeros(4))[-1] < 0


@pytest.fixture(scope="module")
def corpus(spark):
    """Invented words; toxic rows hold one of three, sometimes disguised; poor rows
    repeat themselves."""
    draw = np.random.default_rng(1)
    words = ["".join(draw.choice(list("aeioulmnrst"), draw.integers(2, 8))) for _ in range(400)]
    bad, sly = ["villain", "scoundrel", "wretched"], ["v1llain", "sc0undre1", "wr3tch3d", "v i l l a i n", "wretcheeeed"]
    rows = []
    for i in range(900):
        text, poor, toxic = [str(w) for w in draw.choice(words, 60)], draw.random() < 0.3, draw.random() < 0.3
        if poor:
            text = [w for w in text[:6] for _ in range(12)]
        if toxic:
            text[draw.integers(len(text))] = str(draw.choice(sly if i % 4 == 0 and i > 400 else bad))
        rows.append((i, " ".join(text), int(not poor), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2], r[3], "clash") for r in rows], LABELS), {r[0]: r for r in rows}


def test_toxicity_on_held_out_rows(corpus):
    docs, labels, rows = corpus
    got = toxicity.score(docs, toxicity.fit(docs, labels)).where("held_out").collect()
    truth = [rows[r.doc_id][3] for r in got]
    assert len(got) > 100 and auc([r.score for r in got], truth) > 0.95
    assert np.mean([r.predicted == t for r, t in zip(got, truth, strict=True)]) > 0.95


def test_restoring():
    words = ["villain", "scoundrel", "wretched", "little", "noon"] * 50
    counts = np.zeros(toxicity.SYMBOLS**3)
    for w in words:
        s = toxicity._symbols(f" {w} ")
        np.add.at(counts, s[:-2] * 4096 + s[1:-1] * 64 + s[2:], 1)
    reader = toxicity.Reader(toxicity.log_model(counts.reshape((toxicity.SYMBOLS,) * 3)))
    for sly, word in [("v1ll4in!", "villain"), ("s.c.o.u.n.d.r.e.l", "scoundrel"), ("wreeeetched", "wretched"), ("n00n", "noon")]:
        assert word in reader.words(f"so {sly} it is")
    assert reader.words("plain little words") == {"plain", "little", "words"} and reader.words(None) == set()


def spoken(*words):
    """A reader whose character model has seen these words."""
    counts = np.zeros(toxicity.SYMBOLS**3)
    s = toxicity._symbols(" " + " ".join(words) + " ")
    np.add.at(counts, s[:-2] * 4096 + s[1:-1] * 64 + s[2:], 50)
    return toxicity.Reader(toxicity.log_model(counts.reshape((toxicity.SYMBOLS,) * 3)))


def test_runs_of_set_apart_letters_are_read_to_their_end_as_words():
    reader = spoken("you", "are", "an", "old", "villain", "you", "old")
    assert {"you", "are", "an", "old", "villain"} <= reader.words(" ".join("youareanoldvillain"))
    assert "villain" in reader.words(" ".join("youareold" * 60 + "villain"))
    assert "villain" in reader.words("yooou" * 60 + "v1llain" * 2 + " v.i.l.l.a.i.n")
    assert {"old", "villain"} <= set(toxicity.restore("old/" * 5_000 + "v1llain", reader.model, reader.slack))


def test_disguises_of_every_length_share_of_signs_and_gap_are_read():
    reader = spoken("shit", "idiot", "ass", "asshole", "so", "is", "it", "old", "villain", "to", "see")
    for sly, word in [
        ("5h17", "shit"), ("4$$h0l3", "asshole"), ("$ h 1 t", "shit"), ("i d 1 o t", "idiot"), ("a s s", "ass"), ("@$$", "ass"),
        ("i  d  i  o  t", "idiot"), ("i/d/i/o/t", "idiot"), ("!diot", "idiot"), ("old.villain/to.old/v1ll4in.to.see", "villain"),
        ("is.it.old/so.1d10t/to.see.it", "idiot"),
    ]:
        assert word in reader.words(f"so, {sly} so") - reader.words(f"so {sly[:0]} so"), sly
        assert any(word in made for made in reader.memo.values()), sly
        reader.memo.clear()
    assert reader.words("2024 $455.00 12:30 (5) *** 3+4 so") == {"so"}
    assert toxicity.disguised("x" * 100_000 + " . " * 100_000) == ["x" * 100_000]


def test_quality_on_held_out_rows(corpus):
    docs, labels, rows = corpus
    got = quality.score(docs, quality.fit(docs, labels)).where("held_out").collect()
    assert auc([r.score for r in got], [rows[r.doc_id][2] for r in got]) > 0.95


def test_chunks_cover_all_bytes():
    for n in (0, 1, 511, 512, 513, 960, 961, 200_000):
        block, match = quality.chunks("ab" * (n // 2) + "c" * (n % 2))
        assert block.shape[1] == quality.CHUNK and len(match) == len(block)
        assert (len(block) - 1) * quality.STEP + quality.CHUNK >= n > (len(block) - 2) * quality.STEP + quality.CHUNK or n <= quality.CHUNK
    assert quality.chunks("abcabc" * 300)[1].min() > 0.95 > 0.5 > quality.chunks("".join(map(chr, range(32, 127))) * 5)[1].max()


def test_answers_equal_plain_convolution():
    net, block = quality.Network.new(), quality.chunks("some text, any text. " * 60)[0]
    made = net.answers(block)
    for place in (0, 7, quality.PLACES - 1):
        window = net.embed[block[:, place * quality.STRIDE : place * quality.STRIDE + quality.WIDTH]].reshape(len(block), -1)
        assert np.allclose(made[:, place], window @ net.filters, atol=1e-4)


def test_languages_of_given_documents(given):
    docs = given("documents")
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).where("held_out").collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.lang_pred == truth[i] for i, r in got.items()]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_vectors_see_whole_texts():
    assert np.allclose(language.vector("hello world"), language.vector("HELLO,  world"), atol=1e-6)
    assert not np.allclose(language.vector("a" * 3_000_000 + " zzzz"), language.vector("a" * 3_000_000), atol=1e-9)


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(i, i % 2, (i + 1) % 2, "t") for i in range(1, 15)] + [(5, None, 7, None)], LABELS)
    for labels in (none, some):
        for docs in (odd_docs, no_docs):
            for rows in (toxicity.score(docs, toxicity.fit(docs, labels)), quality.score(docs, quality.fit(docs, labels))):
                rows = rows.collect()
                assert len(rows) == docs.count()
                assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    kept = toxicity.keep_clean(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    rows = language.predict(odd_docs, language.fit(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and {r.lang_pred for r in rows} == {"und"}
    trained = language.fit(odd_docs.withColumn("lang", language.F.lit("en")))
    of = {r.doc_id: r.lang_pred for r in language.predict(odd_docs, trained).collect()}
    assert of[1] == of[2] == of[3] == "und" and of[4] == of[12] == "en"
    assert language.predict(no_docs, trained).collect() == []


def test_texts_of_numerals_have_no_language(spark):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "fr") for i, t in enumerate(["the cat is here", "le chat est ici"] * 20)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "½"), (2, "²³ Ⅷ 12"), (3, "_"), (4, "é")], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language.predict(odd, language.fit(docs)).collect()}
    assert [found[i] == "und" for i in (1, 2, 3, 4)] == [True, True, True, False]


def test_disguised_parts_are_found_where_the_patterns_find_them():
    """Code points are told apart by a table; only a letter or sign that stands alone is tried."""
    prose = "there is a word or two set apart, and nothing else here"
    assert len(toxicity._apart_from(toxicity.kinds_of(prose)[1])) == 1
    signs = list("aabb\u00e9 \u3000.-_/$@*10392|\u00df\u00b2\u00b2\u00aa\ufb01\u4e2d\u0661\U0001d4d0\U0001f600\ud800,;!\t\n\u20ac(<")
    chance = random.Random(5)
    for _ in range(3_000):
        text = "".join(c * chance.choice((1, 1, 3)) for c in chance.choices(signs, k=chance.randrange(30))).lower()
        points, kinds = toxicity.kinds_of(text)
        assert toxicity.words_of(points, kinds) == set(toxicity.WORD.findall(text))
        apart = [m[0] for m in toxicity.SET_APART.finditer(text)]
        apart = [part for part in apart if toxicity.LETTER.search(part) or "@" in part or "$" in part]
        assert toxicity.disguised(text)[: len(apart)] == apart
    assert toxicity.words_of(*toxicity.kinds_of("ab " * 400_000 + "c" * 2_000_000)) == {"ab", "c" * 2_000_000}


def test_a_word_is_weighed_once():
    heavy = toxicity.hashed("^vill")
    scorer = toxicity.Scorer(toxicity.Model(np.zeros((toxicity.SYMBOLS,) * 3), {heavy: 3.0}, np.zeros(4)))
    asked, weigh = [], scorer.weigh
    scorer.weigh = lambda word: asked.append(word) or weigh(word)
    first = scorer.measures("a villain and a village")
    assert first == scorer.measures("a village and a villain") == (3.0, np.log1p(2), np.log1p(6.0))
    assert sorted(asked) == ["a", "and", "village", "villain"]
