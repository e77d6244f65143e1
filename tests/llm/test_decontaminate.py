from __future__ import annotations

import random

from filelens.llm import decontaminate as dc

ITEM = "Alice has 5 apples and gives 3 apples to Bob. How many apples does Alice have left after 20 minutes of counting?"
SAME = "Maria has 17 apples and gives 9 apples to Tom Smith. How many apples does Maria have left after 45 hours of counting?"
MIXED = "Maria has 17 apples and gives 9 apples to Tom. How many apples does Peter have left after 45 hours of counting?"
SHAPE = "item_id long, text string, doc_id string"


def leaks(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = dc.find_leaks(docs, spark.createDataFrame([(*i, "x") for i in items], SHAPE)).collect()
    return {(r.doc_id, r.item_id): r for r in found}


def test_other_numbers_and_names_are_found_if_consistent(spark):
    filler = "some other words that come before it."
    found = leaks(spark, [ITEM, f"{filler}\n{SAME} And after.", filler, f"{filler} So {MIXED}", ITEM.upper(), None, "", ITEM[:60]])
    assert (0, 1) in found and found[0, 1].verbatim and found[0, 1].n_matched == found[0, 1].n_windows
    assert (1, 1) in found and not found[1, 1].verbatim
    assert not {2, 3, 5, 6} & {d for d, _ in found}


def test_equal_numbers_may_play_two_roles(spark):
    item = "A train goes 60 km in 2 hours and a bus goes 60 km in 5 hours, so how far apart are they after a while?"
    other = item.replace("60", "90", 1).replace("60", "70")
    found = leaks(spark, [f"Now: {other}", f"Now: {item}"], [(1, item)])
    assert set(found) == {(0, 1), (1, 1)} and not found[0, 1].verbatim and found[1, 1].verbatim


def test_documents_stay_where_an_item_of_few_words_is_found(spark):
    docs = spark.createDataFrame([(1, "yes, we can"), (2, f"so {ITEM}"), (3, "no")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Yes", "x"), (2, ITEM, "x"), (3, "7 8 9", "x")], SHAPE)
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()} == {(1, 1), (2, 2)}
    assert {r.doc_id for r in dc.keep_untouched(docs, items).collect()} == {1, 3}


def test_short_items_and_odd_items(spark):
    found = leaks(spark, ["well, what is it now then", "nothing"], [(1, "What is it?"), (2, None), (3, ""), (4, "7 8 9")])
    assert set(found) == {(0, 1)}


def test_items_of_numbers_and_names_are_found_word_for_word(spark):
    items = [(1, "12 + 35 * 4 = 188"), (2, "7 8 9"), (3, "Ann Lee, Bob Ray, Carl Fox, Dora May, Eve Orr 17, 18, 19, 20")]
    texts = [f"So it is: {items[0][1]}, they said.", "of 7 8 9 or 10", f"Seen: {items[2][1]} and more", "of 7 8 or 12 35 4 189"]
    found = leaks(spark, texts, items)
    assert set(found) == {(0, 1), (1, 2), (2, 3)} and all(r.verbatim and r.n_matched == r.n_windows for r in found.values())


def test_long_passages_of_longer_items_are_found(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    found = leaks(spark, [" ".join(words[150:250]), " ".join(words[150:170])], [(1, " ".join(words))])
    assert set(found) == {(0, 1)} and found[0, 1].n_matched == 93 and found[0, 1].n_windows == 393


def test_copies_word_for_word_do_not_depend_on_what_is_a_name(spark):
    sentences = "Every morning we walk along the river for a while. Under trees we rest and look at birds. Later we go home and eat some soup."
    heading = "In The Every Under Later End"
    items = [(1, ITEM), (2, "What is the capital of France?"), (3, sentences)]
    found = leaks(spark, [ITEM.upper(), ITEM.lower(), "(a) What is the capital of France?", f"so {heading} of it. {sentences}", "what is a capital of france"], items)
    assert set(found) == {(0, 1), (1, 1), (2, 2), (3, 3)}
    assert all(r.verbatim and r.n_matched == r.n_windows for r in found.values())


def test_templates():
    tokens, values = dc.template("It weighs 3.5 kg. Big Ben is in London, say two men")
    kinds = ["n" if t == dc._NUMBER else "u" if t == dc._UNIT else "N" if t == dc._NAME else "w" for t in tokens]
    assert "".join(kinds) == "wwnuwNwwNwnw"
    assert all((v != 0) == (k != "w") for v, k in zip(values.tolist(), kinds, strict=True))


def test_windows_equal_brute_force(spark, given):
    """Whole items put into documents are found, nothing else is."""
    docs, items = given("documents"), given("benchmark")
    texts = {r.item_id: r.text for r in items.collect()}
    inside = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in (r.text or "")}
    found = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()}
    assert inside and inside <= found
    draw = random.Random(1)
    rows = {r.doc_id: r.text for r in docs.collect()}
    for doc, item in draw.sample(sorted(found), min(10, len(found))):
        own, theirs = set(dc.template(rows[doc])[0].tolist()), set(dc.template(texts[item])[0].tolist())
        assert len(own & theirs) >= 0.3 * len(theirs)


def test_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], SHAPE)
    some = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "y"), (None, SAME, None)], SHAPE)
    assert dc.find_leaks(odd_docs, none).collect() == [] and dc.find_leaks(odd_docs, some).collect() == []
    assert dc.find_leaks(no_docs, some).collect() == []
    kept = dc.keep_untouched(odd_docs, some)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
