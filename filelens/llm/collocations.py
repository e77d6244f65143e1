"""Phrases of two to five words that occur together more often than by chance.

Words are counted first. A task then turns its texts into suffixes: at every word the
next five words of the piece, ended before a word that is too rare to be part of a
frequent phrase (a filter of fixed size made from all counts tells; it lets too much
through, never too little), equal suffixes of a block counted as one. The suffixes
are routed globally by their leading words, in ranges, so that a common word spreads over
as many tasks as its suffixes need; a bounded sample of suffixes says where ranges end,
which only decides how evenly they fill. Suffixes travel packed, those of a block and a
range in one row. Pointers to the suffixes of a range are sorted by multikey three-way
quicksort down to five words: the size of an equal partition is the count of
the phrase it stands for, and a partition that is too small is abandoned. Only phrases
that reach over the end of a range are counted in parts, which are added up.

Phrases that are part of a longer one as frequent are dropped; the others are scored at
their weakest cut, in exact decimal arithmetic.

Rows: null and empty texts have no words, a null ``lang`` is ``und``, repeated rows count
again, ties are broken by the phrase, other columns are ignored, an empty table gives an
empty result. A piece may be as long as it likes: blocks end where pieces end.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm import text as tx
from filelens.operators.scale import number_within
from filelens.session import keep

LONGEST = 5
LEAST = 100  # occurrences of a phrase
TOP = 2000  # phrases reported for each language
BLOCK = 2 << 20  # bytes of one language that are looked at together
HELD = 8 << 20  # bytes that wait for their block to fill, over all languages
FILTER_BITS = 26  # the filter is 8 MB
RANGE = 500_000  # suffixes of a range, about
SAMPLED_TEXTS, SAMPLED_EVERY, SAMPLED = 20_000, 64, 50_000  # texts, every so many of their suffixes, and suffixes at most

_STOPS = np.zeros(256, bool)
_STOPS[[*map(ord, ".,;:!?"), *range(10, 14)]] = True
_BETWEEN = _STOPS.copy()
_BETWEEN[[32, 9]] = True
Suffix = tuple[str, ...]  # the language and the words, "" after the end


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """Lower-cased bytes of one language; texts are set apart by the end of a piece."""
    waiting: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    stop = np.array([10], np.uint8)

    def ready(lang: str) -> tuple[str, np.ndarray]:
        sizes.pop(lang)
        return lang, tx.LOWER[np.concatenate(waiting.pop(lang))]

    for batch in batches:
        for text, lang in zip(tx.column(batch, "text"), tx.column(batch, "lang"), strict=True):
            for part in tx.blocks((text or "").encode("utf-8", "surrogatepass"), _STOPS):
                waiting.setdefault(lang, []).extend((part, stop))
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                if sizes[lang] > BLOCK:
                    yield ready(lang)
            if sum(sizes.values()) > HELD:
                yield ready(max(sizes, key=sizes.get))
    for lang in list(waiting):
        yield ready(lang)


def words_of(block: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of a block as numbers into its distinct words, and for each whether the
    next one follows it in the same piece."""
    inside = ~_BETWEEN[block]
    starts, ends = tx.edges(inside)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    spelled = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(block[inside])])
    coded = spelled.dictionary_encode()
    stops = np.zeros(len(block) + 1, np.int32)
    np.cumsum(_STOPS[block], out=stops[1:])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = stops[starts[1:]] == stops[starts[:-1]]
    return coded.indices.to_numpy(), coded.dictionary, joined


def _hashes(lang: str, spelled: pa.Array) -> np.ndarray:
    """A hash of each word in its language."""
    _, offsets, data = spelled.buffers()
    at = np.frombuffer(offsets, np.int32)[spelled.offset : spelled.offset + len(spelled) + 1]
    found = tx.run_hashes(np.frombuffer(data, np.uint8), at[:-1], at[1:])
    return tx.mix(found ^ np.uint64(zlib.crc32(lang.encode("utf-8", "surrogatepass"))))


def filter_of(rows: DataFrame, place: str) -> np.ndarray:
    """A bitmap of fixed size of the places that occur, built where the rows are."""
    at = F.col(place) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part, found in parts.collect():  # 4 KB each, 8 MB at most
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(found, np.uint8)
    return bits


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, place, n): every word, and its place in a filter."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in blocks(batches):
            codes, spelled, _ = words_of(block)
            if not len(codes):
                continue
            place = _hashes(lang, spelled) >> np.uint64(64 - FILTER_BITS)
            yield pa.record_batch(
                [pa.array([lang] * len(spelled), pa.string()), spelled.cast(pa.string()), tx.signed(place),
                 pa.array(np.bincount(codes, minlength=len(spelled)))], ["lang", "word", "place", "n"])

    found = texts.mapInArrow(tx.giving_back(look), "lang string, word string, place long, n long")
    return found.groupBy("lang", "word", "place").agg(F.sum("n").alias("n"))


def _distinct_rows(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of number columns, -1 to ``size`` - 1, and how often each occurs."""
    kind = columns[0].astype(np.int64)
    for column in columns[1:]:  # after each step kinds are numbers below the rows
        kind = np.unique(kind, return_inverse=True)[1] * (size + 1) + column + 1
    _, first, n = np.unique(kind, return_index=True, return_counts=True)
    return [c[first] for c in columns], n


def suffix_table(lang: str, block: np.ndarray, frequent: np.ndarray) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """The words of a block in their order, its distinct suffixes as numbers into them
    (-1 after the end), sorted, and how often each occurs. A suffix is the words from a
    place on, two at least, as long as each may be frequent."""
    codes, spelled, joined = words_of(block)
    if len(codes):
        place = (_hashes(lang, spelled) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        good = ((frequent[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)[codes]
        joined &= good
        joined[:-1] &= good[1:]
    at = np.flatnonzero(joined)
    if not len(at):
        return [], [], np.zeros(0, np.int64)
    words = spelled.cast(pa.string()).to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    codes = rank[codes]
    columns, goes_on = [codes[at]], np.ones(len(at), bool)
    for step in range(1, LONGEST):
        goes_on &= joined[np.minimum(at + step - 1, len(codes) - 1)]
        columns.append(np.where(goes_on, codes[np.minimum(at + step, len(codes) - 1)], -1))
    columns, n = _distinct_rows(columns, len(words))
    return [words[i] for i in order], columns, n


def sampled_suffixes(texts: DataFrame, frequent: np.ndarray) -> list[Suffix]:
    """A bounded, sorted sample of suffixes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in blocks(batches):
            words, columns, _ = suffix_table(lang, block, frequent)
            picked = [(words[i] if i >= 0 else "" for i in column[::SAMPLED_EVERY].tolist()) for column in columns]
            found = [[lang, *row] for row in zip(*picked, strict=True)]
            yield pa.record_batch([pa.array(found, pa.list_(pa.string()))], ["suffix"])

    texts = texts.sample(min(1.0, SAMPLED_TEXTS / max(texts.count(), 1)), 7)
    found = texts.mapInArrow(tx.giving_back(look), "suffix array<string>")
    return sorted(tuple(r[0]) for r in found.orderBy(F.xxhash64("suffix")).limit(SAMPLED).collect())


def ends_of_ranges(sample: list[Suffix], number: int) -> list[Suffix]:
    """At most ``number`` - 1 suffixes that ranges begin with, all but the first range."""
    return sorted({sample[len(sample) * i // number] for i in range(1, number)}) if sample else []


def cuts(lang: str, words: list[str], columns: list[np.ndarray], ends: list[Suffix]) -> list[int]:
    """Where the sorted suffixes of a block are cut into ranges."""
    size, found = len(columns[0]), []
    for end in ends:
        low, high = (0, size) if end[0] == lang else (0, 0) if end[0] < lang else (size, size)
        for column, word in zip(columns, end[1:], strict=True):
            rank = bisect.bisect_left(words, word) if word else -1
            known = not word or (rank < len(words) and words[rank] == word)
            part = column[low:high]
            low, high = low + int(np.searchsorted(part, rank, "left")), low + int(np.searchsorted(part, rank, "right"))
            if not known:
                high = low
        found.append(low)
    return found


def packed(words: list[str], columns: list[np.ndarray], n: np.ndarray) -> tuple[int, bytes, int, bytes, int]:
    """Suffixes as a few bytes: their number, the words they hold, and numbers into them."""
    flat = np.stack([*columns])
    used, flat = np.unique(flat, return_inverse=True)
    held = [words[i] for i in used.tolist() if i >= 0]
    flat = flat.reshape(len(columns), -1) - (len(used) - len(held))  # -1 stays the end
    told = "\t".join(held).encode("utf-8", "surrogatepass")  # no word holds a tab
    numbers = np.concatenate([flat, n[None]]).astype("<i4")
    # Bytes of one weight side by side: most are alike.
    data = np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(n), pa.compress(told, "zstd", asbytes=True), len(told), pa.compress(data, "zstd", asbytes=True), len(data)


def unpacked(told: bytes, told_size: int, data: bytes, data_size: int) -> tuple[list[str], np.ndarray]:
    """Words, and rows of numbers: a suffix's words, and how often it occurs."""
    words = pa.decompress(told, told_size, "zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\t")
    flat = np.frombuffer(pa.decompress(data, data_size, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return words, np.ascontiguousarray(flat.T).view("<i4").reshape(LONGEST + 1, -1)


_PACKED = "range int, lang string, rows long, told binary, told_size int, data binary, data_size int"


def suffixes(texts: DataFrame, frequent: np.ndarray, ends: list[Suffix]) -> DataFrame:
    """Packed suffixes of each block and range."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in blocks(batches):
            words, columns, n = suffix_table(lang, block, frequent)
            if not len(n):
                continue
            bounds = [0, *cuts(lang, words, columns, ends), len(n)]
            rows = [
                (at, lang, *packed(words, [c[low:high] for c in columns], n[low:high]))
                for at, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)) if high > low
            ]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch(arrays, ["range", "lang", "rows", "told", "told_size", "data", "data_size"])

    return texts.mapInArrow(tx.giving_back(look), _PACKED)


def quicksort_counts(columns: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, row, count) of every run of leading numbers that weighs ``least`` or more:
    multikey three-way quicksort of pointers to rows, -1 ending a row. ``row`` is one
    that begins so, ``depth`` the numbers that count."""
    stack = [(np.arange(len(weights)), 0)]
    while stack:
        rows, depth = stack.pop()
        keys = columns[depth][rows]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less, more = keys < pivot, keys > pivot
        for side in (less, more):
            part = rows[side]
            if len(part) and weights[part].sum() >= least:
                stack.append((part, depth))
        equal = rows[~(less | more)]
        if pivot < 0:
            continue
        count = int(weights[equal].sum())
        if count >= least:
            yield depth + 1, int(equal[0]), count
            if depth + 1 < len(columns):
                stack.append((equal, depth + 1))


def range_counts(columns: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The same for one range of a longer table: runs that the first or last row of the
    range begins with may go on outside, and are told whatever they weigh."""
    edges: set[tuple[int, ...]] = set()
    for outer in (np.min, np.max):
        rows = np.arange(len(weights))
        for column in columns:
            rows = rows[column[rows] == outer(column[rows])]
        end = int(rows[0])
        same = np.ones(len(weights), bool)
        for depth, column in enumerate(columns):
            same &= column == column[end]
            if column[end] < 0:
                break
            run = tuple(int(c[end]) for c in columns[: depth + 1])
            if run not in edges:
                edges.add(run)
                yield depth + 1, int(end), int(weights[same].sum())
    for depth, row, count in quicksort_counts(columns, weights, least):
        if tuple(int(c[row]) for c in columns[:depth]) not in edges:
            yield depth, row, count


def phrases_of_range(parts: list[tuple], least: int) -> pa.RecordBatch:
    """(lang, phrase, words, a) of the packed suffixes of one range."""
    read = [(lang, *unpacked(*part)) for lang, *part in parts]
    names = sorted({lang for lang, _, _ in read})
    words = sorted({word for _, own, _ in read for word in own})
    rank = {word: i for i, word in enumerate(words)}
    stacked = []
    for lang, own, numbers in read:
        # Numbers in the order of all words; the last one, for the end, is -1.
        moved = np.array([*map(rank.__getitem__, own), -1], np.int32)
        stacked.append(np.concatenate([np.full((1, numbers.shape[1]), names.index(lang)), moved[numbers[:-1]], numbers[-1:]]))
    table = np.concatenate(stacked, axis=1)
    columns, weights = list(table[:-1].astype(np.int32)), table[-1].astype(np.int64)
    found = [f for f in range_counts(columns, weights, least) if f[0] > 2]  # language and two words
    return pa.record_batch(
        [pa.array([names[columns[0][row]] for _, row, _ in found], pa.string()),
         pa.array([" ".join(words[c[row]] for c in columns[1:depth]) for depth, row, _ in found], pa.string()),
         pa.array([depth - 1 for depth, *_ in found], pa.int32()), pa.array([n for *_, n in found], pa.int64())],
        ["lang", "phrase", "words", "a"])


def phrase_counts(routed: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, a) of the frequent phrases of two words or more, from packed
    suffixes in the order of their ranges."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("range", "lang", "told", "told_size", "data", "data_size")
        rows = (row for batch in batches for row in zip(*(tx.column(batch, c) for c in names), strict=True))
        for _, parts in groupby(rows, key=itemgetter(0)):
            yield phrases_of_range([part[1:] for part in parts], least)

    parts = routed.mapInArrow(tx.giving_back(look), "lang string, phrase string, words int, a long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases that no longer one stands for.
    ``words`` are the frequent words, ``totals`` counts all words of each language."""
    frequent = phrases.select("lang", "phrase", "a")
    frequent = frequent.unionByName(words.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))
    split = phrases.withColumn("parts", F.split("phrase", " "))
    # A longer phrase holds its first and its last words one shorter; what holds a phrase
    # two words longer and is as frequent, holds one in between that is as frequent too.
    inner = split.where("words > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice("parts", F.lit(1), F.col("words") - 1), " "),
        F.array_join(F.slice("parts", F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = split.join(longer, ["lang", "phrase"], "left").where(F.coalesce("longer", F.lit(0)) < F.col("a"))
    cuts = kept.select("lang", "phrase", "a", "parts", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(part), F.col("a").alias(count)), ["lang", part])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    # Products of up to 38 digits, and the quotient of integers: exact.
    cuts = cuts.join(totals, "lang").withColumn("top", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n"))
    cuts = cuts.withColumn("bottom", whole("l") * whole("r")).withColumn("score", F.expr("top div bottom"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's highest scored phrases."""
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    words = keep(word_counts(texts))
    common = words.where(F.col("n") >= least)
    frequent = filter_of(common, "place")
    held = common.agg(F.sum("n")).first()[0] or 0
    ends = ends_of_ranges(sampled_suffixes(texts, frequent), -(-held // RANGE)) if held > RANGE else []
    routed = suffixes(texts, frequent, ends).repartition(len(ends) + 1, "range").sortWithinPartitions("range")
    phrases = keep(phrase_counts(routed, least))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = number_within(scored(phrases, common, totals), ["lang"], order, "rank", "phrase")
    return ranked.where(F.col("rank") < top).select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
