"""Benchmark decontamination by templates.

Texts become template tokens: numbers, names and units are replaced by typed
placeholders and keep their values aside. Windows of template tokens are hashed and
joined with those of the benchmark items. Windows that line up (same distance between
the places in document and item) must replace the item's values consistently: one
name of the item by one name of the document, and within a window one number by one
number. Windows of template tokens need some
words; beside them stand windows of plain words in lower case, without placeholders and
without any condition, so that copies word for word are found whatever they consist of
and however names in them are told. Items of which enough windows of one of both kinds
match, or that share a long passage (``LONG_RUN`` windows at one distance), are found in
the document, word for word or with other numbers and names.

A filter of fixed size built from the benchmark's windows keeps document windows that
cannot match from being shuffled; it drops none that can.

Rows: null and empty texts match nothing; items shorter than a window are one window
of their length; items without tokens match nothing; repeated rows of a document count
once; a null ``doc_id`` is reported as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm import text as tx
from filelens.session import keep

WIDTH = 8  # template tokens of a window
LEAST_WORDS = 4  # that are no placeholders
COVERED = 0.3  # share of an item's windows from which it is found
LONG_RUN = 24  # windows of an item that line up, from which it is found whatever its length
LEAST_ITEM = 4  # words of an item for whose sake a document goes
FILTER_BITS = 23

# Words that stand for numbers, and units after a number.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t oz lb lbs pound pounds ton tons ml l liter "
    "liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    "months year years mph kmh hz khz mhz ghz w kw kwh v a j kj n pa kpa c f k usd eur gbp dollar dollars euro euros cent "
    "cents percent degrees degree kb mb gb tb"
).split()

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, np.int64)
_STOP[[10, 33, 46, 58, 63]] = 1
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0xA5A5A5A5A5A5A5A5, 0x5C5C5C5C5C5C5C5C, 0x3E3E3E3E3E3E3E3E))


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(tx.run_hashes(data, np.array([0]), np.array([len(data)]))[0])


_NUMBER_WORDS = np.sort(np.array([_hash(w) for w in NUMBERS], np.uint64))
_UNIT_WORDS = np.sort(np.array([_hash(w) for w in UNITS], np.uint64))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def template(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Template tokens and values: a word's token is its hash and its value 0; a
    placeholder's token is its kind and its value the hash of what stood there."""
    return _read(text)[:2]


def _read(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens, values, and the hashes of all words in lower case."""
    text = text or ""
    words, digit, capital, opens = [], [], [], []
    fresh = True
    for block in tx.blocks(text.encode("utf-8", "surrogatepass"), _SEPARATOR):
        starts, ends = tx.edges(~_SEPARATOR[block])
        stops = np.concatenate([[0], np.cumsum(_STOP[block])])
        first = block[starts]
        second = block[np.minimum(starts + 1, max(len(block) - 1, 0))]
        digit.append((first >= 48) & (first < 58))
        capital.append(((first >= 65) & (first < 91)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E)))
        before = np.concatenate([[0], ends[:-1]])[: len(starts)]
        opening = stops[starts] > stops[before]
        if len(opening):
            opening[0] |= fresh
            fresh = stops[-1] > stops[ends[-1]]
        else:
            fresh |= bool(stops[-1])
        opens.append(opening)
    for block in tx.blocks(text.lower().encode("utf-8", "surrogatepass"), _SEPARATOR):
        words.append(tx.run_hashes(block, *tx.edges(~_SEPARATOR[block])))
    words, digit, capital, opens = (np.concatenate(x) for x in (words, digit, capital, opens))
    number = digit | _among(words, _NUMBER_WORDS)
    after = np.zeros(len(words), bool)
    after[1:] = number[:-1]
    unit = after & ~number & _among(words, _UNIT_WORDS)
    name = capital & ~opens & ~number & ~unit
    # A name elsewhere in the text is a name at the start of a sentence too.
    name |= capital & _among(words, np.unique(words[name])) & ~number & ~unit
    kind = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, np.uint64(0))))
    slot = kind != 0
    # Numbers or names that follow each other fill one slot.
    goes_on = np.zeros(len(words), bool)
    goes_on[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == _NUMBER) | ((kind[1:] == _NAME) & ~opens[1:]))
    heads = np.flatnonzero(~goes_on)
    values = np.add.reduceat(tx.mix(words + (np.arange(len(words)) - np.repeat(heads, np.diff([*heads, len(words)]))).astype(np.uint64)), heads) if len(heads) else words
    tokens = np.where(slot, kind, words)[heads]
    # The lowest bits tell names (01) from numbers and units (11).
    told = np.where(kind[heads] == _NAME, values & ~np.uint64(2) | np.uint64(1), values | np.uint64(3))
    return tokens, np.where(slot[heads], told, np.uint64(0)), words


def _telling(values: np.ndarray, width: int) -> np.ndarray:
    """Windows with enough words that are no placeholders."""
    words = np.concatenate([[0], np.cumsum(values == 0)])
    return (words[width:] - words[:-width]) >= min(LEAST_WORDS, (width + 1) // 2)


def _rows(owner, read, widths, filtered=None):
    """Rows of all windows, ``widths`` being pairs of plain or not and a width."""
    tokens, values, words = read
    for plain, width in widths:
        if len(words if plain else tokens) < width:
            continue
        hashes = tx.window_hashes(words if plain else tokens, width)
        good = np.ones(len(hashes), bool) if plain else _telling(values, width)
        if filtered is not None:
            good &= filtered[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
        for at in np.flatnonzero(good).tolist():
            filled = [] if plain else values[at : at + width].view(np.int64).tolist()
            yield (int(hashes[at].view(np.int64)), plain, width, owner, at, filled)


_SHAPE = "window long, plain boolean, width int, {0} long, at long, values array<long>"


def _emitted(rows: list[tuple], owner: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["window", "plain", "width", owner, "at", "values"])


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(tx.column(batch, "item_id"), tx.column(batch, "text"), strict=True):
                tokens, values, words = _read(text)
                if len(words):
                    out += _rows(item, (tokens, values, words), [(False, min(width, len(tokens))), (True, min(width, len(words)))])
            yield _emitted(out, "item_id")

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(tx.giving_back(cut), _SHAPE.format("item_id"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, covered: float = COVERED) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, verbatim): items found in documents."""
    items = keep(item_windows(benchmark, width))
    widths = sorted(tuple(r) for r in items.select("plain", "width").distinct().collect())  # at most twice ``width`` of them
    # One row for each place of the filter that is set, 2**FILTER_BITS at most.
    places = items.select(F.shiftrightunsigned("window", 64 - FILTER_BITS).alias("p")).distinct().toPandas().p.to_numpy(np.int64)
    filtered = np.zeros(1 << FILTER_BITS, bool)
    filtered[places] = True
    packed = np.packbits(filtered)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(packed).astype(bool)
        for batch in batches:
            out = []
            for doc, text in zip(tx.column(batch, "doc_id"), tx.column(batch, "text"), strict=True):
                out += _rows(doc, _read(text), widths, passes)
                if len(out) > 20_000:
                    yield _emitted(out, "doc_id")
                    out = []
            yield _emitted(out, "doc_id")

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tx.giving_back(cut), _SHAPE.format("doc_id"))
    theirs = items.withColumnsRenamed({"at": "item_at", "values": "item_values"})
    met = found.join(theirs, ["window", "plain", "width"])
    pair = lambda a, b: F.struct(a.alias("theirs"), b.alias("ours"))
    filled = F.array_distinct(F.filter(F.zip_with("item_values", "values", pair), lambda p: p["theirs"] != 0))
    name = lambda p: p["theirs"].bitwiseAND(F.lit(3)) == 1
    single = lambda c: F.size(c) == F.size(F.array_distinct(F.col(f"{c}.theirs")))
    # Equal numbers of an item may play two roles: they need to be told apart only within
    # a window. A name is the same all along.
    met = met.withColumn("_pairs", filled).where(single("_pairs"))
    lined = (
        met.groupBy("doc_id", "item_id", "plain", (F.col("at") - F.col("item_at")).alias("distance"))
        .agg(
            F.collect_set("item_at").alias("places"),
            F.collect_set(F.filter("_pairs", name)).alias("_names"),
            F.bool_and(F.forall("_pairs", lambda p: p["theirs"] == p["ours"])).alias("_same"),
        )
        .withColumn("_names", F.array_distinct(F.flatten("_names")))
    )
    counted = items.groupBy("item_id", "plain").agg(F.count_distinct("at").alias("n_windows"))
    share = F.col("n_matched") / F.col("n_windows")
    best = F.max(F.struct(share.alias("share"), (~F.col("plain")).alias("slots"), "n_windows", "n_matched", "verbatim"))
    return (
        lined.where(single("_names"))
        .groupBy("doc_id", "item_id", "plain")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_matched"),
            F.bool_and("_same").alias("verbatim"),
            F.max(F.size("places")).alias("_longest"),
        )
        .join(counted, ["item_id", "plain"])
        .where((F.col("n_matched") >= covered * F.col("n_windows")) | (F.col("_longest") >= LONG_RUN))
        # Of the two kinds of windows the one that covers more of the item speaks.
        .groupBy("doc_id", "item_id")
        .agg(best.alias("_best"))
        .select("doc_id", "item_id", "_best.n_windows", "_best.n_matched", "_best.verbatim")
    )


def keep_untouched(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, covered: float = COVERED) -> DataFrame:
    """Documents in which no item is found. Rows without an id stay, and so do documents
    with nothing but items of fewer than ``LEAST_ITEM`` words, which prove nothing."""
    telling = benchmark.where(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) >= LEAST_ITEM)
    gone = keep(find_leaks(docs, telling, width, covered).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
