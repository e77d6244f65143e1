"""Spelling variants: words that differ by one edit, and the common form of each.

Words are runs of Latin letters; in one of 31 places, chosen by a checksum of document
and run, a letter is left out. A word's form is the commonest word one edit away, if it
is ten times as common; roots follow forms to the last.

Two words one edit apart agree before and after the edit. Words of length L and L + 1
are therefore grouped by what they share if their first difference lies in one half of
L, and a group that holds too many is cut again, down to a single place, where the
alphabet bounds it. No pair is in two groups: the place of the first difference decides.
Inside a group stands a bit-sliced position index: for each place and letter a bitset of
the words that have the letter there. One word meets all words at once: recurrences keep
the set without an error, and those with one error whose places are shifted by nothing,
by one to the right, or by one to the left. Bits are in order of number, so the first bit
of an answer is the commonest near word.

Rows: null and empty texts have no words; a repeated row counts again; a null ``doc_id``
is written as nothing before the colon; ties go to the smallest word; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.llm import text as tx
from filelens.session import keep

LEAST_LETTERS, LEAST_SEEN = 7, 2
DROPPED = 31  # one run of so many loses a letter
TIMES = 10  # how much commoner a form must be
GROUP = 16_384  # words of a group; at one place the alphabet allows fewer
HELD = 400_000  # words a task counts before it hands them on

# A-Z and the letters U+00C0 to U+00FF, as UTF-8 after lower-casing A-Z.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_LOWER = bytes(tx.LOWER)


def altered(doc_id: int | None, run: bytes) -> bytes:
    """The lower-cased run, without one letter where the checksum says so."""
    sum_ = zlib.crc32(run, zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if sum_ % DROPPED:
        return run
    letters = run.decode()
    at = sum_ % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        words = pa.array(list(held), pa.binary()).cast(pa.string())
        found = pa.record_batch([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return found

    for batch in batches:
        for doc_id, text in zip(tx.column(batch, "doc_id"), tx.column(batch, "text"), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
            for run, seen in Counter(_RUN.findall(data)).items():
                if len(run) >= LEAST_LETTERS:  # no shorter run has so many letters
                    held[altered(doc_id, run)] += seen
            if len(held) > HELD:
                yield rows()
    yield rows()
    tx.release()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words that are long and common enough."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    counted = texts.mapInArrow(_count, "word string, n long").where(F.char_length("word") >= LEAST_LETTERS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)


def _placed(words: DataFrame, ranges: Column) -> DataFrame:
    """Rows of ``words`` once for each (base, lo, hi) in ``ranges``: words of ``base``
    letters or one more, whose first difference lies in lo <= place < hi, share their
    first ``lo`` letters and all after ``hi``."""
    at = words.select("word", "n", F.explode(ranges).alias("at")).select("word", "n", "at.*")
    tail = F.greatest(F.col("base") - F.col("hi"), F.lit(0))
    size = F.char_length("word")
    first = F.substr("word", F.lit(1), F.col("lo"))
    last = F.when(tail > 0, F.substr("word", size - tail + 1, tail)).otherwise("")
    core = F.substr("word", F.col("lo") + 1, size - F.col("lo") - tail)
    # No word holds a digit or a colon, so keys tell all parts apart.
    key = F.concat_ws(":", "base", "lo", "hi", first, last)
    return at.select("word", "n", "base", "lo", "hi", key.alias("key"), core.alias("core"))


def _range(base: Column, lo: Column, hi: Column) -> Column:
    return F.struct(base.cast("int").alias("base"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _halves(base: Column, lo: Column, hi: Column) -> list[Column]:
    middle = F.floor((lo + hi) / 2)
    return [_range(base, lo, middle), _range(base, middle, hi)]


def groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """Every word in its groups of at most ``most`` words (or of one place)."""
    size, none = F.char_length("word"), F.lit(0)
    longer = F.when(size > LEAST_LETTERS, F.array(*_halves(size - 1, none, size)))
    whole = F.concat(F.array(*_halves(size, none, size + 1)), F.coalesce(longer, F.array().cast(
        "array<struct<base:int,lo:int,hi:int>>")))
    settled, placed = None, _placed(words, whole)
    while True:
        placed = keep(placed)
        held = placed.groupBy("key", "lo", "hi").agg(F.count(F.lit(1)).alias("rows"))
        crowded = keep(held.where((F.col("rows") > most) & (F.col("hi") - F.col("lo") > 1)).select("key"))
        if crowded.isEmpty():
            return placed if settled is None else settled.unionByName(placed)
        calm = placed.join(crowded, "key", "left_anti").select(placed.columns)
        settled = calm if settled is None else settled.unionByName(calm)
        cut = F.array(*_halves(F.col("base"), F.col("lo"), F.col("hi")))
        placed = _placed(placed.join(crowded, "key", "left_semi"), cut)


class Index:
    """Bitsets over the cores of one group: by place and letter, and by length."""

    def __init__(self, cores: Sequence[str]):
        self.all = (1 << len(cores)) - 1
        rows: list[dict[str, list[int]]] = [defaultdict(list) for _ in range(max(map(len, cores)))]
        of_length: dict[int, list[int]] = defaultdict(list)
        for row, core in enumerate(cores):
            of_length[len(core)].append(row)
            for place, letter in enumerate(core):
                rows[place][letter].append(row)
        self.at = [{letter: _bits(found, len(cores)) for letter, found in place.items()} for place in rows]
        self.of_length = {length: _bits(found, len(cores)) for length, found in of_length.items()}

    def near(self, core: str, base: int, bounded: bool) -> int:
        """The rows one edit from ``core``: of its own length or one longer if it has
        ``base`` letters, one shorter if it is longer itself. ``bounded``: what differs
        only after the last letter of the shorter belongs to another group."""
        at, none = self.at, {}
        same = self.all  # no error
        if len(core) > base:
            shorter = 0  # one letter of ``core`` left out: places one to the left
            for place, letter in enumerate(core):
                before = at[place - 1] if place else none
                if place == base:
                    shorter &= before.get(letter, 0)
                    # Where all before the last letter agrees, that letter is the one left out.
                    shorter = shorter & ~same if bounded else shorter | same
                    return shorter & self.of_length.get(base, 0)
                shorter = (shorter & before.get(letter, 0)) | same
                same &= at[place].get(letter, 0)
                if not shorter:
                    return 0
            return 0
        changed = longer = 0  # one letter replaced; one put in: places one to the right
        for place, letter in enumerate(core):
            here = at[place].get(letter, 0)
            after = at[place + 1].get(letter, 0) if place + 1 < len(at) else 0
            changed = (changed & here) | (same & ~here)
            # A letter put in before this one, or earlier.
            longer = (longer | same) & after
            same &= here
        if not bounded:
            longer |= same
        else:
            longer &= ~same
        return (changed & self.of_length.get(base, 0)) | (longer & self.of_length.get(base + 1, 0))


def _bits(rows: list[int], size: int) -> int:
    if len(rows) < 8:
        found = 0
        for row in rows:
            found |= 1 << row
        return found
    held = bytearray(size // 8 + 1)
    for row in rows:
        held[row >> 3] |= 1 << (row & 7)
    return int.from_bytes(held, "little")


def near_in_group(rows: Sequence[tuple[str, int, int, int, int, str]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, largest n of them, the word that has it) in one group of rows
    (word, n, base, lo, hi, core)."""
    if len(rows) < 2:
        return
    rows = sorted(rows, key=lambda row: (-row[1], row[0]))
    _, _, whole, lo, hi, _ = rows[0]
    bounded, base = hi <= whole, min(hi, whole) - lo
    index = Index([row[5] for row in rows])
    for word, _, _, _, _, core in rows:
        found = index.near(core, base, bounded)
        if found:
            best = rows[(found & -found).bit_length() - 1]
            yield word, found.bit_count(), best[1], best[0]


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(tx.column(batch, c) for c in ("key", "word", "n", "base", "lo", "hi", "core")), strict=True)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        word, near, n, best = zip(*found, strict=True)
        return pa.record_batch(
            [pa.array(word), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(best)], ["word", "near", "best_n", "best"]
        )

    held: list[tuple] = []
    for _, members in groupby(rows(), key=lambda row: row[0]):
        held.extend(near_in_group([row[1:] for row in members]))
        if len(held) > 50_000:
            yield batch_of(held)
            held = []
    if held:
        yield batch_of(held)
    tx.release()


def near_words(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near word."""
    ordered = groups(words, most).repartition("key").sortWithinPartitions("key")
    found = ordered.mapInArrow(_look, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last by doubling steps.
    A form is ten times as common as its word, so there are few."""
    at = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = at.join(ahead, "root", "left")
        if moved.where("_next is not null").isEmpty():
            return at
        at = keep(moved.select("word", F.coalesce("_next", "root").alias("root")))


def variants(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the vocabulary."""
    words = keep(vocabulary(docs))
    told = F.col("best_n") >= TIMES * F.col("n")
    judged = keep(words.join(near_words(words, most), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(told, F.col("best")).alias("form"), F.when(told, F.col("best_n")).alias("form_n"),
    ))
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
