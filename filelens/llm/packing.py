"""Packing of documents into sequences of bounded length by linear grouping.

Documents become token pieces; how many pieces there are of each length (at most
``capacity`` numbers) is all that the plan needs. Long pieces are put into groups of
equal cardinality and rounded up to the longest of their group; the few sizes that
remain make a linear programme over configurations, solved with generated columns.
Actual pieces then take the places of rounded ones, the last of each configuration so
that it uses what rounding left over, and the short ones go where they fit best. The plan is a list of runs (this many sequences
with these lengths), so its size depends on the lengths and not on the documents;
every piece finds its sequence by its number among all pieces sorted by length.

Rows: a null text is empty and packs as the end token alone; a very long one is cut
into pieces; repeated rows are packed once each; a null id stays null; other columns
are ignored; an empty table packs into nothing.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm import text as tx
from filelens.operators.scale import number_rows
from filelens.session import keep

CAPACITY = 2048
GROUPS = 60  # sizes that long pieces are rounded to
LONG = 4  # pieces above capacity / LONG are long
COLUMNS = 400  # configurations that are generated at most; a later one would be better by little
CACHED_WORDS, CACHED_LENGTH = 500_000, 64
STRETCH = 500_000  # characters of text that are encoded together
_SIGNED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~].*)", re.S)
_SMALL = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
END = b"\0\0\0\0"

_tokenizers: dict = {}
_words: dict[str, bytes] = {}


# --- tokens -------------------------------------------------------------------------


def _tokenizer(path: str | None):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            _tokenizers[path] = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        else:
            _tokenizers[path] = Tokenizer.from_file(path)
        _words.clear()
    return _tokenizers[path]


def _parts(word: str) -> tuple[str, str]:
    """A word cut where a sign follows its first letters: they never share a token."""
    found = _SIGNED.match(word)
    # A letter that becomes a letter and a sign in lower case takes part in what follows.
    return (found[1], found[2]) if found and found[1][-1].lower().isalpha() else (word, "")


def _encode(tokenizer, parts: list[str]) -> dict[str, bytes]:
    """Ids of parts of words. One of small Latin letters only is normal already and one
    unit, so the tokenizer's model alone can tell its ids."""
    model = tokenizer.model
    plain = [p for p in parts if _SMALL.fullmatch(p)]
    made = {p: array("I", [t.id for t in model.tokenize(p.translate(_as_bytes()))]).tobytes() for p in plain}
    odd = [p for p in parts if p not in made]
    for part, found in zip(odd, tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
        made[part] = array("I", found.ids).tobytes()
    return made


@cache
def _as_bytes() -> dict[int, str]:
    """How a byte-level model spells letters beyond ASCII."""
    from tokenizers.pre_tokenizers import ByteLevel

    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    return {code: spell(chr(code))[0][0] for code in range(0xDF, 0x100)}


def token_ids(texts: list[str], path: str | None = None) -> list[bytes]:
    """Little-endian 32-bit ids of texts. The tokenizer drops white space and no token
    spans it, so distinct words are encoded once and their ids put together again."""
    tokenizer = _tokenizer(path)
    whole = [t.encode("utf-8", "surrogatepass") for t in texts]
    block = np.frombuffer(b"\n".join(whole), np.uint8)
    if b"<|" not in block.tobytes():  # case tells special tokens from others, and nothing else
        block = tx.LOWER[block]
    inside = (block != 32) & (block != 10)
    starts, ends = tx.edges(inside)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(block[inside])])
    coded = spelled.dictionary_encode()
    words = coded.dictionary.cast(pa.large_string()).to_pylist()
    if len(_words) > CACHED_WORDS:
        _words.clear()
    new = {w: _parts(w) for w in words if w not in _words}
    apart = list({part for parts in new.values() for part in parts if part and part not in _words})
    for at in range(0, len(apart), 10_000):
        _words.update(_encode(tokenizer, apart[at : at + 10_000]))
    _words.update((w, _words[one] + _words[two]) for w, (one, two) in new.items() if two)
    found = [_words[w] for w in words]
    for word in [w for w in (*new, *apart) if len(w) > CACHED_LENGTH]:
        _words.pop(word, None)
    # Ids of all words one after the other, taken from those of the distinct ones.
    ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
    codes = coded.indices.to_numpy()
    begins, held = np.cumsum(sizes) - sizes, sizes[codes]
    places = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(held, out=places[1:])
    data = ids[np.repeat(begins[codes] - places[:-1], held) + np.arange(places[-1])].tobytes()
    first = np.cumsum([0, *(len(t) + 1 for t in whole)])
    cuts = (4 * places[np.searchsorted(starts, first)]).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Where stretches of less than ``STRETCH`` characters, or of a single text, begin and end."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < STRETCH):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and an
    end token, cut only where longer than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = tx.column(batch, "doc_id"), [t or "" for t in tx.column(batch, "text")]
            for at, end in stretches(texts):
                rows = []
                for doc, own in zip(ids[at:end], token_ids(texts[at:end], tokenizer), strict=True):
                    own += END
                    for piece, start in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[start : start + 4 * capacity]
                        rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part), part))
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32())]
                arrays += [pa.array(c, pa.int64()) for c in columns[2:5]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(columns[5], pa.binary())], [*names, "ids"]
                yield pa.record_batch(arrays, names)
        # The worker goes on to other tasks, of other operators too.
        _words.clear()
        _tokenizers.clear()
        tx.release()

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, shape)


# --- the plan -----------------------------------------------------------------------


def groups_of_equal_size(counts: dict[int, int], number: int) -> list[list[list[int]]]:
    """Runs [length, count] of each group, longest first; all groups but the last
    hold equally many pieces. A length may lie in several groups."""
    total = sum(counts.values())
    size = -(-total // number)
    groups: list[list[list[int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                groups.append([])
                room = size
            taken = min(left, room)
            groups[-1].append([length, taken])
            left, room = left - taken, room - taken
    return groups


def _best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable set of sizes that fits (unbounded knapsack)."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    shift = np.array(sizes)
    for room in range(min(sizes), capacity + 1):
        fits = shift <= room
        gain = np.where(fits, value[np.maximum(room - shift, 0)] + worth, -1.0)
        best = int(gain.argmax())
        value[room], choice[room] = max((gain[best], best), (value[room - 1], -1))
    made, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            made[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(value[capacity]), made


def configurations(sizes: list[int], wanted: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size) and how often each is used in a
    fractional optimum: revised simplex with generated columns."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(COLUMNS):
        inverse = np.linalg.inv(basis)
        used = inverse @ np.array(wanted, float)
        worth = np.ones(n) @ inverse
        value, column = _best_configuration(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-9:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, np.maximum(used, 0) / np.where(change > 1e-9, change, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(ratio.argmin())] = column
    used = np.maximum(np.linalg.inv(basis) @ np.array(wanted, float), 0)
    return [(basis[:, j].round().astype(int), float(used[j])) for j in range(n)]


Runs = list[tuple[int, tuple[int, ...]]]


def substituted(left: dict[int, int], sizes: list[int], chosen: list[tuple[np.ndarray, int]], capacity: int) -> Runs:
    """Runs (sequences, lengths) with actual pieces in the places of rounded sizes; takes
    them out of ``left``. A place takes the longest piece that its size has room for, the
    last place of a configuration the longest that fits: what rounding left over is used."""
    order, runs = sorted(left), []
    for made, times in chosen:
        places = [size for size, many in sorted(zip(sizes, made.tolist(), strict=True), reverse=True) for _ in range(many)]
        while times > 0:
            taken: Counter[int] = Counter()
            room = capacity
            for place, size in enumerate(places, 1):
                at = bisect.bisect_right(order, room if place == len(places) else min(size, room)) - 1
                while at >= 0 and left[order[at]] <= taken[order[at]]:
                    at -= 1
                if at >= 0:
                    taken[order[at]] += 1
                    room -= order[at]
            if not taken:
                break
            # So often until one length has too few pieces left.
            step = min(times, *(left[length] // many for length, many in taken.items()))
            runs.append((step, tuple(sorted(taken.elements(), reverse=True))))
            times -= step
            for length, many in taken.items():
                left[length] -= step * many
                if not left[length]:
                    del left[length]
                    order.remove(length)
    return runs


def plan(counts: dict[int, int], capacity: int = CAPACITY, number: int = GROUPS) -> Runs:
    """Runs (sequences, lengths of their pieces) that hold exactly ``counts``."""
    left = dict(counts)
    full = left.pop(capacity, 0)
    long = {s: n for s, n in left.items() if s * LONG > capacity}
    left = {s: n for s, n in left.items() if s not in long}
    runs: Runs = []
    if long:
        wanted: dict[int, int] = {}
        for group in groups_of_equal_size(long, number):
            wanted[group[0][0]] = wanted.get(group[0][0], 0) + sum(n for _, n in group)
        sizes = list(wanted)
        chosen = [(made, int(times)) for made, times in configurations(sizes, list(wanted.values()), capacity) if times >= 1]
        # Few long places first: short pieces stay for what they leave.
        chosen.sort(key=lambda one: one[0].sum())
        runs = substituted(long, sizes, chosen, capacity)
        for size, n in long.items():
            left[size] = left.get(size, 0) + n
    return ([(full, (capacity,))] if full else []) + best_fit(left, runs, capacity)


def best_fit(left: dict[int, int], runs: Runs, capacity: int) -> Runs:
    """Pieces go, longest first, where they leave the least room; a new sequence is begun
    where none has room."""
    done: Runs = []
    open_runs: dict[int, Runs] = {}  # by the room that is left
    rooms: list[int] = []

    def put(times: int, lengths: tuple[int, ...]) -> None:
        room = capacity - sum(lengths)
        if not room:
            done.append((times, lengths))
            return
        if room not in open_runs:
            open_runs[room] = []
            bisect.insort(rooms, room)
        open_runs[room].append((times, lengths))

    for times, lengths in runs:
        put(times, lengths)
    for length in sorted(left, reverse=True):
        many = left[length]
        while many:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if many >= each:
                    put(many // each, (length,) * each)
                if many % each:
                    put(1, (length,) * (many % each))
                break
            room = rooms[at]
            times, lengths = open_runs[room].pop()
            if not open_runs[room]:
                del open_runs[room], rooms[at]
            used = min(times, many)
            if times > used:
                put(times - used, lengths)
            put(used, (*lengths, length))
            many -= used
    return done + [run for runs in open_runs.values() for run in runs]


def _places(runs: Runs, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces numbered by length: the first number of each stretch, the sequence
    of that number (later ones follow on), and the offset there."""
    following, at = {}, 0
    for length in sorted(counts):
        following[length] = at
        at += counts[length]
    first, sequence, offset, base = [], [], [], 0
    for times, lengths in runs:
        place = 0
        for length in lengths:
            first.append(following[length])
            sequence.append(base)
            offset.append(place)
            following[length] += times
            place += length
        base += times
    order = np.argsort(first) if first else np.zeros(0, int)
    return tuple(np.array(x, np.int64)[order] for x in (first, sequence, offset))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    cut = keep(pieces(docs, capacity, tokenizer, with_ids))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # one row a length
    first, sequence, offset = _places(plan(counts, capacity), counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("_at")).to_numpy(zero_copy_only=False)
            stretch = np.searchsorted(first, at, "right") - 1
            found = [pa.array(sequence[stretch] + at - first[stretch]), pa.array(offset[stretch])]
            kept = [c for c in batch.schema.names if c != "_at"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.record_batch([*columns, *found], [*kept, "sequence_id", "offset"])

    order = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")]
    numbered = number_rows(cut, order, "_at")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return numbered.mapInArrow(place, f"{shape}, sequence_id long, offset long")
