"""Helpers that work on one batch of rows inside a task: words, hashes, batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only

# A text is looked at in blocks of about so many bytes, cut where a word ends.
BLOCK = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _FACTOR)
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _powers[base] = np.cumprod(table, dtype=np.uint64)
    return _powers[base][:n]


def blocks(data: bytes, separators: np.ndarray = SPACES) -> Iterator[np.ndarray]:
    """The bytes of a text in blocks that end at a separator."""
    whole = np.frombuffer(data, np.uint8)
    at = 0
    while len(whole) - at > BLOCK:
        after = np.flatnonzero(separators[whole[at + BLOCK : at + 2 * BLOCK]])
        end, step = at + BLOCK, BLOCK
        while not len(after) and end + step < len(whole):
            end += step
            after = np.flatnonzero(separators[whole[end : end + step]])
        if not len(after):
            break
        end += int(after[0])
        yield whole[at:end]
        at = end
    yield whole[at:]


def edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    turns = np.flatnonzero(padded[1:] != padded[:-1])
    return turns[0::2], turns[1::2]


def run_hashes(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run: a polynomial over the block, shifted to the
    run's start."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    terms = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[block] * _power(_BASE, len(block)), dtype=np.uint64, out=terms[1:])
    sums = (terms[ends] - terms[starts]) * _power(_INVERSE, len(block))[starts]
    return mix(sums + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text: A-Z lower-cased, cut at ASCII white space."""
    found = []
    for block in blocks(text.encode("utf-8", "surrogatepass")):
        block = LOWER[block]
        found.append(run_hashes(block, *edges(~SPACES[block])))
    return np.concatenate(found)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, in order; of all words together if
    there are fewer; nothing without words."""
    width = min(width, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    count = len(words) - width + 1
    out = mix(words[:count] + np.uint64(width))
    for at in range(1, width):
        out = mix(out * _FACTOR + words[at : at + count])
    return out


def release() -> None:
    """Give back what a finished task no longer needs; its worker process stays."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def giving_back(look: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task, which gives memory back when it ends, however it ends."""

    @wraps(look)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from look(batches)
        finally:
            release()

    return run


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
