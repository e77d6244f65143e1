"""Toxicity by a noisy channel: disguised words are restored, then scored.

A character model (trigrams of letters, counted over all documents) says which letter
strings are likely. Parts of a text that may be disguised (digits or signs among
letters, letters set apart, letters repeated) become lattices: every sign may stand
for itself (the end of a word), for the letters it resembles, or for nothing. The best
path, over the whole part however long, gives the restored words. Words of the restored text carry weights learned from labelled
documents: a word, or a beginning of a word, weighs as much as it is commoner among
toxic ones. Documents count once per smallest word hash, so that near copies of one
text do not speak for each other's words. A logistic curve over the weights of a
document gives its score.

Rows: null and empty texts score as texts without words; repeated rows get a row each;
a null id is held out; labels other than 0 and 1 are not learned from; with no labels
at all every score is that of a clean text. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm import text as tx
from filelens.llm.labels import fit_logistic, held_out, labelled_sample, sigmoid, texts_of

FIT_ROWS = 20_000  # labelled rows that are learned from at most
LEAST_SUPPORT = 5  # distinct toxic documents from which a feature is looked at,
LEAST_SHARE = 0.01  # and their share of all toxic ones
FEATURES = 20_000  # features that are weighed at most, the commonest in toxic text
LIKELY = 2.0  # weight from which a word counts as a toxic one
MEMO = 150_000
LONGEST_KEPT = 60  # characters of a token that is remembered

# Letters that signs are used for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "*": "aeiou",
}
WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(LOOKALIKES))
_LETTER, APART = r"[^\W\d_]", r"[\s.\-_/]"
SET_APART = re.compile(rf"(?<![^\W_])(?:{_LETTER}|[{_SIGNS}])(?:{APART}++(?:{_LETTER}|[{_SIGNS}]))+(?![^\W_])")
GAP, TOGETHER = re.compile(APART), re.compile(r"[^\s.\-_/]{2}")
SIGNED = re.compile(rf"[{_SIGNS}]")
LETTER = re.compile(_LETTER)
# Figures with at most one sign on each side, and signs of which none is used in words.
FIGURES = re.compile(r"[+\-(<$€|*@!#~]?\d*(?:[.,:/+\-*|]\d+)*[)%€$!+|*]?|[^@$€\d]+")


LETTERS, ALNUM, SIGN, GAPS = 1, 2, 4, 8


@cache
def _kinds() -> np.ndarray:
    """What every code point is, by the patterns above: a sum of kinds."""
    everything = np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTERS, _LETTER), (ALNUM, r"[^\W_]"), (SIGN, rf"[{_SIGNS}]"), (GAPS, APART)):
        for run in re.finditer(f"{pattern}+", everything):
            kinds[run.start() : run.end()] |= kind
    return kinds


def kinds_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text and what each is."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, _kinds()[points]


def words_of(points: np.ndarray, kinds: np.ndarray) -> set[str]:
    """The runs of letters, as WORD finds them; in blocks that end where a word does."""
    found: set[str] = set()
    at, inside = 0, kinds & LETTERS != 0
    while at < len(points):
        end = min(at + tx.BLOCK, len(points))
        while end < len(points) and inside[end]:
            end += 1
        found.update(np.where(inside[at:end], points[at:end], np.uint32(32)).tobytes().decode("utf-32-le").split())
        at = end
    return found


def disguised(text: str, points: np.ndarray | None = None, kinds: np.ndarray | None = None) -> list[str]:
    """Parts of a lower-case text that may be other words: letters and look-alikes set
    apart, whatever else has a look-alike, and words that repeat a letter. Only what has
    no letter and is written as figures or punctuation are is left out."""
    if kinds is None:
        points, kinds = kinds_of(text)
    found, end = [], 0
    for start in _apart_from(kinds):
        if start >= end and (match := SET_APART.match(text, start)):
            end = match.end()
            if LETTER.search(match[0]) or "@" in match[0] or "$" in match[0]:
                found.append(match[0])
    if (kinds & SIGN).any():
        for word in text.split():
            if SIGNED.search(word):
                word = word.lstrip(".,;:?\"')[]").rstrip("!.,;:?\"'()[]")
                if len(word) > 1 and SIGNED.search(word) and (LETTER.search(word) or not FIGURES.fullmatch(word)):
                    found.append(word)
    end = 0
    same = points[1:] == points[:-1]
    for start in np.flatnonzero(same[1:] & same[:-1] & (kinds[:-2] & LETTERS != 0)).tolist():  # a letter thrice
        if start < end:
            continue
        end = start + 3
        while start and text[start - 1].isalpha():
            start -= 1
        while end < len(text) and text[end].isalpha():
            end += 1
        found.append(text[start:end])
    return found


def _apart_from(kinds: np.ndarray) -> list[int]:
    """Where SET_APART may begin: a letter or sign that begins a word and has a gap behind it."""
    begins = (kinds[:-1] & (LETTERS | SIGN) != 0) & (kinds[1:] & GAPS != 0)
    begins[1:] &= kinds[:-2] & ALNUM == 0
    return np.flatnonzero(begins).tolist()


SYMBOLS = 64  # none, a-z, the Latin letters from ß on, any other letter
_CODES = np.zeros(0x101, np.int64)
_CODES[97:123] = np.arange(1, 27)
_CODES[0xDF:0x100] = np.arange(27, 60)
_CODES[0xF7] = 0
_CODES[0x100] = 60  # and all beyond, letters or not: what follows them is rarely asked for


def _symbols(text: str) -> np.ndarray:
    return _CODES.take(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), mode="clip")


@cache
def _symbol(letter: str) -> int:
    return int(_symbols(letter)[0])


# --- the character model -----------------------------------------------------------


def count_characters(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all documents; what comes back is bounded by the symbols."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in tx.column(batch, "text"):
                for at in range(0, len(text or ""), 1 << 20):
                    s = _symbols(" " + text[at : at + (1 << 20)].lower() + " ")
                    total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["code", "n"])

    rows = docs.select("text").mapInArrow(tx.giving_back(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3)
    for code, n in rows.collect():
        counts[code] = n
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), backed off to pairs and single symbols."""
    single = (counts.sum((0, 1)) + 1) / (counts.sum() + SYMBOLS)
    pairs = counts.sum(0)
    pairs = (pairs + 10 * single) / (pairs.sum(1, keepdims=True) + 10)
    return np.log((counts + 10 * pairs[None]) / (counts.sum(2, keepdims=True) + 10)).astype(np.float32)


def restore(token: str, model: list[float], slack: float, itself: bool = True) -> list[str]:
    """The likeliest words behind a disguised token of any length (Viterbi over the
    lattice; a state is the last two symbols, with a chain of what led to it). ``model``
    is flat. Two symbols on, states go on alike: one that lies behind the best by more
    than ``slack``, twice the range of the model, cannot win and is dropped. Not ``itself``: look-alikes are letters or nothing."""
    token = token.lower()
    apart = not TOGETHER.search(token)
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    before, run = "", 0
    for sign in token:
        # What is made, its symbol (a space is the symbol of all that are no letters), cost.
        ways: list[tuple[str, int, float]] = []
        if sign.isalpha():
            ways.append((sign, _symbol(sign), -0.05))
            run = run + 1 if sign == before else 1
            if run > 1:
                ways.append(("", 0, -1.5 if run == 2 else -0.2))
        elif sign in LOOKALIKES:
            ways += [(letter, _symbol(letter), -0.7 - 0.5 * i) for i, letter in enumerate(LOOKALIKES[sign])]
            ways += [(" ", 0, -3.0), ("", 0, -8.0)] if itself else [("", 0, -8.0)]
        elif GAP.match(sign) and GAP.match(before):
            continue  # several are one gap
        else:
            ways += [(" ", 0, -0.05), ("", 0, -0.05 if apart else -1.5)]
        after: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, made) in states.items():
            behind, last = state * SYMBOLS, (state % SYMBOLS) * SYMBOLS
            for letter, symbol, cost in ways:
                if letter:
                    to, value = last + symbol, score + cost + model[behind + symbol]
                else:
                    to, value = state, score + cost
                held = after.get(to)
                if held is None or value > held[0]:
                    after[to] = (value, (made, letter) if letter else made)
        if len(after) > 16:
            least = max(score for score, _ in after.values()) - slack
            after = {state: way for state, way in after.items() if way[0] >= least}
        states, before = after, sign
    _, made = max(((score + model[state * SYMBOLS], made) for state, (score, made) in states.items()), key=lambda way: way[0])
    letters = []
    while made:
        made, letter = made
        letters.append(letter)
    return "".join(reversed(letters)).split()


class Reader:
    """Distinct words of texts, with restored ones; remembers what it restored."""

    def __init__(self, model: np.ndarray):
        self.model, self.memo = model.ravel().tolist(), {}
        self.slack = 2 * float(model.max() - model.min())

    def words(self, text: str | None) -> set[str]:
        text = (text or "").lower()
        points, kinds = kinds_of(text)
        found = words_of(points, kinds)
        for token in disguised(text, points, kinds):
            made = self.memo.get(token)
            if made is None:
                made = restore(token, self.model, self.slack)
                # Written apart, one word may have been taken for several.
                made = {*made, "".join(made)}
                # Many signs together pass for themselves too easily.
                if SIGNED.search(token):
                    made.update(restore(token, self.model, self.slack, False))
                if len(token) <= LONGEST_KEPT:
                    if len(self.memo) > MEMO:
                        self.memo.clear()
                    self.memo[token] = made
            found |= made
        found.discard("")
        return found


# --- words and their weights --------------------------------------------------------


STEMS = (4, 5, 6)  # characters of the beginnings


def features(word: str) -> set[str]:
    """A word and its beginnings, which carry stems."""
    return {word, *("^" + word[:n] for n in STEMS if len(word) >= n)}


def hashed(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) - (1 << 63)


@dataclass
class Model:
    characters: np.ndarray
    weights: dict[int, float]
    curve: np.ndarray


def _supports(texts: DataFrame, characters: np.ndarray, among: set[int] | None) -> DataFrame:
    """(feature, label, support): in how many documents, near copies once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(characters)
        for batch in batches:
            for text, label in zip(tx.column(batch, "text"), tx.column(batch, "label"), strict=True):
                words = reader.words(text)
                if not words:
                    continue
                own = {hashed(f) for w in words for f in features(w)}
                own = own if among is None else own & among
                first = min(map(hashed, words))
                n = len(own)
                yield pa.record_batch(
                    [pa.array(list(own), pa.int64()), pa.array([label] * n, pa.int32()), pa.array([first] * n, pa.int64())],
                    ["feature", "label", "kin"],
                )

    rows = texts.select("text", "label").mapInArrow(tx.giving_back(count), "feature long, label int, kin long").distinct()
    return rows.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("support"))


class Scorer:
    """Measures texts; remembers which words it has weighed and what the heavy ones weigh."""

    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model.characters)
        self.weighed: set[str] = set()
        self.heavy: dict[str, float] = {}

    def weigh(self, word: str) -> float:
        """The largest weight of the features of a word."""
        most = self.model.weights.get(hashed(word), 0.0)
        for n in STEMS:
            if len(word) < n:
                break
            most = max(most, self.model.weights.get(hashed("^" + word[:n]), 0.0))
        return most

    def forget(self) -> None:
        self.weighed.clear()
        self.heavy.clear()
        self.reader.memo.clear()

    def measures(self, text: str | None) -> tuple[float, float, float]:
        """Largest weight, how many words weigh much, their sum; all damped."""
        words = self.reader.words(text)
        if len(self.weighed) > MEMO:
            self.weighed.clear()
            self.heavy.clear()
        new = words - self.weighed
        for word in new:
            weight = self.weigh(word)
            if weight >= LIKELY:
                self.heavy[word] = weight
        self.weighed |= new
        heavy = [self.heavy[word] for word in words if word in self.heavy]
        return (max(heavy, default=0.0), float(np.log1p(len(heavy))), float(np.log1p(math.fsum(heavy))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from all characters of ``docs`` and at most ``rows`` labelled documents."""
    characters = log_model(count_characters(docs))
    texts = texts_of(docs, labelled_sample(labels, "toxic", rows))
    sizes = dict(texts.groupBy("label").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    least = max(LEAST_SUPPORT, LEAST_SHARE * bad)
    toxic = _supports(texts.where("label = 1"), characters, None)
    common = {
        r[0]: r[1]
        for r in toxic.where(F.col("support") >= least).orderBy(F.desc("support"), "feature").limit(FEATURES)
        .select("feature", "support").collect()
    }
    clean = {r[0]: r[1] for r in _supports(texts.where("label = 0"), characters, set(common)).select("feature", "support").collect()}
    weights = {f: float(np.log((n + 0.5) / (bad + 1)) - np.log((clean.get(f, 0) + 0.5) / (good + 1))) for f, n in common.items()}
    model = Model(characters, {f: w for f, w in weights.items() if w >= LIKELY}, np.zeros(4))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            seen = [scorer.measures(t) for t in tx.column(batch, "text")]
            columns = [pa.array([m[i] for m in seen], pa.float64()) for i in range(3)]
            yield pa.record_batch([*columns, batch.column(batch.schema.get_field_index("label"))], ["a", "b", "c", "label"])
        scorer.forget()

    seen = texts.select("text", "label").mapInArrow(tx.giving_back(look), "a double, b double, c double, label int").collect()
    table = np.array([tuple(r) for r in seen], float).reshape(-1, 4)
    model.curve = fit_logistic(table[:, :3], table[:, 3])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            seen = np.array([scorer.measures(t) for t in tx.column(batch, "text")], float).reshape(-1, 3)
            points = sigmoid(seen @ model.curve[:3] + model.curve[3])
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), pa.array(points)], ["doc_id", "score"])
        scorer.forget()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tx.giving_back(look), "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; decided where the row is."""
    model, columns = fit(docs, labels, rows), docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            seen = np.array([scorer.measures(t) for t in tx.column(batch, "text")], float).reshape(-1, 3)
            points = sigmoid(seen @ model.curve[:3] + model.curve[3])
            yield batch.filter(pa.array(points < 0.5))
        scorer.forget()

    return docs.mapInArrow(tx.giving_back(clean), docs.schema).select(*columns)
