"""Language of a text: first its family, then the language within the family.

A text is a vector of hashed letter n-grams (bytes of the lower-cased letters, one to
four of them), square roots of their shares. Families are told apart by one-versus-one
linear support vector machines, and so are the languages of one family; most votes
win, then the larger margins. A language without a known family is a family of its
own. Learned from a bounded sample of labelled documents, equally many a language.

Rows: a null text and one without a letter is ``und`` with score 0; a null label is
not learned from; repeated rows get a row each; a null id is held out; if nothing can
be learned every text is ``und``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm import text as tx
from filelens.llm.labels import held_out, sigmoid
from filelens.operators.scale import first_rows

SIZE = 1 << 11
FIT_PER_LANGUAGE, FIT_ROWS = 1500, 8000  # labelled documents that are learned from at most
FIT_LONGEST = 200_000  # longer texts are judged whole but not learned from
EPOCHS, PENALTY = 20, 1e-5

# Families of closely related languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz tk ky",
    "semitic": "ar he mt am",
    "indo-aryan": "hi ur bn pa mr gu ne si",
    "dravidian": "ta te kn ml",
    "iranian": "fa ps ku tg",
    "malayo-polynesian": "id ms tl jv su mg",
    "celtic": "ga gd cy br",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")
_INSIDE = np.zeros(256, bool)
_INSIDE[97:123] = True
_INSIDE[128:] = True
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def vector(text: str) -> np.ndarray:
    """The whole text's n-grams, whatever its length, in ``SIZE`` numbers."""
    total = np.zeros(SIZE)
    for block in tx.blocks(text.lower().encode("utf-8", "surrogatepass")):
        letters = np.where(_INSIDE[block], block, 32).astype(np.uint32)
        kept = np.ones(len(letters), bool)
        kept[1:] = (letters[1:] != 32) | (letters[:-1] != 32)  # gaps count once
        gram = letters[kept] + np.uint32(1)
        own = gram
        for n in range(4):
            if n:
                own = own[:-1] * _FACTORS[n - 1] + gram[n:]
            if not len(own):
                break
            mixed = own ^ (own >> np.uint32(15))
            mixed = mixed * np.uint32(0x2C1B3C6D)
            total += np.bincount((mixed >> np.uint32(21)).astype(np.int64), minlength=SIZE)
    total = np.sqrt(total / max(total.sum(), 1))
    return total.astype(np.float32)


@dataclass
class Machines:
    """One linear machine for each pair of classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: list[str]) -> Machines:
        pairs = list(combinations(range(len(classes)), 2))
        weights = [_machine(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1.0, -1.0)) for a, b in pairs]
        return cls(classes, pairs, np.array(weights, np.float32).T if pairs else None)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and how sure they are: the least margin that the winner won by."""
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = x @ self.weights[:-1] + self.weights[-1]
        votes, sums = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        worst = np.full((len(x), len(self.classes)), np.inf)
        for at, (a, b) in enumerate(self.pairs):
            for one, m in ((a, margins[:, at]), (b, -margins[:, at])):
                votes[:, one] += m > 0
                sums[:, one] += np.tanh(m)
                worst[:, one] = np.minimum(worst[:, one], m)
        best = (votes + sums / (4 * len(self.classes))).argmax(1)
        return best, sigmoid(2 * worst[np.arange(len(x)), best])


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent; both classes weigh
    alike. The last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    cost = np.where(y > 0, len(y) / max(2 * (y > 0).sum(), 1), len(y) / max(2 * (y < 0).sum(), 1)) / (PENALTY * len(y))
    squares, alpha, weights = (x * x).sum(1), np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ weights) - 1) / squares[i], 0.0), cost[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights


@dataclass
class Model:
    families: Machines
    languages: list[Machines]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.families.decide(x)
        names, scores = [""] * len(x), np.zeros(len(x))
        for at, machines in enumerate(self.languages):
            rows = np.flatnonzero(family == at)
            best, within = machines.decide(x[rows])
            scores[rows] = np.minimum(sure[rows], within)
            for row, one in zip(rows.tolist(), best.tolist(), strict=True):
                names[row] = machines.classes[one]
        return names, scores


def sample(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, lang): the first documents by a hash of their id, equally many a
    language, ``rows`` at most in all."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out() & (F.length("text") <= FIT_LONGEST))
    ids = usable.select(F.col("doc_id").cast("long"), "lang").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return first_rows(ids, ["lang"], order, per_language, "_rank").orderBy("_rank", *order).limit(rows).drop("_rank")


def fit(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE, rows: int = FIT_ROWS) -> Model | None:
    chosen = sample(docs, per_language, rows)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch(
                [
                    batch.column(batch.schema.get_field_index("lang")),
                    pa.array([vector(t or "").tobytes() for t in tx.column(batch, "text")], pa.binary()),
                ],
                ["lang", "vector"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("lang", "text")
    seen = texts.where("text RLIKE '\\\\p{L}'").mapInArrow(look, "lang string, vector binary").toPandas()
    if not len(seen):
        return None
    x = np.frombuffer(b"".join(seen.vector), np.float32).reshape(-1, SIZE)
    lang = seen.lang.to_numpy()
    families: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        families.setdefault(_FAMILY.get(code.lower().split("-")[0], code), []).append(code)
    names = sorted(families)
    of = np.array([names.index(_FAMILY.get(c.lower().split("-")[0], c)) for c in lang])
    within = []
    for at, name in enumerate(names):
        rows_in = of == at
        within.append(Machines.fit(x[rows_in], np.array([families[name].index(c) for c in lang[rows_in]]), families[name]))
    return Model(Machines.fit(x, of, names), within)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tx.column(batch, "text")
            lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for at in range(0, len(lettered), 1000):
                rows = lettered[at : at + 1000]
                found, sure = model.predict(np.array([vector(texts[i]) for i in rows]))
                scores[rows] = sure
                for i, name in zip(rows, found, strict=True):
                    names[i] = name
            doc = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.record_batch([doc, pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
