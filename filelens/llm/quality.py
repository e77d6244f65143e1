"""Text quality by a convolutional network over bytes, in numpy.

The whole text is cut into overlapping chunks. Bytes become learned vectors, learned
filters slide over them, and the largest answer of each filter in a chunk stands for
the chunk, beside how well the chunk matches itself a few bytes on (which is how a
filter sees that words repeat). Means and maxima over all chunks are combined into
one probability. Training is by stochastic gradients on a bounded sample of labelled
documents; only the window that answered most in a chunk is learned from.

Rows: null and empty texts are one empty chunk; repeated rows get a row each; a null
id is held out; without labels of both kinds every score is the share of label 1 that
was seen (0.5 without any). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm import text as tx
from filelens.llm.labels import held_out, labelled_sample, sigmoid, texts_of

FIT_ROWS = 5000  # labelled documents that are learned from at most
FIT_LONGEST = 50_000  # longer texts are scored whole but not learned from
CHUNK, STEP = 512, 448  # bytes of a chunk, and from one chunk to the next
WIDTH, STRIDE = 12, 4
EMBED, FILTERS = 6, 24
LAGS = range(2, 33)
EPOCHS, BATCH, RATE = 12, 64, 0.01
GROUP = 128  # chunks that are looked at together

PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover all bytes (the last is filled up with zeros),
    and for each the best share of its bytes that equal the byte some lag before."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    count = max(-(-(len(data) - CHUNK) // STEP), 0) + 1
    filled = np.zeros((count - 1) * STEP + CHUNK, np.uint8)
    filled[: len(data)] = data
    best = np.zeros(count, np.float32)
    for at in range(0, count, GROUP):
        chunk = np.arange(at, min(at + GROUP, count))
        own = filled[at * STEP : chunk[-1] * STEP + CHUNK]
        inside = min(len(data) - at * STEP, len(own))
        # Equal bytes as bits, 64 of them counted at once; chunks are made of such words.
        same = np.zeros((len(LAGS), len(own)), bool)
        for row, lag in enumerate(LAGS):
            if inside > lag:
                np.equal(own[lag:inside], own[: inside - lag], out=same[row, lag:inside])
        words = np.bitwise_count(np.packbits(same, axis=1).view(np.uint64))
        sums = np.zeros((len(LAGS), words.shape[1] + 1), np.int32)
        np.cumsum(words, axis=1, out=sums[:, 1:])
        first = (chunk - at) * (STEP // 64)
        held = np.clip(len(data) - chunk * STEP, 16, CHUNK)
        best[chunk] = (sums[:, first + CHUNK // 64] - sums[:, first]).max(0) / held
    return np.lib.stride_tricks.sliding_window_view(filled, CHUNK)[::STEP], best


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # weights of means, maxima and the constant

    @classmethod
    def new(cls, seed: int = 11) -> Network:
        draw = np.random.default_rng(seed)
        shape = lambda *s, scale: draw.normal(0, scale, s).astype(np.float32)
        return cls(
            shape(256, EMBED, scale=0.5), shape(WIDTH * EMBED, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32),
            np.zeros(2 * (FILTERS + 1) + 1, np.float32),
        )

    def answers(self, block: np.ndarray) -> np.ndarray:
        """Per chunk and place the answers of the filters. A filter is as wide as
        several strides: each stride is multiplied once, then added up."""
        parts = self.filters.reshape(WIDTH // STRIDE, STRIDE * EMBED, FILTERS)
        strides = self.embed[block].reshape(-1, STRIDE * EMBED)
        made = (strides @ parts[0]).reshape(len(block), -1, FILTERS)[:, :PLACES]
        for at in range(1, len(parts)):
            made = made + (strides @ parts[at]).reshape(len(block), -1, FILTERS)[:, at : at + PLACES]
        return made

    def document(self, text: str | None) -> np.ndarray:
        """Means and maxima over all chunks of one text."""
        block, match = chunks(text)
        total, most = np.zeros(FILTERS + 1), np.full(FILTERS + 1, -np.inf)
        for at in range(0, len(block), GROUP):
            top = np.maximum(self.answers(block[at : at + GROUP]).max(1) + self.bias, 0)
            pooled = np.hstack([top, match[at : at + GROUP, None]])
            total += pooled.sum(0)
            most = np.maximum(most, pooled.max(0))
        return np.concatenate([total / len(block), most])

    def winners(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per chunk the largest answers of the filters, and where."""
        made = np.ascontiguousarray(self.answers(block).transpose(0, 2, 1))
        where = made.argmax(2)
        top = np.take_along_axis(made, where[:, :, None], 2)[:, :, 0] + self.bias
        return np.maximum(top, 0), where


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Adam over small batches of whole documents."""
    net, draw = Network.new(), np.random.default_rng(5)
    names = ("embed", "filters", "bias", "out")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    net.out[-1] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    cut, match = zip(*map(chunks, texts), strict=True)
    step = 0
    for epoch in range(epochs):
        order = draw.permutation(len(texts))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            block = np.concatenate([cut[i] for i in picked])
            owner = np.repeat(np.arange(len(picked)), [len(cut[i]) for i in picked])
            starts = np.searchsorted(owner, np.arange(len(picked)))
            parts = [net.winners(block[i : i + GROUP]) for i in range(0, len(block), GROUP)]
            top, where = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            answers = np.hstack([top, np.concatenate([match[i] for i in picked])[:, None]])
            sizes = np.bincount(owner, minlength=len(picked))[:, None]
            means, most = np.add.reduceat(answers, starts) / sizes, np.maximum.reduceat(answers, starts)
            x = np.hstack([means, most, np.ones((len(picked), 1))])
            error = (sigmoid(x @ net.out) - labels[picked]) / len(picked)
            back_mean, back_most = error[:, None] * net.out[:FILTERS], error[:, None] * net.out[FILTERS + 1 : 2 * FILTERS + 1]
            back = back_mean[owner] / sizes[owner] + back_most[owner] * (top == most[owner][:, :FILTERS])
            back *= top > 0
            # The winning windows: chunk, filter -> bytes.
            rows = np.arange(len(block))[:, None, None]
            bytes_at = block[rows, where[:, :, None] * STRIDE + np.arange(WIDTH)]
            felt = net.embed[bytes_at].reshape(len(block), FILTERS, WIDTH * EMBED)
            grads = {
                "filters": np.einsum("cf,cfw->wf", back, felt),
                "bias": back.sum(0),
                "out": x.T @ error + 1e-4 * net.out,
            }
            spread = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            flat = bytes_at.reshape(-1)
            grads["embed"] = np.stack([np.bincount(flat, spread[:, e], 256) for e in range(EMBED)], 1)
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                change = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - rate * change).astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Network:
    texts = texts_of(docs.where(F.coalesce(F.length("text"), F.lit(0)) <= FIT_LONGEST), labelled_sample(labels, "quality", rows))
    seen = texts.orderBy("doc_id").select("text", "label").toPandas()  # at most ``rows`` bounded texts
    known = seen.label.to_numpy(float)
    if len(known) and known.min() != known.max():
        return train(seen.text.tolist(), known)
    net = Network.new()
    net.out[-1] = np.log((known.sum() + 0.5) / (len(known) - known.sum() + 0.5))
    return net


def score(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.array([net.document(t) for t in tx.column(batch, "text")]).reshape(-1, 2 * (FILTERS + 1))
            points = sigmoid(seen @ net.out[:-1] + net.out[-1])
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), pa.array(points)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
