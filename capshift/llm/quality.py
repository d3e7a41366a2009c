"""Operator 6: quality from a factorisation machine.

Features of a text: its hashed words (share of the text), structure statistics (how
often words repeat, capitals, symbols, digits, lengths, runs of one word, lines) and
metadata that the text itself gives (its length). Every pair of features interacts
through low-rank factors:

    y = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]

which is linear in the number of features (the sum-of-squares identity). Trained in
numpy (AdaGrad, mini-batches) on at most about 2 x ``PER_CLASS`` labelled texts; the
model is a fixed table of ``BUCKETS`` + statistics rows.

Defined cases: null and empty texts have only the statistics of an empty text; a very
long text is scored whole; rows that repeat are scored alike. With no usable labels
of both classes every score is the share of label 1 (1 without labels, so nothing is
rejected unlearnt). Columns other than doc_id and text never reach the score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import collect_training, held_out, in_slices, texts, training_sample
from capshift.llm.toxicity import drop_rows

PER_CLASS = 2500
BUCKETS, RANK = 1 << 14, 6
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.1, 1e-5
THRESHOLD = 0.5
KEPT_WORDS = 100_000

# Byte classes: 0 other, 1 lower-case letter or any non-ASCII byte, 2 capital, 3 digit, 4 space, 5 usual
# punctuation, 6 symbol.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 1, 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()?-"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
STATISTICS = 14


def statistics(raw: bytes, ids: np.ndarray, words: int) -> np.ndarray:
    """Structure statistics of a text, each about between 0 and 1."""
    n = max(len(raw), 1)
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / n
    if words:
        _, count = np.unique(ids, return_counts=True)
        p = count / words
        distinct, top, spread = len(count) / words, p.max(), -(p * np.log2(p)).sum() / max(np.log2(words), 1)
        pairs = ids[1:] * 131 + ids[:-1]
        same = float((ids[1:] == ids[:-1]).mean()) if words > 1 else 0.0
        pair_distinct = len(np.unique(pairs)) / max(len(pairs), 1)
    else:
        distinct = top = spread = same = pair_distinct = 0.0
    return np.array([1.0, distinct, top, spread, same, pair_distinct, share[1], share[2] * 2, share[3] * 4, share[4],
                     share[5] * 4, min(share[6] * 4, 2.0), np.log1p(words) / 10, min(n / max(words, 1), 40) / 20])


class Features:
    """(indices, values) of a text: hashed words first, statistics after them."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass"))
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        stats = statistics(text.encode("utf-8", "surrogatepass"), ids, len(words))
        bucket, count = np.unique(ids % BUCKETS, return_counts=True)
        share = np.sqrt(count / max(len(words), 1)) * 0.5
        return (np.concatenate((bucket, BUCKETS + np.arange(STATISTICS))).astype(np.int32),
                np.concatenate((share, stats)).astype(np.float32))


class Model:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors
        self.squares = factors * factors

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        summed = value @ self.factors[index]
        return float(self.bias + value @ self.linear[index]
                     + 0.5 * (summed @ summed - (value * value) @ self.squares[index].sum(axis=1)))


def train(sample: list[str], y: np.ndarray, seed: int = 1) -> Model:
    size = BUCKETS + STATISTICS
    rng = np.random.default_rng(seed)
    linear = np.zeros(size, np.float32)
    factors = rng.normal(0, 0.05, (size, RANK)).astype(np.float32)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))), linear, np.zeros_like(factors))
    make = Features()
    rows = [make(t) for t in sample]
    share = float(y.mean())
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    bias = 0.0
    seen = [np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32), 1e-2]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            index = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            length = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate(([0], np.cumsum(length)[:-1]))
            held = factors[index] * value[:, None]
            summed = np.add.reduceat(held, starts)
            margin = (bias + np.add.reduceat(linear[index] * value, starts)
                      + 0.5 * ((summed * summed).sum(axis=1) - np.add.reduceat((held * held).sum(axis=1), starts)))
            wrong = weight[part] * (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - y[part]) / len(part)
            each = np.repeat(wrong, length).astype(np.float32) * value
            touched, where = np.unique(index, return_inverse=True)
            g_linear = np.bincount(where, each).astype(np.float32) + DECAY * linear[touched]
            pull = each[:, None] * (np.repeat(summed, length, axis=0) - held)
            g_factors = np.stack([np.bincount(where, pull[:, f]) for f in range(RANK)], axis=1).astype(np.float32)
            g_factors += DECAY * factors[touched]
            g_bias = float(wrong.sum())
            seen[0][touched] += g_linear ** 2
            seen[1][touched] += g_factors ** 2
            seen[2] += g_bias ** 2
            linear[touched] -= RATE * g_linear / np.sqrt(seen[0][touched])
            factors[touched] -= RATE * g_factors / np.sqrt(seen[1][touched])
            bias -= RATE * g_bias / np.sqrt(seen[2])
    return Model(bias, linear, factors)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.features = model, Features()

    def __call__(self, sample: list[str]) -> np.ndarray:
        margin = np.array([self.model.margin(*self.features(t)) for t in sample])
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(*collect_training(training_sample(docs, labels, "quality", per_class)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for part in in_slices(batches, 256):
            p = scorer(texts(part))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p),
                                              pa.array((p >= THRESHOLD).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def drop_low_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows of predicted low quality; columns and the other rows unchanged."""
    return drop_rows(docs, model, Scorer, lambda p: p < THRESHOLD)
