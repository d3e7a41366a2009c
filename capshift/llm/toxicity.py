"""Operator 1: toxicity from subword-bag embeddings and a linear softmax.

A word is the bag of its hashed character n-grams (3 to 5 bytes of ``<word>``) and
itself; a word's vector is the mean of their embeddings, a document's the mean of its
words', and a linear softmax gives the classes. Embeddings and softmax are trained
together in numpy (Adam on the whole sample), so a misspelling unseen in training
shares the n-gram vectors of the words it resembles.

The trainer collects at most about 2 x ``PER_CLASS`` labelled texts. The model is a
fixed ``BUCKETS`` x ``DIM`` table whatever the input. Since mean and softmax margin are
linear, scoring needs one number per word; a task keeps those of recent words and a
text costs one look-up a word. A word of megabytes (a text without spaces) is summed
over stretches of it.

Defined cases: null and empty texts have no words and score the softmax's bias alone;
a very long text is scored whole; rows that repeat are scored alike. With no usable
labels of both classes every score is the share of label 1 (0 without labels).
Columns other than doc_id and text never reach the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import collect_training, held_out, in_slices, texts, training_sample
from capshift.llm.hashing import mix

PER_CLASS = 3000
BUCKETS, DIM = 1 << 17, 8
NGRAMS = (3, 4, 5)
SCALE = 300.0  # temperature of the softmax
ROUNDS, RATE, DECAY = 80, 0.05, 2e-4
THRESHOLD = 0.7
LEAST_SHARE, LEAST_MOST = 1 / 200, 20  # documents of the sample a word must occur in to be trained
CALM = 20  # words without a say in every mean, so that a few words alone decide little
KEPT_WORDS = 100_000
CHUNK = 1 << 20  # characters of words hashed at once
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The distinct words of a text."""
    return sorted(set(text.lower().split()))


def _bytes_of(word: str) -> bytes:
    return b"<" + word.strip(".,;:!?\"'()").encode("utf-8", "surrogatepass") + b">"


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword, number of subwords per word), words in order."""
    raw = [_bytes_of(w) for w in words]
    length = np.array([len(b) for b in raw])
    end = np.cumsum(length)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(raw)), length)
    left = end[word] - np.arange(len(data))  # bytes from here to the word's end
    owner, bucket = [], []
    rolled = np.zeros(len(data), np.uint64)
    for n in range(1, min(max(NGRAMS), len(data)) + 1):
        rolled[:len(data) - n + 1] = mix(rolled[:len(data) - n + 1] ^ data[n - 1:]) * _MULTIPLY
        if n in NGRAMS:
            at = np.flatnonzero(left >= n)
            owner.append(word[at])
            bucket.append(rolled[at] + np.uint64(n))
    # The word itself: a sum of its bytes' hashes by place.
    place = (np.arange(len(data)) - (end - length)[word]).astype(np.uint64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(data + place * np.uint64(257) + np.uint64(1)))))
    owner.append(np.arange(len(raw)))
    bucket.append(mix(total[end] - total[end - length]))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner, kind="stable")
    return _bucket(bucket[order]), np.bincount(owner, minlength=len(raw))


class Model:
    """Per-bucket margins (embedding times softmax difference) and the bias."""

    def __init__(self, margin: np.ndarray, bias: float):
        self.margin, self.bias = margin.astype(np.float32), float(bias)

    def word_margins(self, words: list[str]) -> np.ndarray:
        """Mean margin of every word's subwords; long words one by one, the others some megabytes at a time."""
        out, some, held = np.zeros(len(words)), [], 0
        for i, w in enumerate(words):
            if len(w) > CHUNK:
                out[i] = self._long_word(w)
                continue
            some.append(i)
            held += len(w)
            if held >= CHUNK:
                out[some] = self._short_words([words[j] for j in some])
                some, held = [], 0
        if some:
            out[some] = self._short_words([words[j] for j in some])
        return out

    def _short_words(self, words: list[str]) -> np.ndarray:
        bucket, count = subwords(words)
        starts = np.concatenate(([0], np.cumsum(count)[:-1]))
        return np.add.reduceat(self.margin[bucket].astype(np.float64), starts) / count

    def _long_word(self, word: str) -> float:
        """A word's mean margin from running sums over stretches of it."""
        data = np.frombuffer(_bytes_of(word), np.uint8)
        total, count, whole = 0.0, 0, np.uint64(0)
        for at in range(0, len(data), CHUNK):
            part = data[at:at + CHUNK + max(NGRAMS) - 1].astype(np.uint64)
            own = min(CHUNK, len(data) - at)
            rolled = np.zeros(len(part), np.uint64)
            for n in range(1, min(max(NGRAMS), len(part)) + 1):
                rolled[:len(part) - n + 1] = mix(rolled[:len(part) - n + 1] ^ part[n - 1:]) * _MULTIPLY
                if n in NGRAMS:
                    starts = rolled[:max(0, min(own, len(part) - n + 1))]
                    total += float(self.margin[_bucket(starts + np.uint64(n))].sum(dtype=np.float64))
                    count += len(starts)
            place = np.arange(at, at + own).astype(np.uint64)
            whole += mix(part[:own] + place * np.uint64(257) + np.uint64(1)).sum(dtype=np.uint64)
        last = self.margin[_bucket(mix(np.array([whole], np.uint64)))][0]
        return (total + float(last)) / (count + 1)

    def probability(self, mean_margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(SCALE * mean_margin + self.bias, -500, 500)))


def train(sample: list[str], y: np.ndarray, seed: int = 1) -> Model:
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), np.log((share + 1e-6) / (1 - share + 1e-6)))
    vocabulary: dict[str, int] = {}
    doc, word, weight = [], [], []
    for i, text in enumerate(sample):
        tokens = words_of(text)
        if tokens:
            ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in tokens), np.int32, len(tokens))
            doc.append(np.full(len(ids), i, np.int32))
            word.append(ids)
            weight.append(np.full(len(ids), 1 / (len(ids) + CALM), np.float32))
    doc, word, weight = np.concatenate(doc), np.concatenate(word), np.concatenate(weight)
    names = list(vocabulary)
    # A word of a few documents says nothing that repeats: training skips it, and it is
    # scored by the n-grams it shares with others.
    spread = np.bincount(word, minlength=len(names)) >= min(max(2, int(len(y) * LEAST_SHARE)), LEAST_MOST)
    renumber = np.cumsum(spread) - 1
    held = spread[word]
    doc, word, weight = doc[held], renumber[word[held]], weight[held]
    bucket, count = subwords([w for w, s in zip(names, spread) if s] or ["-"])
    bucket = bucket.astype(np.int32)
    starts = np.concatenate(([0], np.cumsum(count)[:-1]))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.1, DIM).astype(np.float32)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    bias, state = 0.0, [[0.0, 0.0] for _ in range(3)]
    for step in range(1, ROUNDS + 1):
        margin = table @ softmax
        per_word = np.add.reduceat(margin[bucket], starts) / count
        score = np.bincount(doc, per_word[word] * weight, minlength=len(y))
        wrong = balance * (1 / (1 + np.exp(-np.clip(SCALE * score + bias, -60, 60))) - y) / len(y)
        d_word = np.bincount(word, SCALE * wrong[doc] * weight, minlength=len(count)) / count
        d_bucket = np.bincount(bucket, np.repeat(d_word, count), minlength=BUCKETS)
        gradients = [np.outer(d_bucket, softmax).astype(np.float32) + DECAY * table,
                     (table.T @ d_bucket).astype(np.float32), wrong.sum()]
        moves = []
        for s, g in zip(state, gradients):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            moves.append(RATE * (1 - (step - 1) / ROUNDS) * (s[0] / (1 - 0.9 ** step)) / (np.sqrt(s[1] / (1 - 0.99 ** step)) + 1e-8))
        table -= moves[0]
        softmax -= moves[1]
        bias -= moves[2]
    return Model(table @ softmax, bias)


class Scorer:
    """Scores texts with a cache of word margins that is emptied when it is full."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, sample: list[str]) -> np.ndarray:
        split = [words_of(t) for t in sample]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        new = list({w for words in split for w in words}.difference(self.known))
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            self.known.update(zip(part, self.model.word_margins(part).tolist()))
        look = self.known.__getitem__
        mean = np.array([sum(map(look, words)) / (len(words) + CALM) for words in split])
        return self.model.probability(mean)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(*collect_training(training_sample(docs, labels, "toxic", per_class)))


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


def drop_rows(docs: DataFrame, model, scorer, reject) -> DataFrame:
    """``docs`` without the rows whose scores ``reject`` marks; columns and the other rows unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    plain = docs.toDF(*[f"c{i}" for i in range(len(schema))])
    column = schema.fieldNames().index("text")

    def run(batches):
        judge = scorer(shared.value)
        for part in in_slices(batches, 256):
            p = judge([t if t is not None else "" for t in part.column(column).to_pylist()])
            yield part.filter(pa.array(~reject(p)))

    return plain.mapInArrow(run, plain.schema).toDF(*schema.fieldNames())


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    return drop_rows(docs, model, Scorer, lambda p: p >= THRESHOLD)
