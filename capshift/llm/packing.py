"""Operator 3: packing documents into windows by non-negative least squares.

A document is its token ids and an end id. Windows of ``WINDOW`` ids are cut off a
document from its start and fill a sequence each; what remains (fewer than a window)
is rounded up to units of ``UNIT`` ids. For the remainders of a block of documents:

1. enumerate the shallow combinations (at most three lengths) that fill a window,
2. solve how often to use each against the histogram of lengths, by non-negative
   least squares (active set), and round,
3. pack the remainders left over greedily: the longest first, then the longest that
   still fits; where none fits and much is free, a remainder is cut to fill it. A last
   sequence that stays open is cut at powers of two, which need no padding.

A block is up to ``BLOCK_TOKENS`` ids of consecutive documents of one partition, so
memory is bounded, nothing is shuffled, no group of equal lengths meets in one task,
and a lost task is simply run again. Sequence ids are unique over the whole result.

Words are encoded through a table of recent words: the tokenizer never looks across
white space, so a word's ids do not depend on its neighbours (texts with a special
token's string or the character 0x01, which marks the ends of words when many are
encoded at once, are encoded whole).

Defined cases: a null or empty text is its end id alone; a very long text is many
windows; rows that repeat a doc_id are separate documents; an empty table gives no
pieces. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import in_slices
from capshift.llm.hashing import span_hashes, word_spans

WINDOW, UNIT, END = 2048, 8, 1
BLOCK_TOKENS = 4_000_000
MOST_FREE = 32  # ids of a sequence of remainders that may stay free without cutting
KEPT_WORDS = 1_200_000  # of about 40 bytes
BLOCK_BYTES = 1 << 20  # text hashed at once
MARK = b"\x01"
SPACES = [bytes([c]) for c in b" \t\n\x0b\x0c\r"]
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")


class WordEncoder:
    """Texts to little-endian unsigned 32-bit ids, each recent distinct word encoded once.

    Words are told apart by 64-bit hashes of their bytes and kept as numbers in numpy:
    sorted hashes, and where each word's ids lie in one pool. That is about 40 bytes a
    word; with ``KEPT_WORDS`` words the table starts anew from the words at hand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.apart = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] + [MARK]
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError(f"{path}: the mark between words is not one id")
        self.mark = mark[0]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has; a mark between words shows where they end.

        A few thousand words at a time: what the tokenizer returns besides the ids takes much memory.
        """
        joined = [(b" " + MARK + b" ").join([*words[at:at + 500], b""]).decode() for at in range(0, len(words), 500)]
        parts = []
        for at in range(0, len(joined), 10):
            parts += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(joined[at:at + 10], add_special_tokens=False)]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Take in words under their hashes, which the table does not hold."""
        if len(self.keys) + len(keys) > KEPT_WORDS:
            self._forget()
        ids, size = self._encode(words)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, ids))
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(old, place, new) for old, new in (
            (self.keys, keys), (self.at, at), (self.size, size)))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key in the table, and whether it is there."""
        place = np.searchsorted(self.keys, keys)
        there = place < len(self.keys)
        there[there] = self.keys[place[there]] == keys[there]
        return place, there

    def _block(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of every piece."""
        data = np.frombuffer(b"\n".join(pieces), np.uint8)
        start, end = word_spans(data)
        keys, first, word = np.unique(span_hashes(data, start, end, fold=False), return_index=True, return_inverse=True)
        place, there = self._find(keys)
        if not there.all():
            if len(self.keys) + int((~there).sum()) > KEPT_WORDS:
                there[:] = False
            new = first[~there]
            self._learn(keys[~there], [data[a:b].tobytes() for a, b in zip(start[new].tolist(), end[new].tolist())])
            place, there = self._find(keys)
        size = self.size[place][word]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[place][word] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        close = np.cumsum([len(p) + 1 for p in pieces])
        cuts = np.concatenate(([0], ends))[np.searchsorted(start, close)]
        return np.split(ids, cuts[:-1])

    def __call__(self, sample: list[bytes]) -> list[bytes]:
        """Ids of every text as bytes."""
        out: list[list[np.ndarray]] = [[] for _ in sample]
        pieces, owners, held = [], [], 0

        def done():
            for owner, ids in zip(owners, self._block(pieces)):
                out[owner].append(ids)

        for i, text in enumerate(sample):
            if any(s in text for s in self.apart):
                out[i].append(self._whole(text))
                continue
            for piece in cut_at_space(text, BLOCK_BYTES):
                if len(piece) > 2 * BLOCK_BYTES:  # hardly any white space in it
                    if pieces:
                        done()
                        pieces, owners, held = [], [], 0
                    out[i].append(self._whole(piece))
                    continue
                pieces.append(piece)
                owners.append(i)
                held += len(piece)
                if held >= BLOCK_BYTES:
                    done()
                    pieces, owners, held = [], [], 0
        if pieces:
            done()
        return [np.concatenate(p).astype("<u4").tobytes() if p else b"" for p in out]


def cut_at_space(text: bytes, size: int):
    """The text in pieces of at most about ``size`` bytes, cut at white space (a piece without any stays whole)."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(c, at + 1, at + size) for c in SPACES)
        if cut < 0:
            cut = min((p for p in (text.find(c, at + size) for c in SPACES) if p >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder: a Python worker serves many tasks, and words one task met help the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def combinations(units: int) -> np.ndarray:
    """All sorted (a, b, c) with a + b + c = units; zero marks an unused place."""
    return np.array([(a, b, units - a - b) for a in range(units // 3 + 1) for b in range(a, (units - a) // 2 + 1)])


_COMBINATIONS = combinations(WINDOW // UNIT)


def solve_repeats(histogram: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts x with sum_ways x * (lengths of the way) near the histogram.

    An active-set method (Lawson-Hanson): ways of largest gradient, sharing no length,
    enter together; it ends when no way would be used half a time more.
    """
    size = len(histogram)
    # A way with a length that nothing has would only be left unfilled.
    usable = ((ways == 0) | (histogram[ways] > 0)).all(axis=1)
    ways_of = np.flatnonzero(usable)
    x, passive = np.zeros(len(ways)), np.zeros(len(ways), bool)
    if not len(ways_of):
        return x

    def columns(on):
        a = np.zeros((size, len(on)))
        for place in range(ways.shape[1]):
            np.add.at(a, (ways[on, place], np.arange(len(on))), 1.0)
        a[0] = 0
        return a

    residual = histogram.astype(float).copy()
    residual[0] = 0
    for _ in range(size):
        gradient = residual[ways].sum(axis=1)
        gradient[passive | ~usable] = -np.inf
        entered, used = 0, np.zeros(size, bool)
        for way in np.argsort(-gradient)[:64].tolist():
            lengths = [p for p in ways[way].tolist() if p]
            if gradient[way] <= 0.5 or entered == 16:
                break
            if not used[lengths].any():
                used[lengths] = True
                passive[way] = True
                entered += 1
        if not entered:
            break
        while True:
            on = np.flatnonzero(passive)
            held = columns(on)
            gram = held.T @ held
            gram[np.diag_indices(len(on))] += 1e-6
            z = np.linalg.solve(gram, held.T @ histogram)
            low = z <= 1e-9
            if not low.any():
                x[:] = 0
                x[on] = z
                break
            step = float(np.clip(x[on][low] / np.maximum(x[on][low] - z[low], 1e-12), 0, 1).min())
            x[on] += step * (z - x[on])
            gone = on[(x[on] <= 1e-9) & low]
            x[gone] = 0
            passive[gone] = False
            if not len(gone):
                break
        on = np.flatnonzero(passive)
        residual = histogram - columns(on) @ x[on]
        residual[0] = 0
    return x


def place_remainders(lengths: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, to) pieces over remainders 0..n-1 of the given lengths (1..WINDOW-1)."""
    units = -(-lengths // UNIT)
    size = WINDOW // UNIT + 1
    stock = [[] for _ in range(size)]
    for i in np.lexsort((-np.arange(len(lengths)), -lengths))[::-1].tolist():  # pops give the longest first
        stock[units[i]].append(i)
    histogram = np.bincount(units, minlength=size).astype(float)
    repeats = np.rint(solve_repeats(histogram, _COMBINATIONS)).astype(int)
    out = []
    for way in np.argsort(-repeats, kind="stable"):
        if repeats[way] == 0:
            break
        parts = [p for p in _COMBINATIONS[way].tolist() if p]
        need = {p: parts.count(p) for p in parts}
        for _ in range(min(repeats[way], *(len(stock[p]) // n for p, n in need.items()))):
            out.append([(i, 0, int(lengths[i])) for i in (stock[p].pop() for p in parts)])
    rest = sorted((int(lengths[i]), i, 0) for bin_ in stock for i in bin_)  # (length, item, from)
    while rest:
        length, item, at = rest.pop()
        sequence, free = [(item, at, at + length)], WINDOW - length
        while rest and free:
            fit = bisect_right(rest, (free, 1 << 62, 0)) - 1
            if fit >= 0:
                length, item, at = rest.pop(fit)
            elif free > MOST_FREE:
                whole, item, at = rest.pop(0)
                length = free
                left = (whole - free, item, at + free)
                rest.insert(bisect_right(rest, left), left)
            else:
                break
            sequence.append((item, at, at + length))
            free -= length
        if free > MOST_FREE and not rest:
            out += at_powers_of_two(sequence)
        else:
            out.append(sequence)
    return out


def at_powers_of_two(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One open sequence as sequences whose totals are powers of two, largest first."""
    out, pieces = [], list(reversed(sequence))
    total = sum(to - at for _, at, to in sequence)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        filled = []
        while room:
            item, at, to = pieces.pop()
            take = min(room, to - at)
            filled.append((item, at, at + take))
            if at + take < to:
                pieces.append((item, at + take, to))
            room -= take
        out.append(filled)
    return out


def pack_block(ids: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(document, start, end, sequence, offset) pieces of a block; documents are 4 bytes an id."""
    out, sequence = [], 0
    held, lengths, starts = [], [], []
    for doc, raw in enumerate(ids):
        n = len(raw) // 4
        full = n // WINDOW
        for k in range(full):
            out.append((doc, k * WINDOW, (k + 1) * WINDOW, sequence, 0))
            sequence += 1
        if n % WINDOW:
            held.append(doc)
            starts.append(full * WINDOW)
            lengths.append(n % WINDOW)
    for pieces in place_remainders(np.array(lengths, np.int64)) if held else []:
        offset = 0
        for item, at, to in pieces:
            out.append((held[item], starts[item] + at, starts[item] + to, sequence, offset))
            offset += to - at
        sequence += 1
    return out


def pack(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece of every document (SCHEMA); ``path`` is the tokenizer file."""
    def run(batches):
        encode = encoder(path)
        end = np.array([END], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        names, ids, held = [], [], 0

        def emit():
            nonlocal first, names, ids, held
            pieces = pack_block(ids)
            rows = [(names[d], a, b - a, zlib.crc32(ids[d][4 * a:4 * b]), len(ids[d]) // 4, first + s, o)
                    for d, a, b, s, o in pieces]
            first += 1 + max(p[3] for p in pieces)
            names, ids, held = [], [], 0
            fields = [f.split()[0] for f in SCHEMA.split(", ")]
            for at in range(0, len(rows), 50_000):
                columns = list(zip(*rows[at:at + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], fields)

        for part in in_slices(batches, 256):
            names += part.column(0).to_pylist()
            new = [raw + end for raw in encode([t or b"" for t in part.column(1).to_pylist()])]
            ids += new
            held += sum(map(len, new)) // 4
            if held >= BLOCK_TOKENS:
                yield from emit()
        if ids:
            yield from emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)
