"""Operator 8: byte-level BPE encoding and decoding through a table of distinct words.

Texts are split into words at single spaces and line ends, where the tokenizer always
splits too; a word carries the space before it. Per block of documents the words are
numbered, so a text becomes a short array of word numbers (positions). Then

1. the blocks' distinct words are partitioned by hash into buckets, and each distinct
   word is encoded once, in its bucket (a word comes at most once per block, so no word
   is a hot key; a bucket's table is dropped with the bucket, and the number of buckets
   follows the number of shuffle partitions),
2. the ids come back to their block, and every document's ids are put together by
   position (co-grouped by block; a block is bounded by ``BLOCK_CHARS``),
3. ids are decoded by joining them to the id-to-piece table by position. The table has
   one row per id of the vocabulary (50,257, a fixed bound), so it is held by every task.

Words, numbers and ids travel as compressed columns, one row per block and bucket.

Around runs of three or more white-space characters, or two at the end, a word takes
the run and its neighbours; a text with a special token's string is one word: there
the tokenizer's splits depend on what follows.

The split of a text is computed once for the words and once for the positions; block
numbers come from the partition and the order in it, which a scan repeats exactly.
Should an input not repeat itself, the missing number raises an error instead of
giving wrong ids.

Defined cases: a null or empty text has no ids and decodes to the empty text; a very
long text is one document of a block; rows that repeat a doc_id are separate
documents; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import in_slices, texts

BLOCK_CHARS, BLOCK_WORDS = 32_000_000, 600_000
LONG_RUN = re.compile(r"\s\s(?:\s|\Z)")
SINGLE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def split_words(text: str, special: list[str]) -> list[str]:
    """Pieces of the text, in order, whose ids do not depend on their neighbours."""
    if "\0" in text or any(s in text for s in special):
        return [text]
    if LONG_RUN.search(text):
        return SINGLE.split(text)
    return [w for w in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if w]


class _Numbers(dict):
    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _blocks(batches, special):
    """(block, numbers of its words, [(doc_id, word numbers)]) for consecutive documents of a partition."""
    block = TaskContext.get().partitionId() << 32
    numbers, docs, chars = _Numbers(), [], 0
    for part in in_slices(batches):
        for doc_id, text in zip(part.column(0).to_pylist(), texts(part)):
            words = split_words(text, special)
            docs.append((doc_id, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
            chars += len(text)
            if chars >= BLOCK_CHARS or len(numbers) >= BLOCK_WORDS:
                yield block, numbers, docs
                block, numbers, docs, chars = block + 1, _Numbers(), [], 0
    if docs:
        yield block, numbers, docs


def _packed(values: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values if isinstance(values, bytes) else values.tobytes())


def _unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """32-bit numbers, low and high halves apart (most high halves are zero)."""
    return _packed(np.concatenate((numbers & 0xFFFF, numbers >> 16)).astype(np.uint16))


def _unpack_numbers(raw: bytes) -> np.ndarray:
    low, high = np.frombuffer(_unpacked(raw), np.uint16).reshape(2, -1).astype(np.int64)
    return low | high << 16


def _distinct_words(special, buckets):
    """(bucket, block, numbers, words): a block's words, one row per bucket of their hash."""
    def run(batches):
        for block, known, _ in _blocks(batches, special):
            words = list(known)
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            bucket = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % buckets
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, order[x:y]) for b, x, y in zip(range(buckets), ends[:-1], ends[1:]) if y > x]
            for at in range(0, len(rows), 64):
                part = rows[at:at + 64]
                yield pa.record_batch({
                    "bucket": pa.array([b for b, _ in part], pa.int32()), "block": pa.array(np.full(len(part), block)),
                    "numbers": pa.array([_pack_numbers(n) for _, n in part], pa.binary()),
                    "words": pa.array([_packed(b"".join(raw[i] for i in n.tolist())) for _, n in part], pa.binary()),
                    "lengths": pa.array([_pack_numbers(np.array([len(raw[i]) for i in n.tolist()], np.int64))
                                         for _, n in part], pa.binary())})

    return run


def _positions(special):
    """(block, doc_ids, counts, numbers): the word numbers of some documents of a block, one after another."""
    def run(batches):
        for block, _, docs in _blocks(batches, special):
            for at in range(0, len(docs), 1000):
                part = docs[at:at + 1000]
                yield pa.record_batch({
                    "block": pa.array([block]), "doc_ids": pa.array([[d for d, _ in part]], pa.list_(pa.int64())),
                    "counts": pa.array([[len(n) for _, n in part]], pa.list_(pa.int64())),
                    "numbers": pa.array([_pack_numbers(np.concatenate([n for _, n in part]))], pa.binary())})

    return run


def _encode_bucket(path):
    """The ids of every word; rows come bucket by bucket, and a word is encoded once in its bucket."""
    def run(batches):
        tokenizer = load(path)
        kind = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        known: dict[bytes, bytes] = {}
        here = None
        for part in batches:
            for i in range(part.num_rows):
                bucket, block, numbers, joined, lengths = (c[i].as_py() for c in part.columns)
                if bucket != here:
                    here, known = bucket, {}
                raw, end = _unpacked(joined), np.cumsum(_unpack_numbers(lengths)).tolist()
                words = [raw[x:y] for x, y in zip([0, *end], end)]
                new = [w for w in words if w not in known]
                for at in range(0, len(new), 5000):
                    some = new[at:at + 5000]
                    found = tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in some],
                                                        add_special_tokens=False)
                    known.update((w, np.array(e.ids, kind).tobytes()) for w, e in zip(some, found))
                ids = [known[w] for w in words]
                size = np.dtype(kind).itemsize
                yield pa.record_batch({
                    "block": pa.array([block]), "numbers": pa.array([numbers], pa.binary()),
                    "ids": pa.array([_packed(b"".join(ids))], pa.binary()),
                    "lengths": pa.array([_pack_numbers(np.array([len(x) // size for x in ids], np.int64))], pa.binary())})

    return run


class Ragged:
    """Rows of different lengths in one flat array; ``take`` puts rows one after another."""

    def __init__(self, flat: np.ndarray, length: np.ndarray, start: np.ndarray | None = None):
        self.flat, self.length = flat, length
        self.start = np.cumsum(length) - length if start is None else start

    def reordered(self, order: np.ndarray) -> Ragged:
        return Ragged(self.flat, self.length[order], self.start[order])

    def take(self, rows: np.ndarray) -> np.ndarray:
        length = self.length[rows]
        total = int(length.sum())
        shift = np.repeat(self.start[rows] - (np.cumsum(length) - length), length)
        return self.flat[shift + np.arange(total)]


def piece_table(tokenizer) -> Ragged:
    """The bytes of every id (the id-to-piece table)."""
    # Byte-level BPE writes bytes as printable characters: those below as themselves,
    # the other bytes, in order, as the characters from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in plain}
    to_byte.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(plain)))
    rows = [b""] * tokenizer.get_vocab_size()
    for piece, at in tokenizer.get_vocab().items():
        rows[at] = (bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece)
                    else piece.encode("utf-8", "surrogatepass"))
    return Ragged(np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows], np.int64))


def decode(ids: np.ndarray, pieces: Ragged) -> bytes:
    """The text of ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
    raw = pieces.take(ids.astype(np.int64)).tobytes()
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode("utf-8")


def _put_together(path, finish, schema: pa.Schema):
    state = {}

    def run(key, docs: pa.Table, words: pa.Table) -> pa.Table:
        if not state:
            tokenizer = load(path)
            state.update(pieces=piece_table(tokenizer),
                         kind="<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        numbers, lengths = ([_unpack_numbers(v) for v in words.column(c).to_pylist()] for c in ("numbers", "lengths"))
        numbers, lengths = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (numbers, lengths))
        flat = np.frombuffer(b"".join(map(_unpacked, words.column("ids").to_pylist())), state["kind"])
        order = np.argsort(numbers)
        if not np.array_equal(numbers[order], np.arange(len(order))):
            raise RuntimeError("the words of a block are not numbered 0, 1, 2, ...")
        table = Ragged(flat, lengths, (np.cumsum(lengths) - lengths)).reordered(order)
        out = []
        for doc_ids, counts, raw in zip(*(docs.column(c).to_pylist() for c in ("doc_ids", "counts", "numbers"))):
            at, places = 0, _unpack_numbers(raw)
            for doc_id, n in zip(doc_ids, counts):
                out.append((doc_id, *finish(table.take(places[at:at + n]), state["pieces"])))
                at += n
        columns = list(zip(*out)) if out else [[] for _ in schema]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _apply(docs: DataFrame, path: str, finish, schema: pa.Schema, ddl: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    special = special_strings(load(path))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = rows.mapInArrow(_distinct_words(special, buckets),
                            "bucket int, block long, numbers binary, words binary, lengths binary")
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _encode_bucket(path), "block long, numbers binary, ids binary, lengths binary")
    positions = rows.mapInArrow(_positions(special), "block long, doc_ids array<long>, counts array<long>, numbers binary")
    return (positions.groupBy("block").cogroup(ids.groupBy("block"))
            .applyInArrow(_put_together(path, finish, schema), ddl))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with ids as little-endian unsigned 32-bit integers in one binary."""
    return _apply(docs, path, lambda ids, _: (ids.astype("<u4").tobytes(),),
                  pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]), "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids) as ``encode`` gives them."""
    def run(batches):
        pieces = piece_table(load(path))
        for part in in_slices(batches):
            text = [decode(np.frombuffer(raw or b"", "<u4"), pieces).decode("utf-8") for raw in part.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": part.column(0), "text": pa.array(text, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding every document."""
    def finish(ids, pieces):
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(decode(ids, pieces)).hexdigest())

    return _apply(docs, path, finish, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                                                 ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
                  "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
