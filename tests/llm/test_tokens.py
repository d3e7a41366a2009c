"""Operators 3 and 8: equality with the tokenizers library, round trips, whole packings, defined cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from capshift.llm import bpe, packing, queries
from capshift.llm.common import tokenizer_path
from tests.llm.conftest import SF

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
byte_bpe, word_bpe = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
TEXT = st.lists(st.sampled_from(["a", "B", "é", " ", "  ", "\n", "\t", "\r", "\xa0", "'s", "'ll", "1", "23", "²", "!", "<|endoftext|>",
                                 "<|startoftext|>", "İ", "Σ", "́", "中", "\U0001F600", "\x1c", "\x85", "　", "_", "'",
                                 "\0", "ǆ", "word", "."]), max_size=12).map("".join)


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=800, deadline=None)
@given(TEXT)
def test_words_encode_like_whole_texts(text):
    words = bpe.split_words(text, bpe.special_strings(byte_bpe))
    assert "".join(words) == text
    ids = byte_bpe.encode(text, add_special_tokens=False).ids
    assert [i for w in words for i in byte_bpe.encode(w, add_special_tokens=False).ids] == ids
    assert bpe.decode(np.array(ids, np.uint32), bpe.piece_table(byte_bpe)).decode() == byte_bpe.decode(
        ids, skip_special_tokens=False) == text


@settings(max_examples=500, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_word_encoder_matches_library(sample):
    got = packing.encoder(WORD)([t.encode() for t in sample])
    assert got == [as_bytes(word_bpe.encode(t, add_special_tokens=False).ids) for t in sample]


def test_bpe_query(spark):
    got = queries.op8_bpe(spark, SF).toPandas().set_index("doc_id")
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        text = r["text"] or ""
        ids = byte_bpe.encode(text, add_special_tokens=False).ids
        row = got.loc[r["doc_id"]]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(as_bytes(ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_round_trip_of_odd_texts(make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    encoded = bpe.encode(docs, BYTE)
    back = sorted((repr(r["doc_id"]), r["text"]) for r in bpe.decode_ids(encoded, BYTE).collect())
    assert back == sorted((repr(i), t or "") for i, t in odd_rows)
    assert bpe.encode(make_docs([]), BYTE).count() == 0


def check_packing(pieces, texts):
    """Every id in exactly one piece, sequences gapless and full enough; returns the padding."""
    by_sequence = defaultdict(list)
    by_doc = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        raw = as_bytes([*word_bpe.encode(text or "", add_special_tokens=False).ids, packing.END])
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(raw) // 4
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(raw[4 * p["start"]:4 * at])
        assert at == len(raw) // 4
    return padding


def test_packing_query(spark):
    pieces = queries.op3_packing(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    padding = check_packing(pieces, texts)
    assert padding <= 0.01 * sum(p["length"] for p in pieces)


def test_packing_defined_cases(make_docs, odd_rows):
    unique = [(i, t) for i, (_, t) in enumerate(odd_rows)]
    check_packing(packing.pack(make_docs(unique, clash=True), WORD).collect(), dict(unique))
    lost = packing.pack(make_docs(odd_rows), WORD).where("doc_id is null").groupBy().sum("length").first()[0]
    assert lost == len(word_bpe.encode("lost id here now", add_special_tokens=False).ids) + 1
    assert packing.pack(make_docs([]), WORD).count() == 0


@pytest.mark.parametrize("lengths", [[1100] * 500, [2047] * 50, [1] * 3000, [5], [700, 700, 648] * 40, []])
def test_any_lengths_pack_whole(lengths):
    ids = [as_bytes(np.arange(n) % 1000) for n in lengths]
    total = defaultdict(int)
    seen = defaultdict(int)
    for doc, a, b, sequence, offset in packing.pack_block(ids):
        assert offset == total[sequence]
        total[sequence] += b - a
        seen[doc] += b - a
    assert [seen[i] for i in range(len(lengths))] == lengths
    padding = sum(0 if t & (t - 1) == 0 else packing.WINDOW - t for t in total.values())
    assert padding <= 0.02 * sum(lengths)


def test_least_squares_repeats():
    """The optimality conditions: nothing unused would gain half a use, what is used is balanced."""
    ways = packing.combinations(16)
    histogram = np.zeros(17)
    histogram[[4, 6, 10, 16]] = [20, 35, 30, 7]
    x = packing.solve_repeats(histogram, ways)
    residual = histogram - sum(n * np.bincount(w, minlength=17) for n, w in zip(x, ways))
    residual[0] = 0
    gradient = residual[ways].sum(axis=1)
    usable = ((ways == 0) | (histogram[ways] > 0)).all(axis=1)
    assert (x >= 0).all() and gradient[usable].max() <= 0.5 and np.abs(gradient[x > 0]).max() < 1e-3


def test_word_tables_start_anew_and_long_texts_are_cut(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    monkeypatch.setattr(packing, "BLOCK_BYTES", 200)
    encode = packing.WordEncoder(WORD)
    rng = random.Random(9)
    words = [f"Wörd{i}'s" for i in range(300)] + ["中文", "a\xa0b", "é x", "\x1c", "\x00", "..."]
    texts = ["", " ", "x" * 3000, "a \x01 b", "<|endoftext|> a"] + [
        rng.choice(" \n\t").join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(60)]
    plain = Tokenizer.from_file(WORD)
    for _ in range(2):
        assert encode([t.encode() for t in texts]) == [as_bytes(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(encode.keys) <= 50 + 200


def test_pieces_of_a_text_join_to_it():
    for text in (b"", b"a b  c" * 100, b"x" * 500, b" " * 300 + b"y"):
        assert b"".join(packing.cut_at_space(text, 37)) == text
