"""The conversation trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from capshift.llm import conversations, prefix_trie

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
CLASH = T.StructType(TURNS.fields + [T.StructField(n, T.StringType()) for n in ("i", "node", "seq", "part", "uid", "size", "bytes")])


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, int(digest[:15], 16), int(digest[15:30], 16), text))
    own = {c: [(r[2], r[5]) for r in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in whole.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, who in members.items())


def check(spark, rows, clash=False):
    frame = spark.createDataFrame([(*r, *["x"] * 7) for r in rows] if clash else rows, CLASH if clash else TURNS)
    got = sorted(tuple(r) for r in prefix_trie.conversation_trie(frame).collect())
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def dialogue(conv, n, texts, rng):
    return [(conv, t, "user" if t % 2 == 0 else "assistant", rng.choice(texts)) for t in range(n)]


def test_random_trees(spark):
    rng = random.Random(1)
    rows = [r for c in range(90) for r in dialogue(c, rng.randrange(0, 14), ["a", "bé"], rng)]
    check(spark, rows)


@pytest.mark.parametrize("clash", [False, True])
def test_nulls_ties_repeats_and_negative_ids(spark, clash):
    rows = [(1, None, None, None), (1, None, "user", "x"), (1, 3, "user", ""), (2, 1, "u", "y"), (2, 1, "u", "y"), (2, 1, "u", "y"),
            (None, 1, "user", "lost"), (-7, 0, "user", "n"), (-5, 0, "user", "m"), (-5, 1, "user", "k"), (7, None, None, ""),
            (10**15, 5, "user", "far"), (0, 0, "user", "long " * 60_000), (4, 9, "a:b", "c"), (3, 9, "a", "b:c")]
    check(spark, rows, clash)


def test_identical_conversations_and_prefixes_of_others(spark):
    rng = random.Random(2)
    long = [(t, "user", f"t{t}") for t in range(40)]
    rows = [(c, *turn) for c in range(0, 3000, 5) for turn in long[:rng.choice([9, 9, 9, 20, 40])]]
    check(spark, rows)


def test_one_conversation_of_most_rows_crosses_parts_and_blocks(spark, monkeypatch):
    small = conversations.running_sums
    monkeypatch.setattr(prefix_trie, "running_sums", lambda *a: small(*a, block=7))
    rng = random.Random(3)
    rows = dialogue(5, 400, ["p", "q"], rng) + [(5, 77, "user", "same")] * 150
    rows += [(c, t, r, x) for c in (6, 15) for _, t, r, x in dialogue(c, 30, ["p", "q"], random.Random(3))]
    rng.shuffle(rows)
    check(spark, rows)


def test_empty_tables(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).collect() == []


def test_only_the_root(spark):
    # 1's crc32 modulo 9 exceeds its one turn and there is no conversation 0
    ids = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 9 > 1 and c % 5]
    check(spark, [(c, 0, "user", "x") for c in ids[:9]])
