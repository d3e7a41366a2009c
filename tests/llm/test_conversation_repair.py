"""Conversation repair against a plain backward program, and the audit tree by itself."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import types as T

from capshift.llm import conversation_repair as repair
from capshift.llm.audit_tree import AuditDP, AuditTree

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
CLASH = T.StructType(TURNS.fields + [T.StructField(n, T.StringType()) for n in (
    "copies", "content", "at", "first", "again", "blank", "open", "fault", "t1", "audit")])
INK = re.compile("[^\x20\x09-\x0d]")


def cheapest(rows):
    """(cost, audit) of rows (initial, must_go, truncated): costs to go from the end; every option has its own letter."""
    import sys
    sys.setrecursionlimit(20_000)
    turn = {"": "u", "s": "u", "a": "u", "u": "a"}  # state: the last initial given

    @lru_cache(maxsize=None)
    def go(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, ""))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            cost, rest = go(i + 1, state, 0)
            options.append((cost + 3, "D" + rest))
            if not must_go:
                if initial == turn[state] or (initial == "s" and state == ""):
                    cost, rest = go(i + 1, initial, 0)
                    options.append((cost + truncated, "K" + rest))
                cost, rest = go(i + 1, turn[state], 0)
                options.append((cost + 2 + truncated, "R" + rest))
        if inserted < 3:
            cost, rest = go(i, turn[state], inserted + 1)
            options.append((cost + 2, "I" + rest))
        return min(options, default=(10**9, ""))

    return go(0, "", 0)


def plain(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
        order = (turn is not None, turn or 0, role, int(digest[:15], 16), int(digest[15:30], 16))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        e = zlib.crc32(key.encode()) % 20
        role = "user" if e == 4 else role
        text = "" if e == 1 else re.sub("[.!?]", "", text) if e == 2 else text
        convs[conv] += [(order, turn, role, text)] * (0 if e == 0 else 2 if e == 3 else 1)
    out = []
    for conv, members in convs.items():
        members.sort(key=lambda r: r[0])
        seen, faults, inputs = set(), [], []
        for _, _, role, text in members:
            ink = INK.findall(text)
            fault = "b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            inputs.append((role[:1], fault in ("b", "d") and fault != "", fault == "t"))
        turns = [t for _, t, _, _ in members if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(inputs, inputs[1:]))
        cost, audit = cheapest(inputs) if members else (0, "")
        lines, at, last = [], 0, ""
        for letter in audit:
            role, text = members[at][2:] if letter != "I" else ("", "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def check(spark, rows, clash=False):
    frame = spark.createDataFrame([(*r, *["x"] * 10) for r in rows] if clash else rows, CLASH if clash else TURNS)
    got = [tuple(r) for r in repair.repair_report(repair.damage(frame)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def dialogue(conv, n, rng):
    texts = ["Yes.", "no", "Why?", "", " \t", "So", "Fine!  "]
    return [(conv, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "User", ""]), rng.choice(texts) + rng.choice(["", f" {t}."]))
            for t in range(n)]


@pytest.mark.parametrize("clash", [False, True])
def test_random_conversations(spark, clash):
    rng = random.Random(7)
    check(spark, [r for c in range(120) for r in dialogue(c, rng.randrange(1, 12), rng)], clash)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, 0, "user", "lost."), (None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (1, None, "a", None),
            (2, 5, "system", "S."), (2, 5, "system", "S."), (2, 9, None, "x"), (3, 10**12, "user", "word " * 200_000 + "."),
            (3, -4, "assistant", "ü."), (4, 1, "user", "\x0b\x0c\r"), (5, 1, "sys\ntem", "a:b\nc."), (5, 2, "user", "\xa0")]
    check(spark, rows)


def test_a_conversation_of_most_rows(spark):
    rng = random.Random(8)
    rows = dialogue(3, 1500, rng) + [(3, 40, "user", "again.")] * 300 + [r for c in range(10, 30) for r in dialogue(c, 3, rng)]
    rng.shuffle(rows)
    check(spark, rows)


def test_wholly_dropped_and_empty(spark):
    dropped = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(*dropped, "user", "x.")])
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair_report(repair.damage(empty)).collect() == []


def test_repaired_turns_without_damage(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Ho."), (2, 0, "assistant", "A."),
            (3, 0, "user", "  ")]
    got = [tuple(r) for r in repair.repaired_turns(repair.as_given(spark.createDataFrame(rows, TURNS))).collect()]
    assert sorted(got) == [(1, 1, "system", "S."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Ho."),
                           (2, 1, "user", ""), (2, 2, "assistant", "A.")]


@pytest.mark.parametrize("modulus", [2, 7, (1 << 61) - 1])
def test_program_settles_anywhere_and_survives_collisions(modulus):
    rng = random.Random(modulus)
    for _ in range(300):
        rows = [(rng.choice("sua u"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(0, 25))]
        dp, settled = AuditDP(modulus), ""
        for row in rows:
            dp.feed(*row)
            if rng.random() < 0.3:
                settled += dp.settle()
        cost, rest = dp.finish()
        assert (cost, settled + rest) == cheapest(tuple(rows))


def test_program_against_all_edit_sequences():
    def all_costs(rows, most):
        for n in range(most + 1):
            for letters in product("DIKR", repeat=n):
                at, state, cost = 0, "", 0
                for x in letters:
                    if x != "I" and at == len(rows):
                        break
                    nxt = "a" if state == "u" else "u"
                    if x == "I":
                        state, cost = nxt, cost + 2
                        continue
                    initial, gone, cut = rows[at]
                    at += 1
                    if x == "D":
                        cost += 3
                    elif gone or (x == "K" and not (initial == nxt or (initial == "s" and state == ""))):
                        break
                    else:
                        state, cost = (nxt, cost + 2 + cut) if x == "R" else (initial, cost + cut)
                else:
                    if at == len(rows) and state in ("", "a"):
                        yield cost, "".join(letters)

    rng = random.Random(4)
    for _ in range(25):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(0, 4))]
        dp = AuditDP()
        for row in rows:
            dp.feed(*row)
        assert dp.finish() == min(all_costs(rows, 6))


def test_sequences_compare_as_their_letters():
    rng = random.Random(11)
    for modulus in (3, (1 << 61) - 1):
        tree = AuditTree(modulus)
        words = [""]
        for _ in range(400):
            parent = rng.randrange(len(tree))
            letter = rng.choice("DI")
            assert tree.add(parent, letter) == len(words)
            words.append(words[parent] + letter)
        for _ in range(3000):
            x, y = rng.randrange(len(words)), rng.randrange(len(words))
            assert tree.less(x, y) == (words[x] < words[y])
        top = tree.meeting([50, 60, 70])
        small, places = tree.rooted(top, [50, 60, 70])
        assert [words[top] + small.path(p) for p in places] == [words[n] for n in (50, 60, 70)]
