"""Exact duplicates against a plain grouping, with digests of one byte too, and the filters themselves."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from capshift.llm import common, exact_dedup, fuse_filter

SPACE = re.compile("[\x20\x09-\x0d]")


def plain(rows):
    """(doc_id, keep_id, group_size, sha) of every row, and the number of groups."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(i, best, len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return Counter(out), len(groups)


def check(got, rows):
    got = got.collect()
    want, groups = plain(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(make_docs, odd_rows, clash):
    rows = odd_rows + [(20, "a  b"), (21, "ab"), (22, "a b"), (23, "a\tb "), (24, "\xa0ab")]
    check(exact_dedup.find_duplicates(make_docs(rows, clash)), rows)


@pytest.mark.parametrize("digest_bytes", [1, 32])
def test_hot_group_and_colliding_digests(make_docs, digest_bytes):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot text ", "hot  text", "hottext"]) if i % 3 == 0 else f"t{rng.randrange(900)} " * 3) for i in range(3000)]
    check(exact_dedup.find_duplicates(make_docs(rows), digest_bytes=digest_bytes), rows)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_the_number_of_arrivals_does_not_matter(make_docs, batches, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_BUCKET", 64)
    rows = [(i, f"text {i * i % 701}" + " " * (i % 4)) for i in range(1500)]
    check(exact_dedup.find_duplicates(make_docs(rows), batches=batches), rows)


def test_empty_table(make_docs):
    assert exact_dedup.find_duplicates(make_docs([])).collect() == []


def test_filters_know_their_members_and_few_others():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 1000, 200_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        built = fuse_filter.build(np.concatenate([keys, keys[:5]]))
        assert fuse_filter.contains(keys, *built).all()
        others = rng.integers(0, 2**64, 100_000, dtype=np.uint64)
        assert fuse_filter.contains(others, *built).mean() < 0.006
        if n >= 1000:
            assert len(built[3]) < 1.5 * n


def test_screen_returns_exactly_the_known_digests(spark):
    index = exact_dedup.SnapshotIndex(3)
    frame = lambda ids: spark.createDataFrame([(hashlib.sha256(str(i).encode()).digest(),) for i in ids], "digest binary")
    assert index.screen(frame([1])).collect() == []
    index.add(frame(range(1000)))
    index.add(frame(range(1000, 1500)))
    got = {bytes(r.digest) for r in index.screen(frame(range(500, 4000))).collect()}
    assert got == {hashlib.sha256(str(i).encode()).digest() for i in range(500, 1500)}


def test_join_groups_beyond_the_broadcast_bound(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(600)], "k int, i int")
    groups = rows.where("k != 2").groupBy("k").count()
    for how in ("left", "inner"):
        a = common.join_groups(rows, groups, "k", "count", 600, how).select("k", "i", "count")
        b = common.join_groups(rows, groups, "k", "count", 600, how, small=2).select("k", "i", "count")
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
