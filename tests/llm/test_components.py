"""Connected components of any shape, in few rounds; long chains through operators 9 and 10."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from capshift.llm import components, embedding_dedup, minhash_dedup
from tests.llm.test_dedup import plain_components


def plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return sorted((x, root(x)) for x in parent)


def solve(spark, edges, per_task, monkeypatch):
    """The labels, and how many hooking rounds they took."""
    rounds, hook = [], components._hook
    monkeypatch.setattr(components, "_hook", lambda *a: rounds.append(1) or hook(*a))
    rng = random.Random(1)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    rng.shuffle(edges)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), per_task).collect()
    assert sorted(map(tuple, got)) == plain(edges)
    return len(rounds)


def test_one_task_and_many_agree(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(5000, 5000), (7, 7)]
    assert solve(spark, edges, 10_000, monkeypatch) == 0
    assert solve(spark, edges, 60, monkeypatch) > 0


def test_random_path_of_20_000(spark, monkeypatch):
    order = list(range(20_000))
    random.Random(3).shuffle(order)
    assert solve(spark, list(zip(order, order[1:])), 2_500, monkeypatch) <= 20


@pytest.mark.parametrize("shape", ["valley", "hub", "line"])
def test_rounds_are_logarithmic(spark, monkeypatch, shape):
    n = 1000
    edges = {"valley": [(i, i + 1) for i in range(0, n, 2)] + [(i, i + 1) for i in range(n, 2 * n)] + [(0, n)],
             "hub": [(n, i) for i in range(n)], "line": [(i, i + 1) for i in range(n)]}[shape]
    assert solve(spark, edges, 64, monkeypatch) <= 2 * math.log2(n)


def test_nulls_and_nothing(spark):
    frame = spark.createDataFrame([(None, 1), (2, None)], "a long, b long")
    assert components.connected_components(frame).collect() == []


def test_chain_of_documents(spark, make_docs):
    """Every document shares 82 % with the next; brute force says one component."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40_000)]
    ids = list(range(400))
    rng.shuffle(ids)
    rows = [(doc, " ".join(words[10 * k:10 * k + 110])) for k, doc in enumerate(ids)]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(make_docs(rows), width=1).collect()}
    assert [got[doc] for doc, _ in rows] == [c for _, c in plain_components(rows, 1)]
    assert set(got.values()) == {0}


def test_chain_of_vectors(spark):
    rng = np.random.default_rng(5)
    x, y = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
    angles = np.arange(300) * 0.4 * math.pi / 180
    rows = [(int(i), (math.cos(t) * x + math.sin(t) * y).tolist()) for i, t in zip(rng.permutation(300), angles)]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=0.9999).collect()
    assert {r.component_id for r in got} == {0}
