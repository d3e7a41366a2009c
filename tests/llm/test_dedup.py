"""Operator 9 against brute force over all pairs, hot groups and defined cases."""

from __future__ import annotations

import random

import pytest

from capshift.llm import minhash_dedup, queries
from capshift.llm.components import connected_components
from tests.llm.conftest import SF

SPACE = " \t\n\x0b\x0c\r"


def plain_sets(texts, width):
    out = []
    for t in texts:
        for c in SPACE:
            t = (t or "").replace(c, " ")
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in t.split(" ") if w]
        out.append({tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def plain_components(rows, width, percent=80):
    """(size, component) per row, comparing all pairs."""
    sets = plain_sets([t for _, t in rows], width)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(len(sets[i]), doc if not sets[i] else least.get(root(i))) for i, (doc, _) in enumerate(rows)]


def compare(spark, make_docs, rows, width):
    got = minhash_dedup.near_duplicates(make_docs(rows, clash=True), width=width).collect()
    want = [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, plain_components(rows, width))]
    assert sorted(map(repr, [tuple(r) for r in got])) == sorted(map(repr, want))


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.op9_minhash_dedup(spark, SF).collect()}
    for (doc, _), (n, c) in zip(rows, plain_components(rows, 4)):
        assert (got[doc]["n_shingles"], got[doc]["component_id"], got[doc]["kept"]) == (n, c, doc == c)


def test_near_misses_and_chains(spark, make_docs):
    """A family around the threshold: linked, nearly linked and chained texts, and a shared passage."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 4, 6, 8])):
            words[at] = f"x{rng.random()}"
        rows.append((1000 - i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(rng.randint(5, 40)))) for i in range(120)]
    rows += [(3000 + i, rows[i][1].upper()) for i in range(30)]
    compare(spark, make_docs, rows, 4)


def test_defined_cases(spark, make_docs, odd_rows):
    compare(spark, make_docs, odd_rows, 5)
    assert minhash_dedup.near_duplicates(make_docs([])).count() == 0


def test_one_of_each_group_stays(make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    kept = minhash_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(map(repr, (r["doc_id"] for r in kept.collect())))
    assert ids == sorted(map(repr, [1, 2, 3, 4, 5, None, 7, 8, 9, 10]))
    assert minhash_dedup.keep_one_of_each(make_docs([])).count() == 0


@pytest.mark.parametrize("edges, want", [
    ([], {}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(9, 3), (3, 9), (4, 4), (7, 5), (5, 6)], {9: 3, 3: 3, 4: 4, 7: 5, 5: 5, 6: 5}),
])
def test_components(spark, edges, want):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want


def test_a_family_of_near_misses_is_not_copied_per_member(spark):
    """Rows sent to comparisons grow as the members times the few blocks of a cluster, not as their square."""
    for n in (1000, 20_000):
        members = spark.range(n).selectExpr("id as node", "id as component", "200L as size", "0L as cluster")
        rows = minhash_dedup._paired_blocks(members).count()
        blocks = -(-n * 200 // minhash_dedup.BLOCK_SHINGLES)
        assert rows <= 2 * n * blocks and blocks <= 3


def test_near_misses_in_small_slices(spark, make_docs):
    rng = random.Random(21)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 6, 9])):
            words[at] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words[:rng.choice([60, 60, 45])])))
    compare(spark, make_docs, rows, 1)
