"""Operators 1 and 6: held-out accuracy and defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from capshift.llm import quality, queries, toxicity
from tests.llm.conftest import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query, label, least", [("op1_toxicity", "toxic", 0.84), ("op6_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    got = queries.QUERIES[query](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held[label]).mean() >= least


def test_misspellings_share_subwords():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    clean = [" ".join(rng.choice(plain, 40)) for _ in range(300)]
    bad = [" ".join([*rng.choice(plain, 38), "worthless", "stupid"]) for _ in range(100)]
    score = toxicity.Scorer(toxicity.train(clean + bad, np.array([0.0] * 300 + [1.0] * 100)))
    fresh = [" ".join(rng.choice(plain, 36)) for _ in range(40)]
    unseen = score([f + " worthles worthlesss stupidd sstupid" for f in fresh])
    assert np.median(unseen) > 0.5 > np.quantile(score(fresh), 0.9)


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    index, value = np.array([3, 7, 20, 49]), np.array([0.5, 1.0, -2.0, 0.25])
    pairs = sum(value[i] * value[j] * model.factors[index[i]] @ model.factors[index[j]]
                for i in range(4) for j in range(i + 1, 4))
    assert model.margin(index, value) == pytest.approx(0.3 + value @ model.linear[index] + pairs, rel=1e-5)


@pytest.mark.parametrize("part", [toxicity, quality])
def test_defined_cases(spark, make_docs, odd_rows, part):
    docs = make_docs(odd_rows, clash=True)
    model = part.fit(make_docs([]), table(spark, "labels"))  # nothing to learn from
    got = part.score(docs, model).toPandas()
    assert len(got) == len(odd_rows) and got.score.notna().all() and got.score.between(0, 1).all()
    assert (got[got.doc_id.isna()].held_out == False).all()  # noqa: E712
    assert part.score(make_docs([]), model).count() == 0
    drop = part.drop_toxic if part is toxicity else part.drop_low_quality
    kept = drop(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows)  # an untrained model rejects nothing


def test_labels_are_never_inputs(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = toxicity.fit(docs, labels)
    one = toxicity.score(docs, model).toPandas().sort_values("doc_id").score.to_numpy()
    other = docs.selectExpr("doc_id + 0 as doc_id", "text", "'zz' as lang", "'q' as source", "n_chars")
    assert np.array_equal(one, toxicity.score(other, model).toPandas().sort_values("doc_id").score.to_numpy())


def test_long_words_are_summed_in_stretches(monkeypatch):
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.1)
    words = ["a", "", "word", "ünï", "x" * 97, "".join(rng.choice(list("abcé中"), 501)), "y" * 16]
    whole = model.word_margins(words)
    for chunk in (1, 7, 100, 500):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.allclose(model.word_margins(words), whole, atol=1e-5)


def test_a_text_of_one_word_of_50_megabytes(make_docs):
    import resource

    text = "héllo" * 10_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    scorer = toxicity.Scorer(toxicity.Model(np.ones(toxicity.BUCKETS), 0.0))
    assert 0 <= scorer([text])[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kilobytes
