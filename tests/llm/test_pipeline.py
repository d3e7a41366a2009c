"""The pipeline stage by stage against plain versions: each stage's decisions on its own input."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from capshift.llm import pii, quality, toxicity
from tests.llm.conftest import DOCS, SF, table
from tests.llm.test_dedup import plain_components
from tests.llm.test_tokens import check_packing


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def plain_toxicity(model, text):
    """The mean over distinct words (and CALM silent ones) of the mean margin of each word's subwords."""
    words = set((text or "").lower().split())
    total = sum(float(np.mean(model.margin[toxicity.subwords([w])[0]].astype(np.float64))) for w in words)
    return sigmoid(toxicity.SCALE * total / (len(words) + toxicity.CALM) + model.bias)


def plain_quality(model, text):
    """Bias, linear terms and every pair's inner product, summed pair by pair."""
    text = text or ""
    words = [zlib.crc32(w.lower().encode()) for w in text.split()]
    x = {b: 0.5 * math.sqrt(n / len(words)) for b, n in Counter(w % quality.BUCKETS for w in words).items()}
    x.update({quality.BUCKETS + i: float(v) for i, v in enumerate(quality.statistics(text.encode(), np.array(words, np.int64), len(words)))})
    index, value = np.array(list(x)), np.array(list(x.values()))
    held = model.factors[index].astype(np.float64) * value[:, None]
    pairs = held @ held.T
    return sigmoid(model.bias + float(value @ model.linear[index]) + float(np.triu(pairs, 1).sum()))


def plain_flagged(texts):
    """(value, term) pairs that disclose, by counting over the different texts."""
    distinct = set(texts)
    with_value, with_term, with_both = Counter(), Counter(), Counter()
    for text in distinct:
        base = pii.find_spans(text)
        values = set(pii.entities(text, base))
        terms = {t for t, _, _ in pii.terms_outside(text, [(a, b) for _, a, b in base])}
        with_value.update(values)
        with_term.update({w.lower() for w in pii.TERM.findall(text)})
        with_both.update((e, t) for e in values for t in terms)
    n, out = len(distinct), set()
    for (e, t), both in with_both.items():
        if both >= 3 and 3 <= with_value[e] < n:
            pmi = math.log((both / n) / (with_term[t] / n * (with_value[e] / n)))
            if pmi / -math.log(with_value[e] / n) >= 0.8:
                out.add((e, t))
    return out


def plain_sanitised(texts):
    flagged = defaultdict(set)
    for e, t in plain_flagged(texts):
        flagged[e].add(t)
    out = []
    for text in texts:
        base = pii.find_spans(text)
        wanted = set().union(*(flagged[e] for e in pii.entities(text, base)))
        spans = [{"kind": k, "start": a, "end": b} for k, a, b in base]
        spans += [{"kind": 4, "start": a, "end": b} for t, a, b in pii.terms_outside(text, [(a, b) for _, a, b in base]) if t in wanted]
        out.append(pii.replace_spans(text, spans))
    return out


def scores_of(spark, sf_dir, docs, module, plain, name):
    """Rows a stage keeps, by scores written out plainly; no score may lie so near the threshold that rounding decides."""
    model = module.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.collect()
    p = [plain(model, r.text) for r in rows]
    assert min(abs(x - module.THRESHOLD) for x in p) > 1e-9, name
    return rows, p


def test_every_stage_by_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, "documents")
    for name, module, plain, keep in (("toxicity", toxicity, plain_toxicity, lambda p: p < toxicity.THRESHOLD),
                                      ("quality", quality, plain_quality, lambda p: p >= quality.THRESHOLD)):
        rows, p = scores_of(spark, SF, docs, module, plain, name)
        docs = corpus_pipeline.materialise(stages[name](spark, docs, SF), f"test-{name}")
        want = [r for r, x in zip(rows, p) if keep(x)]
        assert docs.columns == DOCS.fieldNames() and sorted(docs.collect()) == sorted(want)
        assert 0 < len(want) < len(rows)
    rows = docs.collect()
    docs = corpus_pipeline.materialise(stages["minhash_near_dedup"](spark, docs, SF), "test-near")
    groups = plain_components([(r.doc_id, r.text) for r in rows], 5)
    assert sorted(docs.collect()) == sorted(r for r, (_, c) in zip(rows, groups) if r.doc_id == c)
    rows = docs.collect()
    docs = corpus_pipeline.materialise(stages["pii"](spark, docs, SF), "test-pii")
    want = {r.doc_id: t for r, t in zip(rows, plain_sanitised([r.text for r in rows]))}
    assert {r.doc_id: r.text for r in docs.collect()} == want
    pieces = stages["packing"](spark, docs, SF).collect()
    check_packing(pieces, want)
    got = corpus_pipeline.run(spark, SF).collect()
    key = lambda p: (p["doc_id"], p["start"], p["length"], p["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, pieces))


def test_disclosing_terms_by_brute_force(spark, make_docs):
    rng = np.random.default_rng(3)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    values = [f"u{i}@mail{i}.org" for i in range(6)] + ["10.1.2.3", "+1 555 010 9999"]
    texts = []
    for i in range(150):
        held = [values[k] for k in rng.choice(len(values), rng.integers(0, 3), replace=False)]
        body = list(rng.choice(words, 12)) + held + [f"Name{chr(97 + values.index(v))}xx" for v in held if rng.random() < 0.9]
        rng.shuffle(body)
        texts.append(" ".join(body))
    texts += texts[:20]  # whole copies count once
    assert len(plain_flagged(texts)) >= 6
    docs = make_docs(list(enumerate(texts)), clash=True)
    got = [r.text for r in pii.sanitise(docs).orderBy("doc_id").collect()]
    assert got == plain_sanitised(texts)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_pipeline_of_nothing(spark, tmp_path, make_docs, rows):
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i for i, _ in rows}


def test_stages_survive_odd_rows_and_columns_in_another_order(spark, tmp_path, make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    labels = spark.createDataFrame([(8, 0, 1), (5, 1, 0), (7, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), "test-odd")
        assert docs.columns == before.columns and docs.count() <= before.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
