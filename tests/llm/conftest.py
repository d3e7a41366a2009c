from __future__ import annotations

import os

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

# Documents with clashing extra columns: the operators use names like these inside.
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
CLASH = T.StructType(DOCS.fields + [T.StructField(n, T.StringType()) for n in (
    "score", "row", "node", "component", "spans", "digest", "key", "c0", "block", "terms", "base", "contexts")])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clash=False):
        full = [(i, t, "en", "s", None) for i, t in rows]
        if clash:
            full = [(*r, *["x"] * (len(CLASH) - len(DOCS))) for r in full]
        return spark.createDataFrame(full, CLASH if clash else DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null and repeated ids, repeated rows, ties and one very long text."""
    long = " ".join(f"word{i % 977} part{i % 31}" for i in range(60_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "one two three four five six seven"),
            (6, "one two three four five six seven"), (6, "one two three four five six seven"), (None, "lost id here now"),
            (7, long), (8, "idiot idiot idiot"), (9, "ÄÖÜ 中文 \U0001F600 é́ \x1c x"), (10, "x" * 50_000)]


def table(spark, name):
    return spark.read.parquet(os.path.join(SF, f"{name}.parquet"))
