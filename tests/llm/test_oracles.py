"""The SQL of the training-data queries runs and gives the same rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from capshift.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SF

TABLES = ["documents", "pages", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(pdf):
        return sorted((tuple(None if pd.isna(v) else v for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=str)

    assert rows(got) == rows(want)
