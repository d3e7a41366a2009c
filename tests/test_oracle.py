"""Every registered query against its DuckDB oracle on the smallest fixture (sf0.001).

The oracles are written for the sf0.01 look-back (12 h), which is also the
sf0.001 look-back, so they apply unchanged.
"""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry
from capshift.catalog import QUERIES
from capshift.oracle_sql import ORACLE

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "supplier", "orders", "lineitem", "events"]
FAST = ["capacity_peak", "events_recent", "watched_reports", "policy_check", "resolve_target", "decisions",
        "decision_log", "repoint_upsert", "action_table", "connection_bindings", "refresh_plan",
        "hysteresis_replay", "rolling_peak", "copy_lookup", "target_gate"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        try:
            return round(float(v), 9)
        except (TypeError, ValueError):
            pass
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=str)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    got = _rows(QUERIES[name](spark, SF).toPandas())
    exp = _rows(con.execute(ORACLE[name]).df())
    assert got[0] == exp[0]
    assert len(got[1]) == len(exp[1])
    assert got[1] == exp[1]


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["policy_id", "report_id", "decision", "report_workspace_id", "capacity_id", "utilization",
                          "target_workspace_id", "target_capacity_id"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_every_oracle_runs_in_duckdb(con, name):
    assert con.execute(ORACLE[name]).df().shape[1] > 0
