"""Decision counts of both fixture policies."""

from __future__ import annotations

import pytest

from capshift.catalog import fixture_run

# The outcome counts that the oracle SQL gives with every order watched.
EXPECTED = {
    ("sf0.001", "P1"): {"LOW_UTILIZATION": 1363, "RECOVER": 105, "SAME_CAPACITY": 32, "UNRESOLVED": 3},
    ("sf0.001", "P2"): {"LOW_UTILIZATION": 1331, "RECOVER": 105, "SAME_CAPACITY": 64, "UNRESOLVED": 3},
    ("sf0.01", "P1"): {"LOW_UTILIZATION": 6595, "MOVE": 6816, "RECOVER": 347, "SAME_CAPACITY": 1242,
                       "UNRESOLVED": 22},
    ("sf0.01", "P2"): {"RECOVER": 347, "TARGET_OVERLOADED": 14675},
}


@pytest.mark.parametrize("sf,policy", sorted(EXPECTED))
def test_decision_counts(spark, sf, policy):
    run = fixture_run(spark, f"/root/testdata/{sf}", policy)
    got = {r["decision"]: r["count"] for r in run.decisions.groupBy("decision").count().collect()}
    assert got == EXPECTED[(sf, policy)]
