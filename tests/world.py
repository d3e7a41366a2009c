"""Small hand-made inventories for the golden, boundary and differential tests."""

from __future__ import annotations

import datetime as dt
import json

from capshift import schemas
from capshift.params import RunParams
from capshift.plans.balance import BalanceRun, Inventory

AS_OF = dt.datetime(2024, 1, 22)
LOOKBACK = dt.timedelta(minutes=5)


def event(cap, util, when=None, base=1.0):
    """One capacity event whose utilisation is exactly ``util`` (base 1 -> ratio = ms / 30000)."""
    when = when or AS_OF - dt.timedelta(minutes=1)
    data = {"capacityId": cap, "capacityUnitMs": util * 30000 * base, "baseCapacityUnits": base,
            "utilizationInteractive": 1.0, "utilizationBackground": 1.0}
    return (when, json.dumps(data))


def build(spark, *, events, workspaces, datasets, reports, watched, state=(), policies=None,
          target_ws="wsB", move=0.5, recover=0.25, headroom=0.8, materialize=False, lookback=LOOKBACK):
    policies = policies or [("P", "", "", target_ws, move, recover, headroom)]
    ev = spark.createDataFrame(list(events) or [], schemas.CAPACITY_EVENTS)
    st = spark.createDataFrame([tuple(r) + (AS_OF - dt.timedelta(days=1),) for r in state],
                               schemas.REPORT_REPOINTS)
    inv = Inventory(spark.createDataFrame(workspaces, schemas.WORKSPACES),
                    spark.createDataFrame(datasets, schemas.DATASETS),
                    spark.createDataFrame(reports, schemas.REPORTS))
    if not hasattr(policies, "columns"):
        policies = spark.createDataFrame(policies, schemas.POLICIES)
    return BalanceRun(RunParams(as_of=AS_OF, lookback=lookback, run_id="t"), policies,
                      watched if hasattr(watched, "columns") else spark.createDataFrame(watched, schemas.WATCHED),
                      st, inv, ev, materialize=materialize)


# A source capacity A, a target capacity B, a third capacity C.
WORKSPACES = [("wsA", "home", "A"), ("wsB", "balance_ws", "B"), ("wsC", "other", "C")]
DATASETS = [("dsA", "sales", "wsA"), ("dsA_copy", "sales_LB", "wsB")]
REPORT_HOME = [("r1", "wsA", "dsA")]
REPORT_MOVED = [("r1", "wsA", "dsA_copy")]
STATE_MOVED = [("dsA", "wsA", "r1", "dsA_copy", "wsB")]


def decision_of(run, report="r1"):
    rows = {r["report_id"]: r["decision"] for r in run.decisions.collect()}
    return rows[report]
