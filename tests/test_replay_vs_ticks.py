"""W2 replay equals running the balancing tick again and again with the state carried forward."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from capshift import schemas
from capshift.operators import replay
from capshift.params import RunParams
from capshift.plans.balance import BalanceRun, Inventory
from capshift.sources.events import parse_events
from capshift.sources.fixtures import Fixture

SF = "/root/testdata/sf0.001"
LOOK, STEP = dt.timedelta(hours=12), dt.timedelta(hours=6)
T, R, H = 0.5, 0.3, 0.8
TARGET_CAP = "0"


def test_replay_equals_repeated_ticks(spark):
    start, end = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)
    envelope = Fixture(spark, SF).capacity_events.where(F.col("time").between(start, end))
    parsed = parse_events(envelope)
    rep = replay.hysteresis_replay(parsed, TARGET_CAP, T, R, H, LOOK, STEP).collect()
    caps = sorted({r["capacity_id"] for r in rep})
    ticks = sorted({r["tick"] for r in rep})
    state_at = {(r["capacity_id"], r["tick"]): r["state"] for r in rep}

    # one report per source capacity, homed on a workspace of that capacity; the target workspace
    # sits on capacity 0 and holds a copy of every report's dataset
    workspaces = [(f"w{c}", f"w{c}", c) for c in caps] + [("wT", "target", TARGET_CAP)]
    datasets = [(f"d{c}", f"m{c}", f"w{c}") for c in caps] + [(f"d{c}_copy", f"m{c}_LB", "wT") for c in caps]
    inv_ws = spark.createDataFrame(workspaces, schemas.WORKSPACES)
    inv_ds = spark.createDataFrame(datasets, schemas.DATASETS)
    policies = spark.createDataFrame([("P", "", "", "wT", T, R, H)], schemas.POLICIES)
    watched = spark.createDataFrame([("P", f"r{c}") for c in caps], schemas.WATCHED)
    events = envelope.cache()

    moved = {c: False for c in caps}
    seen = set()
    k = ticks[0]
    while k <= ticks[-1]:
        reports = [(f"r{c}", f"w{c}", f"d{c}_copy" if moved[c] else f"d{c}") for c in caps]
        state = [(f"d{c}", f"w{c}", f"r{c}", f"d{c}_copy", "wT", k - STEP) for c in caps if moved[c]]
        run = BalanceRun(RunParams(as_of=k, lookback=LOOK, run_id=f"t{k:%Y%m%d%H}"), policies, watched,
                         spark.createDataFrame(state, schemas.REPORT_REPOINTS),
                         Inventory(inv_ws, inv_ds, spark.createDataFrame(reports, schemas.REPORTS)), events,
                         materialize=False)
        for row in run.decisions.collect():
            c = row["report_id"][1:]
            seen.add(row["decision"])
            if row["decision"] == "MOVE":
                moved[c] = True
            elif row["decision"] == "RECOVER":
                moved[c] = False
        for c in caps:
            if (c, k) in state_at:
                assert state_at[(c, k)] == int(moved[c]), (c, k)
            else:
                assert not moved[c], (c, k)  # a tick without events reads 0 < R: home again
        k += STEP
    events.unpersist()
    assert {"MOVE", "RECOVER", "SAME_CAPACITY"} <= seen, seen  # both transitions were exercised
