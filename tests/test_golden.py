"""Worked scenarios (G1-G4) and boundary cases (B1-B7) of the balancing tick."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from world import (AS_OF, DATASETS, LOOKBACK, REPORT_HOME, REPORT_MOVED, STATE_MOVED, WORKSPACES, build,
                   decision_of, event)

WATCH = [("P", "r1")]
T84, R80 = 0.84, 0.80


def run_for(spark, src, tgt, moved=False, move=T84, recover=R80, **kw):
    events = [event("A", src)] if src is not None else []
    if tgt is not None:
        events.append(event("B", tgt))
    return build(spark, events=events, workspaces=WORKSPACES, datasets=DATASETS,
                 reports=REPORT_MOVED if moved else REPORT_HOME, watched=WATCH,
                 state=STATE_MOVED if moved else (), move=move, recover=recover, **kw)


def test_g1_move(spark):
    run = run_for(spark, 0.85, 0.30)
    assert decision_of(run) == "MOVE"
    act = run.actions.collect()
    assert [(a["action"], a["target_workspace_id"], a["target_dataset_name"], a["target_dataset_id"]) for a in act] \
        == [("MOVE", "wsB", "sales_LB", "dsA_copy")]
    st = run.next_state.collect()
    assert [(s["report_id"], s["initial_dataset_id"], s["target_workspace_id"]) for s in st] == [("r1", "dsA", "wsB")]


def test_g2_recover(spark):
    run = run_for(spark, 0.79, 0.30, moved=True)
    assert decision_of(run) == "RECOVER"
    act = run.actions.collect()[0]
    assert (act["action"], act["target_dataset_id"], act["target_workspace_id"]) == ("RECOVER", "dsA", "wsA")
    assert run.next_state.count() == 0


def test_g3_target_overloaded_alerts_once(spark):
    run = run_for(spark, 0.85, 0.70)
    assert decision_of(run) == "TARGET_OVERLOADED"
    alerts = run.alerts.collect()
    assert len(alerts) == 1 and abs(alerts[0]["operation"] - 0.70) < 1e-12
    assert run.actions.count() == 0


def test_g4_band_does_not_flap(spark):
    assert decision_of(run_for(spark, 0.82, 0.30)) == "LOW_UTILIZATION"
    run = run_for(spark, 0.82, 0.30, moved=True)
    assert decision_of(run) == "SAME_CAPACITY"
    assert [r["report_id"] for r in run.next_state.collect()] == ["r1"]


def test_b1_equal_to_move_threshold_does_not_move(spark):
    assert decision_of(run_for(spark, 0.5, 0.0, move=0.5, recover=0.25)) == "LOW_UTILIZATION"


def test_b2_equal_to_recovery_threshold_does_not_recover(spark):
    assert decision_of(run_for(spark, 0.25, 0.0, moved=True, move=0.5, recover=0.25)) == "SAME_CAPACITY"


def test_b3_target_exactly_at_headroom_still_moves(spark):
    assert decision_of(run_for(spark, 0.75, 0.4, move=0.5, recover=0.25)) == "MOVE"


def test_b4_silent_home_capacity_reads_zero(spark):
    assert decision_of(run_for(spark, None, 0.1, moved=True, move=0.5, recover=0.25)) == "RECOVER"


def test_b5_lower_bound_of_lookback_is_inclusive(spark):
    edge = AS_OF - LOOKBACK
    run = build(spark, events=[event("A", 0.75, when=edge), event("A", 0.9, when=edge - dt.timedelta(microseconds=1)),
                               event("A", 0.95, when=AS_OF + dt.timedelta(seconds=1))],
                workspaces=WORKSPACES, datasets=DATASETS, reports=REPORT_HOME, watched=WATCH)
    peak = {r["capacity_id"]: r["peak_utilization"] for r in run.peaks.collect()}
    assert peak["A"] == 0.75


def test_b6_bad_rows_are_ignored_by_the_peak(spark, tmp_dir):
    from capshift.sources.events import parse_events, read_capacity_events
    from capshift.operators.peaks import capacity_peak
    from capshift.params import RunParams
    lines = [
        '{"time": "2024-01-21T23:58:00", "data": "{\\"capacityId\\": \\"A\\", \\"capacityUnitMs\\": 6000, '
        '\\"baseCapacityUnits\\": 1}"}',
        '{"time": "2024-01-21T23:58:30", "data": "not json"}',
        '{"time": "yesterday", "data": "{\\"capacityId\\": \\"A\\", \\"capacityUnitMs\\": 29000, '
        '\\"baseCapacityUnits\\": 1}"}',
        '{"time": "2024-01-21T23:59:00", "data": "{\\"capacityId\\": \\"A\\", \\"capacityUnitMs\\": 29000, '
        '\\"baseCapacityUnits\\": 0}"}',
    ]
    with open(f"{tmp_dir}/events.json", "w") as f:
        f.write("\n".join(lines))
    ev = parse_events(read_capacity_events(spark, f"{tmp_dir}/events.json", fmt="json"))
    rows = capacity_peak(ev, RunParams(as_of=AS_OF, lookback=LOOKBACK)).collect()
    assert [(r["capacity_id"], r["peak_utilization"], r["n_events"], r["n_unmeasured"]) for r in rows] \
        == [("A", 0.2, 2, 1)]


def test_b7_moving_again_keeps_the_initial_dataset(spark):
    # r1 was moved to wsB earlier; the policy now targets wsC and capacity B is hot.
    run = build(spark, events=[event("B", 0.9), event("C", 0.1), event("A", 0.6)],
                workspaces=WORKSPACES, datasets=DATASETS + [("dsC", "sales_LB_LB", "wsC")], reports=REPORT_MOVED,
                watched=WATCH, state=STATE_MOVED, target_ws="wsC")
    assert decision_of(run) == "MOVE"
    st = run.next_state.collect()
    assert [(s["initial_dataset_id"], s["target_workspace_id"], s["target_dataset_id"]) for s in st] \
        == [("dsA", "wsC", "dsC")]
    assert st[0]["created_at"] == AS_OF


def test_unknown_report_is_unresolved_not_dropped(spark):
    run = build(spark, events=[event("A", 0.9)], workspaces=WORKSPACES, datasets=DATASETS, reports=REPORT_HOME,
                watched=[("P", "r1"), ("P", "nope")])
    got = {r["report_id"]: r["decision"] for r in run.decisions.collect()}
    assert got == {"r1": "MOVE", "nope": "UNRESOLVED"}


def test_invalid_policy_decides_nothing(spark):
    pol = [("P", "balance_ws", "", "wsB", 0.5, 0.25, 0.8)]  # name and target both set
    run = build(spark, events=[event("A", 0.9)], workspaces=WORKSPACES, datasets=DATASETS, reports=REPORT_MOVED,
                watched=WATCH, state=STATE_MOVED, policies=pol)
    assert decision_of(run) == "INVALID_POLICY"
    assert run.actions.count() == 0
    assert [r["report_id"] for r in run.next_state.collect()] == ["r1"]


def test_decision_log_kinds(spark):
    run = run_for(spark, 0.85, 0.30)
    kinds = sorted(r["kind"] for r in run.log.where(F.col("report_id") == "r1").collect())
    assert kinds == ["CHECKING", "NOT_IN_CACHE", "REPOINTED"]
