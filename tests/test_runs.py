"""Chained runs: published together, continued from the newest record, invisible when they died half way."""

from __future__ import annotations

import dataclasses
import datetime as dt

import pytest

from capshift import job, schemas
from capshift.params import RunParams
from capshift.plans.balance import BalanceRun, Inventory
from capshift.sources.runs import RunStore

from world import AS_OF, DATASETS, REPORT_HOME, STATE_MOVED, WORKSPACES, build, event


def job_args(tmp_dir, spark, **more):
    tables = {"workspaces": (WORKSPACES, schemas.WORKSPACES), "datasets": (DATASETS, schemas.DATASETS),
              "reports": (REPORT_HOME, schemas.REPORTS), "watched": ([("P", "r1")], schemas.WATCHED),
              "policies": ([("P", "", "", "wsB", 0.5, 0.25, 0.8)], schemas.POLICIES)}
    argv = ["--out", f"{tmp_dir}/out"]
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_dir}/in/{name}")
        argv += [f"--{name}", f"{tmp_dir}/in/{name}"]
    return argv


def run_job(spark, tmp_dir, k, samples):
    """One scheduled run at minute 10 k over the events so far."""
    rows = [event(c, u, when=AS_OF + dt.timedelta(minutes=10 * at - 1)) for at, c, u in samples]
    spark.createDataFrame(rows, schemas.CAPACITY_EVENTS).write.mode("overwrite").parquet(f"{tmp_dir}/in/events{k}")
    as_of = AS_OF + dt.timedelta(minutes=10 * k)
    return job.main([*job_args(tmp_dir, spark), "--events", f"{tmp_dir}/in/events{k}", "--as-of", as_of.isoformat(),
                     "--run-id", f"run{k}"], spark)


def test_two_jobs_without_hand_work_equal_the_repeated_tick(spark, tmp_dir):
    samples = [(0, "A", 0.9), (0, "B", 0.1), (1, "A", 0.1), (1, "B", 0.1)]
    outs = [run_job(spark, tmp_dir, k, samples) for k in range(2)]
    decisions = [[r.decision for r in spark.read.parquet(o["decisions"]).collect()] for o in outs]
    assert decisions == [["MOVE"], ["RECOVER"]]
    # the same two ticks with the state handed over by hand
    state = None
    for k in range(2):
        rows = [event(c, u, when=AS_OF + dt.timedelta(minutes=10 * at - 1)) for at, c, u in samples]
        params = RunParams(as_of=AS_OF + dt.timedelta(minutes=10 * k), run_id=f"by-hand-{k}")
        run = BalanceRun(params, spark.createDataFrame([("P", "", "", "wsB", 0.5, 0.25, 0.8)], schemas.POLICIES),
                         spark.createDataFrame([("P", "r1")], schemas.WATCHED),
                         state if state is not None else spark.createDataFrame([], schemas.REPORT_REPOINTS),
                         Inventory(spark.createDataFrame(WORKSPACES, schemas.WORKSPACES), spark.createDataFrame(DATASETS, schemas.DATASETS),
                                   spark.createDataFrame(REPORT_HOME, schemas.REPORTS)),
                         spark.createDataFrame(rows, schemas.CAPACITY_EVENTS))
        assert sorted(run.next_state.drop("created_at").collect()) == sorted(
            spark.read.parquet(outs[k]["report_repoints"]).drop("created_at").collect())
        state = run.next_state
    store = RunStore(spark, f"{tmp_dir}/out")
    log = store.table("decision_log")
    assert {(r.run_number, r.run_id) for r in log.select("run_number", "run_id").distinct().collect()} == {(1, "run0"), (2, "run1")}
    assert log.where("kind = 'REPOINT_BACK'").count() == 1


def test_a_run_that_died_half_way_is_invisible_and_can_be_started_again(spark, tmp_dir, monkeypatch):
    run_job(spark, tmp_dir, 0, [(0, "A", 0.9), (0, "B", 0.1)])
    store = RunStore(spark, f"{tmp_dir}/out")
    before = store.state().collect()
    assert len(before) == 1
    monkeypatch.setattr(RunStore, "_place", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    later = [(0, "A", 0.9), (1, "A", 0.1), (1, "B", 0.1)]
    with pytest.raises(OSError):
        run_job(spark, tmp_dir, 1, later)
    assert store.latest()["run_id"] == "run0" and store.state().collect() == before  # its folders exist, nobody reads them
    assert {r.run_id for r in store.table("decisions").select("run_id").collect()} == {"run0"}
    monkeypatch.undo()
    run_job(spark, tmp_dir, 1, later)
    assert store.latest()["run_id"] == "run1" and store.state().count() == 0
    # a published run is not run again
    assert run_job(spark, tmp_dir, 0, later) == store.find("run0")["tables"] and store.commits().count() == 2


def test_a_number_that_is_taken_fails_the_run(spark, tmp_dir):
    store = RunStore(spark, tmp_dir)
    run = build(spark, events=[event("A", 0.9)], workspaces=WORKSPACES, datasets=DATASETS, reports=REPORT_HOME,
                watched=[("P", "r1")], materialize=True)
    run.params = dataclasses.replace(run.params, run_id="2024-01-22 00+a")
    store.publish(run)
    assert [r.run_id for r in store.table("decisions").collect()] == ["2024-01-22 00+a"]
    assert run._kept == [] and store.table("decisions").count() == 1  # its scratch tables are gone, its outputs are not
    with pytest.raises(RuntimeError, match="taken"):
        store._place("000000000001.json", "{}")
    assert store.commits().count() == 1


def test_several_policies_on_one_report(spark):
    """A recovery goes before a move, then the smallest policy id; the original dataset is kept."""
    policies = [(p, "", "", "wsB", 0.5, r, 0.8) for p, r in (("P", 0.25), ("Q", 0.45), ("R", 0.45))]
    kw = dict(workspaces=WORKSPACES, datasets=DATASETS, policies=policies, materialize=True)
    moved = dict(kw, reports=[("r1", "wsC", "dsC")], datasets=[*DATASETS, ("dsC", "sales", "wsC")])
    # home (A) is at 0.4: P sees no recovery but a move off C (0.9), Q and R a recovery
    run = build(spark, events=[event("A", 0.4), event("C", 0.9)], watched=[(p, "r1") for p in "PQR"],
                state=[("dsA", "wsA", "r1", "dsC", "wsC")], **moved)
    assert {r.policy_id: r.decision for r in run.decisions.collect()} == {"P": "SUPERSEDED", "Q": "RECOVER", "R": "SUPERSEDED"}
    assert [(a.action, a.target_dataset_id) for a in run.actions.collect()] == [("RECOVER", "dsA")]
    assert run.next_state.count() == 0
    # nobody recovers: the first policy moves it, and the state keeps the original dataset
    run = build(spark, events=[event("A", 0.48), event("C", 0.9)], watched=[(p, "r1") for p in "QP"],
                state=[("dsA", "wsA", "r1", "dsC", "wsC")], **moved)
    assert {r.policy_id: r.decision for r in run.decisions.collect()} == {"P": "MOVE", "Q": "SUPERSEDED"}
    assert [(s.initial_dataset_id, s.target_workspace_id) for s in run.next_state.collect()] == [("dsA", "wsB")]


def test_checks_count_in_the_same_pass_or_fail(spark):
    kw = dict(events=[event("A", 0.1), event("B", 0.1)], workspaces=WORKSPACES, datasets=DATASETS,
              reports=[("r1", "wsA", "dsA_copy"), ("r1", "wsB", "dsA_copy")], watched=[("P", "r1"), ("ghost", "r1")],
              state=STATE_MOVED + [("dsZ", "wsA", "r1", "dsA_copy", "wsB")], materialize=True)
    run = build(spark, **kw)
    assert sorted(r.decision for r in run.decisions.collect()) == ["INVALID_POLICY", "RECOVER"]  # no row is doubled
    assert run.checks == {"reports_with_several_state_rows": 2, "reports_listed_more_than_once": 2,
                          "reports_of_unknown_policies": 1, "reports_without_decision": 0}
    strict = build(spark, **kw)
    strict.strict = True
    with pytest.raises(ValueError, match="several_state_rows"):
        strict.decisions.collect()


def test_homes_are_resolved_without_null_keys(spark):
    run = build(spark, events=[event("A", 0.9)], workspaces=WORKSPACES, datasets=DATASETS, reports=REPORT_HOME,
                watched=[("P", "r1")], state=STATE_MOVED)
    plan = run.tick._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):  # joins on the home's keys stand below the join with the watched reports
        if "initial_dataset_id" in line and "Join" in line:
            assert "report_id" not in line.split("Join", 1)[1].split("(initial", 1)[0]
    joins = [line for line in plan.split("\n") if "Join" in line]
    depth = {key: min(len(line) - len(line.lstrip(" :+-")) for line in joins if f"({key}#" in line) for key in ("initial_dataset_id", "report_id")}
    assert depth["initial_dataset_id"] > depth["report_id"]
