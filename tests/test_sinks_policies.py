"""Tables and sinks (K1-K6), payload JSON (F12-F14), policy checks (P12) and targets (D-T)."""

from __future__ import annotations

import datetime as dt
import json

from capshift import schemas
from capshift.functions.ids import py_strip
from capshift.operators import lineage, policy
from capshift.plans import actions
from capshift.sources import tables
from pyspark.sql import functions as F

from world import AS_OF, DATASETS, REPORT_HOME, WORKSPACES, build, event


def test_ddl_partition_append_is_idempotent(spark, tmp_dir):
    spark.sql("CREATE DATABASE IF NOT EXISTS capshift_test")
    names = tables.ensure_tables(spark, "capshift_test", location=tmp_dir)
    assert set(names) == {"capshift_test.report_repoints", "capshift_test.decision_log", "capshift_test.alerts"}
    tables.ensure_tables(spark, "capshift_test", location=tmp_dir)  # second call is a no-op
    run = build(spark, events=[event("A", 0.9)], workspaces=WORKSPACES, datasets=DATASETS, reports=REPORT_HOME,
                watched=[("P", "r1")])
    for _ in range(2):
        tables.write_run_partition(run.log.select(*[f.name for f in schemas.DECISION_LOG.fields]),
                                   "capshift_test.decision_log", "run-1")
        tables.write_run_partition(run.next_state, "capshift_test.report_repoints", "run-1")
    assert spark.table("capshift_test.decision_log").count() == run.log.count()
    tables.write_run_partition(run.next_state.limit(0), "capshift_test.report_repoints", "run-2")
    snap = tables.latest_snapshot(spark, "capshift_test.report_repoints")
    assert snap.count() == 0  # run-2 wrote no rows: the newest state is empty
    tables.write_run_partition(run.log.select(*[f.name for f in schemas.DECISION_LOG.fields]).limit(0),
                               "capshift_test.decision_log", "run-1")
    assert spark.table("capshift_test.decision_log").count() == 0  # a rerun leaves no stale rows


def test_alert_csv_round_trip(spark, tmp_dir):
    run = build(spark, events=[event("A", 0.85), event("B", 0.7)], workspaces=WORKSPACES, datasets=DATASETS,
                reports=REPORT_HOME, watched=[("P", "r1")], move=0.84, recover=0.8)
    tables.write_alerts_csv(run.alerts, f"{tmp_dir}/alerts")
    back = tables.read_alerts_csv(spark, f"{tmp_dir}/alerts").collect()
    assert len(back) == 1 and back[0]["timestamp"] == AS_OF and "overloaded capacity B" in back[0]["alert"]


def test_payloads(spark):
    moved = spark.createDataFrame([("P", "d1", "w1", "m_LB", "w2", "c1")],
                                  "policy_id string, source_dataset_id string, source_workspace_id string, "
                                  "target_dataset_name string, target_workspace_id string, target_dataset_id string")
    ds = spark.createDataFrame([("d1", "s1"), ("d1", "s2")], schemas.DATASOURCES)
    conn = spark.createDataFrame([("s1", "Cloud", None, ("srv/db", "SQL")),
                                  ("s2", "Gateway", "g7", ("srv2/db", "SQL"))], schemas.CONNECTIONS)
    got = {r["datasource_id"]: json.loads(r["payload"])
           for r in actions.connection_bindings(moved, ds, conn).collect()}
    assert got["s1"] == {"connectionBinding": {"id": "s1", "connectivityType": "Cloud",
                                               "connectionDetails": {"path": "srv/db", "type": "SQL"}}}
    assert got["s2"]["connectionBinding"]["gatewayId"] == "g7"
    sched = spark.createDataFrame([("d1", ["Monday"], ["07:00"], "UTC", False)], schemas.REFRESH_SCHEDULES)
    plan = actions.refresh_plan(moved, sched).collect()[0]
    assert json.loads(plan["payload"]) == {"value": {"enabled": True, "days": ["Monday"], "times": ["07:00"],
                                                     "localTimeZoneId": "UTC"}}
    reb = actions.with_rebind_payload(spark.createDataFrame([("x",)], "target_dataset_id string")).first()
    assert json.loads(reb["payload"]) == {"datasetId": "x"}


def test_id_lists_are_split_stripped_and_deduplicated(spark):
    lists = spark.createDataFrame([("P", " a,b\t, a\n,,c"), ("P", "b")], schemas.WATCH_LISTS)
    got = sorted(r["report_id"] for r in lineage.watched_reports(lists).collect())
    assert got == ["a", "b", "c"]
    strip = spark.createDataFrame([(" \t\x0bx y　\n",)], "s string").select(py_strip(F.col("s"))).first()[0]
    assert strip == " \t\x0bx y　\n".strip()


def test_policy_rules(spark):
    rows = [("ok", "LB", "", "", 0.8, 0.7, 0.8),
            ("cap_and_target", "", "cap", "w", 0.8, 0.7, 0.8),
            ("name_and_target", "LB", "", "w", 0.8, 0.7, 0.8),
            ("cap_no_name", "", "cap", "", 0.8, 0.7, 0.8),
            ("nothing", "", "", "", 0.8, 0.7, 0.8),
            ("r_not_below_t", "LB", "", "", 0.7, 0.7, 0.8)]
    got = {r["policy_id"]: r["errors"] for r in policy.policy_check(spark.createDataFrame(rows, schemas.POLICIES))
           .collect()}
    assert got == {"ok": "", "cap_and_target": "CAPACITY_AND_TARGET,CAPACITY_WITHOUT_NAME",
                   "name_and_target": "NAME_AND_TARGET",
                   "cap_no_name": "CAPACITY_WITHOUT_NAME,NO_NAME_NO_TARGET",
                   "nothing": "NO_NAME_NO_TARGET", "r_not_below_t": "RECOVERY_NOT_BELOW_MOVE"}


def test_resolve_target(spark):
    ws = spark.createDataFrame(WORKSPACES + [("wsB2", "balance_ws", "C")], schemas.WORKSPACES)
    rows = [("explicit", "", "", "wsC", 0.8, 0.7, 0.8),
            ("by_name", "balance_ws", "", "", 0.8, 0.7, 0.8),
            ("create", "new_ws", "Z", "", 0.8, 0.7, 0.8),
            ("missing", "new_ws", "", "", 0.8, 0.7, 0.8),
            ("unknown_ws", "", "", "wsQ", 0.8, 0.7, 0.8)]
    got = {r["policy_id"]: (r["target_workspace_id"], r["target_capacity_id"], r["resolution"])
           for r in policy.resolve_target(spark.createDataFrame(rows, schemas.POLICIES), ws).collect()}
    assert got == {"explicit": ("wsC", "C", "EXPLICIT"), "by_name": ("wsB", "B", "BY_NAME"),
                   "create": (None, "Z", "CREATE"), "missing": (None, None, "UNRESOLVED"),
                   "unknown_ws": ("wsQ", None, "UNRESOLVED")}


def test_materialized_run_equals_lazy_run(spark):
    kw = dict(events=[event("A", 0.9, when=AS_OF - dt.timedelta(minutes=2))], workspaces=WORKSPACES,
              datasets=DATASETS, reports=REPORT_HOME, watched=[("P", "r1")])
    lazy = build(spark, **kw).decisions.collect()
    kept = build(spark, materialize=True, **kw).decisions.collect()
    assert lazy == kept


def test_bucketed_state_joins_without_shuffling_the_state(spark, tmp_dir):
    spark.sql("CREATE DATABASE IF NOT EXISTS capshift_bkt")
    tables.ensure_tables(spark, "capshift_bkt", location=tmp_dir, state_buckets=4)
    run = build(spark, events=[event("A", 0.9)], workspaces=WORKSPACES, datasets=DATASETS, reports=REPORT_HOME,
                watched=[("P", "r1")])
    tables.write_run_partition(run.next_state, "capshift_bkt.report_repoints", "run-1")
    state = spark.table("capshift_bkt.report_repoints").where("run_id = 'run-1'")
    other = spark.createDataFrame([("r1", 1)], "report_id string, n int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = state.join(other, "report_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # only the small side is shuffled
    assert state.count() == 1
