"""Optional behaviours: min_events, alert_requires_source_over, newest-event anchor, metric choice."""

from __future__ import annotations

import dataclasses
import datetime as dt

from capshift import schemas
from capshift.operators.peaks import capacity_peak
from capshift.params import RunParams
from capshift.sources.events import anchor_on_newest_event, parse_events
from pyspark.sql import functions as F
from pyspark.sql import types as T

from world import (AS_OF, DATASETS, LOOKBACK, REPORT_HOME, REPORT_MOVED, STATE_MOVED, WORKSPACES, build,
                   decision_of, event)

OPT_SCHEMA = T.StructType(schemas.POLICIES.fields + [T.StructField("min_events", T.IntegerType()),
                                                     T.StructField("alert_requires_source_over", T.BooleanType())])


def policy(spark, min_events=None, source_over=None, move=0.5, recover=0.25):
    return spark.createDataFrame([("P", "", "", "wsB", move, recover, 0.8, min_events, source_over)], OPT_SCHEMA)


def test_min_events_turns_silence_into_no_recovery(spark):
    kw = dict(events=[event("B", 0.1)], workspaces=WORKSPACES, datasets=DATASETS, reports=REPORT_MOVED,
              watched=[("P", "r1")], state=STATE_MOVED)
    assert decision_of(build(spark, policies=policy(spark), **kw)) == "RECOVER"
    assert decision_of(build(spark, policies=policy(spark, min_events=1), **kw)) == "SAME_CAPACITY"
    kw["events"] = kw["events"] + [event("A", 0.1)]
    assert decision_of(build(spark, policies=policy(spark, min_events=1), **kw)) == "RECOVER"


def test_alert_can_require_an_overloaded_source(spark):
    kw = dict(events=[event("A", 0.3), event("B", 0.45)], workspaces=WORKSPACES, datasets=DATASETS,
              reports=REPORT_HOME, watched=[("P", "r1")])
    code = build(spark, policies=policy(spark), **kw)
    readme = build(spark, policies=policy(spark, source_over=True), **kw)
    assert decision_of(code) == decision_of(readme) == "TARGET_OVERLOADED"
    assert code.alerts.count() == 1 and readme.alerts.count() == 0
    kw["events"] = [event("A", 0.9), event("B", 0.45)]
    assert build(spark, policies=policy(spark, source_over=True), **kw).alerts.count() == 1


def test_anchor_on_newest_event(spark):
    old = AS_OF - dt.timedelta(days=3)
    ev = parse_events(spark.createDataFrame([event("A", 0.5, when=old), event("A", 0.25, when=old - LOOKBACK * 2)],
                                            schemas.CAPACITY_EVENTS))
    params = RunParams(as_of=AS_OF, lookback=LOOKBACK)
    assert capacity_peak(ev, params).count() == 0
    anchored = anchor_on_newest_event(ev, params)
    assert anchored.as_of == old
    assert [r["peak_utilization"] for r in capacity_peak(ev, anchored).collect()] == [0.5]


def test_interactive_share_metric(spark):
    ev = parse_events(spark.createDataFrame([event("A", 0.9)], schemas.CAPACITY_EVENTS))
    params = dataclasses.replace(RunParams(as_of=AS_OF, lookback=LOOKBACK), metric="interactive_share")
    assert [r["peak_utilization"] for r in capacity_peak(ev, params).collect()] == [0.5]


def test_watched_pairs_name_the_report_of_that_workspace(spark):
    """A pair is looked up by workspace and report: one that is not listed there resolves to nothing."""
    reports = [("r1", "wsA", "dsA"), ("r1", "wsC", "dsA_copy"), ("r2", "wsA", "dsA")]
    pairs = spark.createDataFrame([("P", "r1", " wsC "), ("P", "r2", None), ("Q", "r1", "wsA"), ("Q", "r2", "wsX")],
                                  schemas.WATCHED_PAIRS)
    policies = [(p, "", "", "wsB", 0.5, 0.25, 0.8) for p in ("P", "Q")]
    run = build(spark, events=[event("A", 0.9)], workspaces=WORKSPACES, datasets=DATASETS, reports=reports,
                watched=pairs, policies=policies)
    got = {(r["policy_id"], r["report_id"]): (r["decision"], r["report_workspace_id"]) for r in run.decisions.collect()}
    assert got == {("P", "r1"): ("SAME_CAPACITY", "wsC"), ("P", "r2"): ("MOVE", "wsA"),
                   ("Q", "r1"): ("MOVE", "wsA"), ("Q", "r2"): ("UNRESOLVED", "wsX")}


def test_ingested_events_prune_partitions_and_give_same_peaks(spark, tmp_dir):
    from capshift.sources.events import ingest_capacity_events, read_typed_events
    from capshift.sources.fixtures import Fixture
    fx = Fixture(spark, "/root/testdata/sf0.001")
    halves = [fx.capacity_events.where(F.hash("data") % 2 == k) for k in (0, 1)]
    halves[1] = fx.capacity_events.exceptAll(halves[0])
    for batch, half in (("b0", halves[0]), ("b1", halves[1]), ("b0", halves[0])):  # two increments, one retried
        ingest_capacity_events(half, f"{tmp_dir}/events", batch)
    typed = read_typed_events(spark, f"{tmp_dir}/events")
    assert typed.count() == fx.table("events").count()
    via_json = {r["capacity_id"]: r["peak_utilization"]
                for r in capacity_peak(parse_events(fx.capacity_events), fx.params).collect()}
    peaks = capacity_peak(typed, fx.params)
    assert {r["capacity_id"]: r["peak_utilization"] for r in peaks.collect()} == via_json
    plan = peaks._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line][0]
    assert "PartitionFilters: [isnotnull(event_date" in scan and "2024-01-21" in scan


def test_balance_on_ingested_typed_events(spark, tmp_dir):
    from capshift.catalog import fixture_run
    from capshift.plans.balance import BalanceRun
    from capshift.sources.events import ingest_capacity_events, read_typed_events
    run = fixture_run(spark, "/root/testdata/sf0.001")
    ingest_capacity_events(run.capacity_events, f"{tmp_dir}/typed", "b0")
    typed_run = BalanceRun(run.params, run.policies, run.watched, run.state, run.inv,
                           read_typed_events(spark, f"{tmp_dir}/typed"), materialize=False)
    key = ["policy_id", "report_id"]
    assert typed_run.decisions.orderBy(key).collect() == run.decisions.orderBy(key).collect()


def test_peak_for_named_capacities_is_case_sensitive(spark):
    ev = parse_events(spark.createDataFrame([event("A", 0.5), event("a", 0.75), event("B", 0.25)],
                                            schemas.CAPACITY_EVENTS))
    params = RunParams(as_of=AS_OF, lookback=LOOKBACK)
    got = {r["capacity_id"]: r["peak_utilization"] for r in capacity_peak(ev, params, ["A"]).collect()}
    assert got == {"A": 0.5}
