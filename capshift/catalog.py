"""Named queries over the driver's tables: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query runs over whole tables through the fixture mapping of FIXTURES.md
(policy P1 unless the name says otherwise) and returns a DataFrame without
collecting it. The streaming queries drain their stream into the shared
checkpoint folder and return the sink read back as a table.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capshift.operators import lineage, peaks, policy, replay, state
from capshift.plans import workplan
from capshift.plans.balance import BalanceRun, Inventory, Traced
from capshift.sources.events import in_lookback, parse_events, with_metrics
from capshift.sources import tables
from capshift.sources.fixtures import HEADROOM, MOVE_T, RECOVER_R, TARGET_NATION, Fixture
from capshift.session import scratch_path
from capshift.streaming import balance as stream_balance
from capshift.streaming import hysteresis as stream_hyst
from capshift.streaming import peak as stream_pk

REPLAY_STEP = dt.timedelta(hours=6)
# The event table arrives in four parts, one a week, the last with all that is later.
FIRST_WEEK, WEEKS = dt.datetime(2024, 1, 1), 4


def fixture_run(spark: SparkSession, sf_dir: str, policy_name: str = "P1") -> BalanceRun:
    fx = Fixture(spark, sf_dir, policy_name)
    return BalanceRun(fx.params, source=fx)


# -- events ------------------------------------------------------------------------
def q_events_scan(spark, sf_dir):
    return Fixture(spark, sf_dir).capacity_events


def q_events_parsed(spark, sf_dir):
    return parse_events(Fixture(spark, sf_dir).capacity_events)


def q_events_recent(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return in_lookback(parse_events(fx.capacity_events), fx.params)


def q_utilization(spark, sf_dir):
    return with_metrics(parse_events(Fixture(spark, sf_dir).capacity_events)).select(
        "time", "capacity_id", "utilization")


def q_interactive_share(spark, sf_dir):
    return with_metrics(parse_events(Fixture(spark, sf_dir).capacity_events)).select(
        "time", "capacity_id", "interactive_share")


def q_capacity_peak(spark, sf_dir):
    return fixture_run(spark, sf_dir).peak_plan


def q_capacity_peak_interactive(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    params = dataclasses.replace(fx.params, metric="interactive_share")
    return peaks.capacity_peak(parse_events(fx.capacity_events), params)


def q_capacity_peak_named(spark, sf_dir):
    """The peaks of the two fixture targets' capacities alone."""
    fx = Fixture(spark, sf_dir)
    return peaks.capacity_peak(parse_events(fx.capacity_events), fx.params, [str(n) for n in TARGET_NATION.values()])


def q_rolling_peak(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return peaks.rolling_peak(parse_events(fx.capacity_events), fx.params.lookback)


# -- inventory -----------------------------------------------------------------------
def q_watched_reports(spark, sf_dir):
    return lineage.watched_reports(Fixture(spark, sf_dir).watch_lists)


def q_normalized_ids(spark, sf_dir):
    return lineage.id_tokens(Fixture(spark, sf_dir).watch_lists)


def q_report_lineage(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    return lineage.report_lineage(run.watched, run.inv.reports, run.inv.datasets, run.inv.workspaces)


def q_workspace_by_name(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return lineage.workspace_by_name(fx.customer_policies.select("policy_id", "workspace_name"), fx.workspaces)


def q_copy_lookup(spark, sf_dir):
    return fixture_run(spark, sf_dir).copies


def q_policy_check(spark, sf_dir):
    return policy.policy_check(Fixture(spark, sf_dir).customer_policies)


def q_resolve_target(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return policy.resolve_target(fx.customer_policies, fx.workspaces)


# -- decisions -----------------------------------------------------------------------
def q_repoint_lookup(spark, sf_dir):
    return fixture_run(spark, sf_dir).lookups


def q_repointed_ids(spark, sf_dir):
    return state.repointed_ids(Fixture(spark, sf_dir).state)


def q_recoveries(spark, sf_dir):
    return fixture_run(spark, sf_dir).recovered


def q_remaining_reports(spark, sf_dir):
    return fixture_run(spark, sf_dir).remaining.select("policy_id", "report_id")


def q_target_gate(spark, sf_dir):
    return fixture_run(spark, sf_dir).gate


def q_move_decisions(spark, sf_dir):
    return fixture_run(spark, sf_dir).moves


def q_decisions(spark, sf_dir):
    return fixture_run(spark, sf_dir).decisions


def q_decisions_alt_target(spark, sf_dir):
    return fixture_run(spark, sf_dir, "P2").decisions


# -- state and plans -----------------------------------------------------------------
def q_repoint_upsert(spark, sf_dir):
    return fixture_run(spark, sf_dir).next_state


def q_repoint_delete(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    return state.repoint_delete(run.state, run.recovered)


def q_alerts(spark, sf_dir):
    # The P2 run is the one whose target is overloaded, so it raises the alert.
    return fixture_run(spark, sf_dir, "P2").alerts


def q_alerts_csv(spark, sf_dir):
    """K6: the alerts written as CSV and read back."""
    path = scratch_path(spark, "alerts-csv")
    tables.write_alerts_csv(fixture_run(spark, sf_dir, "P2").alerts, path)
    return tables.read_alerts_csv(spark, path)


def q_state_table(spark, sf_dir):
    """The catalog's state table holds the state before a run and after its recoveries; the newest is read."""
    run = fixture_run(spark, sf_dir)
    database, root = f"capshift_{uuid.uuid4().hex}", scratch_path(spark, "state-table")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}'")
    name = f"{database}.report_repoints"
    tables.ensure_tables(spark, database, root)
    for run_id, rows in (("20240115", run.state), ("20240122", state.repoint_delete(run.state, run.recovered))):
        tables.write_run_partition(rows, name, run_id)
    return tables.latest_snapshot(spark, name)


def q_decision_log(spark, sf_dir):
    return fixture_run(spark, sf_dir).log


def q_action_table(spark, sf_dir):
    return fixture_run(spark, sf_dir).action_requests


def q_workspace_plan(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return workplan.workspace_plan(workplan.new_workspaces(fx.customer_policies, fx.workspaces))


def q_work_plan(spark, sf_dir):
    return fixture_run(spark, sf_dir).work_plan


def q_connection_bindings(spark, sf_dir):
    return fixture_run(spark, sf_dir).connection_bindings


def q_refresh_plan(spark, sf_dir):
    plan = fixture_run(spark, sf_dir).refresh_plan
    return plan.withColumns({"days": F.array_join("days", ","), "times": F.array_join("times", ",")})


def q_pick_target(spark, sf_dir):
    # The P2 run's own target is overloaded: its reports are spread over capacities with room.
    return fixture_run(spark, sf_dir, "P2").picked_targets


# -- history and streams -------------------------------------------------------------
def _target_capacity(fx: Fixture) -> str:
    return str(fx.table("customer").where(F.col("c_custkey") == int(fx.target_workspace))
               .select("c_nationkey").first()[0])


def _replay(fx: Fixture) -> replay.Replay:
    return replay.Replay(parse_events(fx.capacity_events), replay.Rules(
        _target_capacity(fx), MOVE_T, RECOVER_R, HEADROOM, fx.params.lookback, REPLAY_STEP))


def q_hysteresis_replay(spark, sf_dir):
    return _replay(Fixture(spark, sf_dir)).ticks()


def q_report_replay(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    homes = replay.report_homes(lineage.watched_reports(fx.watch_lists), fx.state, fx.reports, fx.datasets, fx.workspaces)
    return _replay(fx).of_reports(homes)


def _event_stream(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    # The driver's events table is the stream source; the fixture mapping is a
    # per-row projection, so it applies to a stream as it does to a table.
    raw = (spark.readStream.schema(fx.table("events").schema).option("maxFilesPerTrigger", 256)
           .option("pathGlobFilter", "events.parquet").parquet(fx.sf_dir))
    return Fixture.envelope_from_events(raw)


def q_stream_peak(spark, sf_dir):
    return stream_pk.stream_peak(spark, _event_stream(spark, sf_dir))


def q_stream_hysteresis(spark, sf_dir):
    return stream_hyst.stream_hysteresis(spark, _event_stream(spark, sf_dir), MOVE_T, RECOVER_R)


def q_balance_stream(spark, sf_dir):
    """The events arrive week by week; every arrival is one run that starts from the state of the one before."""
    fx = Fixture(spark, sf_dir)
    root = scratch_path(spark, "balance_stream")
    events = fx.table("events")
    week = F.floor(F.timestamp_diff("SECOND", F.lit(FIRST_WEEK).cast("timestamp_ntz"), F.col("ts")) / (7 * 86400))
    week = F.least(F.greatest(week, F.lit(0)), F.lit(WEEKS - 1))

    inventory = Inventory(fx.workspaces, fx.datasets, fx.reports)
    traced = Traced(lineage.watched_reports(fx.watch_lists), inventory)  # the same for all runs

    def make_run(params, repoints, typed):
        return BalanceRun.from_watch_lists(params, fx.policies, fx.watch_lists, repoints, inventory, typed, traced=traced)

    for at in range(WEEKS):
        events.where(week == at).write.mode("append").parquet(f"{root}/arrivals")
        arrived = spark.readStream.schema(events.schema).parquet(f"{root}/arrivals")
        store = stream_balance.balance_stream(spark, Fixture.envelope_from_events(arrived), root, make_run,
                                              fx.params.lookback, fx.state)
    traced.release()
    runs = store.commits().select(F.col("number").alias("run_number"), "as_of")
    return store.table("decisions").drop("run_id").join(F.broadcast(runs), "run_number")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "events_scan": q_events_scan,
    "events_parsed": q_events_parsed,
    "events_recent": q_events_recent,
    "utilization": q_utilization,
    "interactive_share": q_interactive_share,
    "capacity_peak": q_capacity_peak,
    "capacity_peak_interactive": q_capacity_peak_interactive,
    "capacity_peak_named": q_capacity_peak_named,
    "rolling_peak": q_rolling_peak,
    "watched_reports": q_watched_reports,
    "normalized_ids": q_normalized_ids,
    "report_lineage": q_report_lineage,
    "workspace_by_name": q_workspace_by_name,
    "copy_lookup": q_copy_lookup,
    "policy_check": q_policy_check,
    "resolve_target": q_resolve_target,
    "repoint_lookup": q_repoint_lookup,
    "repointed_ids": q_repointed_ids,
    "recoveries": q_recoveries,
    "remaining_reports": q_remaining_reports,
    "target_gate": q_target_gate,
    "move_decisions": q_move_decisions,
    "decisions": q_decisions,
    "decisions_alt_target": q_decisions_alt_target,
    "repoint_upsert": q_repoint_upsert,
    "repoint_delete": q_repoint_delete,
    "alerts": q_alerts,
    "alerts_csv": q_alerts_csv,
    "state_table": q_state_table,
    "decision_log": q_decision_log,
    "action_table": q_action_table,
    "workspace_plan": q_workspace_plan,
    "work_plan": q_work_plan,
    "connection_bindings": q_connection_bindings,
    "refresh_plan": q_refresh_plan,
    "pick_target": q_pick_target,
    "hysteresis_replay": q_hysteresis_replay,
    "report_replay": q_report_replay,
    "stream_peak": q_stream_peak,
    "stream_hysteresis": q_stream_hysteresis,
    "balance_stream": q_balance_stream,
}
