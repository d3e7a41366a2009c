"""One balancing run over all policies and reports: inputs in, tables out.

``BalanceRun`` only declares DataFrames; nothing is collected. Each derived
table is built once and reused by the tables that depend on it, so Catalyst
sees one plan per output and can reuse shared exchanges. ``write`` persists a
run: the next state snapshot and the action tables go to a new ``run_id``
folder, the decision log and alerts are appended.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from capshift.operators import decide, lineage, peaks, state, targets
from capshift.operators.joins import join_small
from capshift.params import RunParams
from capshift.session import scratch_path
from capshift.plans import actions, logs, workplan
from capshift.sources.events import parse_events


@dataclass
class Inventory:
    workspaces: DataFrame
    datasets: DataFrame
    reports: DataFrame
    datasources: DataFrame | None = None
    connections: DataFrame | None = None
    refresh_schedules: DataFrame | None = None


class LazyInventory:
    """Inventory whose tables are read from ``source`` only when a run needs them."""

    FIELDS = ("workspaces", "datasets", "reports", "datasources", "connections", "refresh_schedules")

    def __init__(self, source):
        self._source = source

    def __getattr__(self, name):
        if name in LazyInventory.FIELDS:
            return getattr(self._source, name)
        raise AttributeError(name)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _delete(paths: list[str]) -> None:
    spark = SparkSession.getActiveSession()
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


class Traced:
    """What runs over one and the same inventory and watched list have in common, worked out once for all of them.

    Neither events nor state touch the lineage of the watched reports and the places of the
    datasets. Both are written on first use, under the shared checkpoint folder, and read by
    every run they are given to; ``release`` deletes them.
    """

    def __init__(self, watched: DataFrame, inventory: Inventory | LazyInventory):
        self._watched, self._inv = watched, inventory
        self._paths: list[str] = []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(df.sparkSession, f"traced/{name}")
        self._paths.append(path)
        return _kept(df, path)

    @cached_property
    def reports(self) -> DataFrame:
        inv = self._inv
        return self._keep(decide.traced_reports(self._watched, inv.reports, inv.datasets, inv.workspaces), "reports")

    @cached_property
    def datasets(self) -> DataFrame:
        return self._keep(decide.placed_datasets(self._inv.datasets, self._inv.workspaces), "datasets")

    def release(self) -> None:
        _delete(self._paths)


class BalanceRun:
    """Inputs are DataFrames, or are read on first use from ``source`` (any object
    with attributes ``policies``, ``watch_lists``, ``state``, ``capacity_events``
    and the inventory tables), so building a run costs nothing until an output
    is asked for.
    """

    def __init__(self, params: RunParams, policies: DataFrame | None = None, watched: DataFrame | None = None,
                 state_df: DataFrame | None = None, inventory: Inventory | LazyInventory | None = None,
                 capacity_events: DataFrame | None = None, materialize: bool = True,
                 watch_lists: DataFrame | None = None, source=None, strict: bool = False, traced: Traced | None = None):
        """``traced``: the lineage of these watched reports in this inventory, shared with other runs. ``strict`` makes a run fail whose inputs break a uniqueness check; otherwise ``checks`` counts such reports."""
        self.params = params
        self.strict = strict
        self.checks: dict[str, int] = {}
        self._kept: list[str] = []
        self._observed = Observation(f"tick of {params.run_id}")
        self.materialize = materialize
        self._given = {"policies": policies, "watched": watched, "state": state_df,
                       "capacity_events": capacity_events, "watch_lists": watch_lists}
        self._source = source
        self._traced = traced
        self.inv = inventory if inventory is not None else LazyInventory(source)

    def _input(self, name: str) -> DataFrame:
        df = self._given.get(name)
        return df if df is not None else getattr(self._source, name)

    @classmethod
    def from_watch_lists(cls, params, policies, watch_lists, state_df, inventory, capacity_events, **kw):
        return cls(params, policies, None, state_df, inventory, capacity_events, watch_lists=watch_lists, **kw)

    @cached_property
    def policies(self) -> DataFrame:
        return self._input("policies")

    @cached_property
    def state(self) -> DataFrame:
        return self._input("state")

    @cached_property
    def capacity_events(self) -> DataFrame:
        return self._input("capacity_events")

    @cached_property
    def watched(self) -> DataFrame:
        if self._given["watched"] is not None:
            return self._given["watched"]
        return lineage.watched_reports(self._input("watch_lists"))

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """Cut lineage at a table many outputs read: write it once as Parquet under
        the shared checkpoint folder and read it back (one job; survives executor
        loss; never a machine-local folder on a cluster)."""
        if not self.materialize:
            return df
        path = scratch_path(df.sparkSession, f"run-{self.params.run_id}/{name}")
        self._kept.append(path)
        return _kept(df, path)

    def release(self) -> None:
        """Delete the tables that the run kept for itself; its outputs are no longer read from it afterwards."""
        _delete(self._kept)

    # -- measurements -----------------------------------------------------------
    @cached_property
    def parsed_events(self) -> DataFrame:
        # the raw envelope (time, data JSON) is parsed; an ingested typed table is used as is
        events = self.capacity_events
        return parse_events(events) if "data" in events.columns else events

    @cached_property
    def peak_plan(self) -> DataFrame:
        return peaks.capacity_peak(self.parsed_events, self.params)

    @cached_property
    def peaks(self) -> DataFrame:
        return self._keep(self.peak_plan, "peaks")

    # -- policies -------------------------------------------------------------
    @cached_property
    def context(self) -> DataFrame:
        return self._keep(decide.policy_context(self.policies, self.inv.workspaces, self.peaks), "context")

    @cached_property
    def watched_ctx(self) -> DataFrame:
        # One policy may watch most reports: a shuffle on policy_id would put
        # them all in one task, so the (size-checked) context is broadcast.
        return join_small(self.watched, self.context, "policy_id", "left")

    # -- the tick ---------------------------------------------------------------
    @cached_property
    def tick(self) -> DataFrame:
        if self._traced is None:
            tick = decide.tick_table(self.watched_ctx, self.state, self.inv.reports, self.inv.datasets,
                                     self.inv.workspaces, self.peaks)
        else:
            traced_ctx = join_small(self._traced.reports, self.context, "policy_id", "left")
            tick = decide.tick_of_traced(traced_ctx, self.state, self._traced.datasets, self.peaks)
        if self.materialize:
            tick = self._keep(tick.observe(self._observed, *decide.tick_checks(tick)), "tick")
            self.checks = dict(self._observed.get)
            broken = {name: n for name, n in self.checks.items() if n}
            if broken and self.strict:
                raise ValueError(f"run {self.params.run_id}: {broken}")
        rivals = decide.contested(tick)
        if self.materialize and rivals.isEmpty():
            return tick
        return decide.one_action_per_report(tick, self._keep(rivals, "contested"))

    @cached_property
    def lookups(self) -> DataFrame:
        return decide.repoint_lookup(self.tick)

    @cached_property
    def recovered(self) -> DataFrame:
        return decide.recoveries(self.tick)

    @cached_property
    def remaining(self) -> DataFrame:
        return decide.remaining_reports(self.tick)

    @cached_property
    def gate(self) -> DataFrame:
        return decide.target_gate(self.context, self.remaining)

    @cached_property
    def moves(self) -> DataFrame:
        return decide.move_decisions(self.tick)

    @cached_property
    def decisions(self) -> DataFrame:
        return decide.all_decisions(self.tick)

    # -- plans and outputs --------------------------------------------------------
    @cached_property
    def copy_plan(self) -> DataFrame:
        # Read by the actions, the state, the log and both plans: written once.
        moved = self.tick.where(F.col("decision") == "MOVE").select(*decide.MOVE_COLUMNS, "workspace_name")
        return self._keep(lineage.copy_lookup(moved, self.inv.datasets, ("report_workspace_id", "utilization", "workspace_name")),
                          "copies")

    @cached_property
    def copies(self) -> DataFrame:
        return self.copy_plan.drop("report_workspace_id", "utilization", "workspace_name")

    @cached_property
    def _actions(self) -> DataFrame:
        return actions.action_table(self.recovered, self.copy_plan)

    @cached_property
    def actions(self) -> DataFrame:
        return self._actions.drop("workspace_name")

    @cached_property
    def action_requests(self) -> DataFrame:
        """The actions with their status and JSON body."""
        return actions.with_rebind_payload(self._actions)

    @cached_property
    def _moved_datasets(self) -> DataFrame:
        return actions.moved_datasets(self.copy_plan)

    @cached_property
    def moved_datasets(self) -> DataFrame:
        return self._moved_datasets.drop("workspace_name")

    @cached_property
    def _bindings(self) -> DataFrame:
        return actions.connection_bindings(self._moved_datasets, self.inv.datasources, self.inv.connections)

    @cached_property
    def connection_bindings(self) -> DataFrame:
        return self._bindings.drop("workspace_name")

    @cached_property
    def _refreshes(self) -> DataFrame:
        return actions.refresh_plan(self._moved_datasets, self.inv.refresh_schedules)

    @cached_property
    def refresh_plan(self) -> DataFrame:
        return self._refreshes.drop("workspace_name")

    @cached_property
    def new_workspaces(self) -> DataFrame:
        return workplan.new_workspaces(self.policies, self.inv.workspaces)

    @cached_property
    def work_plan(self) -> DataFrame:
        """All requests of the run in order (``workplan``)."""
        plan = workplan.workspace_plan(self.new_workspaces).unionByName(workplan.copy_requests(self._moved_datasets))
        if self._binds:
            plan = plan.unionByName(workplan.after_copy(self._bindings, "BIND_CONNECTION"))
        if self.inv.refresh_schedules is not None:
            plan = plan.unionByName(workplan.after_copy(self._refreshes, "SET_SCHEDULE"))
        return plan.unionByName(workplan.rebind_requests(self._actions))

    @property
    def _binds(self) -> bool:
        return self.inv.datasources is not None and self.inv.connections is not None

    @cached_property
    def next_state(self) -> DataFrame:
        # A move is remembered once its copy has an id: before that nothing can be bound to it.
        known = (F.col("action") == "MOVE") & F.col("target_dataset_id").isNotNull()
        moved = self.actions.where(known).select(
            "policy_id", F.col("source_dataset_id").alias("initial_dataset_id"), "report_workspace_id", "report_id",
            "target_dataset_id", "target_workspace_id")
        return state.repoint_upsert(self.state, self.recovered, moved, self.params.as_of)

    @cached_property
    def log(self) -> DataFrame:
        return logs.decision_log(self.params, self.peaks, self.tick, self.gate, self.actions, self.new_workspaces,
                                 self.connection_bindings if self._binds else None)

    @cached_property
    def alerts(self) -> DataFrame:
        return logs.alerts(self.params, self.gate)

    @cached_property
    def picked_targets(self) -> DataFrame:
        """Advice: a capacity with room for every report that should leave its own (``targets``)."""
        return targets.pick_targets(self.tick, self.context, self.inv.workspaces, self.peaks)

    # -- persistence --------------------------------------------------------------
    def write(self, root: str) -> dict[str, str]:
        """Persist the run under ``root`` (a shared folder). Re-running the same
        ``run_id`` overwrites only that run's own folders, so a retried run
        gives the same files; the state folder being read is never the target.
        """
        rid = self.params.run_id
        out = {
            "report_repoints": f"{root}/report_repoints/run_id={rid}",
            "decisions": f"{root}/decisions/run_id={rid}",
            "actions": f"{root}/actions/run_id={rid}",
            "work_plan": f"{root}/work_plan/run_id={rid}",
            "copies": f"{root}/copies/run_id={rid}",
            "connection_bindings": f"{root}/connection_bindings/run_id={rid}",
            "refresh_plan": f"{root}/refresh_plan/run_id={rid}",
            "decision_log": f"{root}/decision_log/run_id={rid}",
            "alerts": f"{root}/alerts/run_id={rid}",
        }
        self.next_state.write.mode("overwrite").parquet(out["report_repoints"])
        self.decisions.write.mode("overwrite").parquet(out["decisions"])
        self.action_requests.write.mode("overwrite").parquet(out["actions"])
        self.work_plan.write.mode("overwrite").parquet(out["work_plan"])
        self.copies.write.mode("overwrite").parquet(out["copies"])
        if self._binds:
            self.connection_bindings.write.mode("overwrite").parquet(out["connection_bindings"])
        else:
            del out["connection_bindings"]
        if self.inv.refresh_schedules is not None:
            self.refresh_plan.write.mode("overwrite").parquet(out["refresh_plan"])
        else:
            del out["refresh_plan"]
        self.log.write.mode("overwrite").parquet(out["decision_log"])
        self.alerts.write.mode("overwrite").parquet(out["alerts"])
        return out
