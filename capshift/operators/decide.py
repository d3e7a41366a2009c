"""The balancing tick as set operations over all policies and reports.

Contract (one tick, per policy):
  1. peak(cap) once for every capacity; a known capacity without events reads 0.
  2. recover = watched reports with a state row whose initial dataset still
     resolves to a capacity, with peak(initial capacity) < R (strict).
  3. remaining = watched minus recover.
  4. gate = peak(target capacity) > headroom x T (strict). With a gate and any
     remaining report, every remaining report is TARGET_OVERLOADED (and the
     policy raises one alert).
  5. else per remaining report: no capacity found -> UNRESOLVED; current
     capacity = target capacity -> SAME_CAPACITY; peak > T (strict) -> MOVE;
     otherwise LOW_UTILIZATION.
  6. a report that several policies would act on is acted on once: a recovery goes
     before a move, then the smallest policy id; the others read SUPERSEDED.
Watched reports of a policy that fails validation or has no resolvable target
get INVALID_POLICY and nothing else happens for them.

All of it is one table, ``tick_table``: each watched report joined once with
its state row, its current lineage and its home (initial) lineage, and the
decision is one ``when`` chain. Every other output of the run is a filter or
projection of that table, so the joins run once per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.functions.ids import py_strip
from capshift.functions.metrics import floor_zero
from capshift.operators.joins import join_small
from capshift.operators.lineage import one_dataset, one_report, one_workspace, report_in_workspace
from capshift.operators.policy import with_checks, with_target
from capshift.params import DEFAULT_HEADROOM

# Decision kinds in precedence order.
DECISION_KINDS = ("INVALID_POLICY", "RECOVER", "TARGET_OVERLOADED", "UNRESOLVED", "SAME_CAPACITY",
                  "MOVE", "LOW_UTILIZATION", "SUPERSEDED")

DECISION_COLUMNS = ["policy_id", "report_id", "decision", "report_workspace_id", "capacity_id",
                    "utilization", "target_workspace_id", "target_capacity_id"]
MOVE_COLUMNS = ["policy_id", "report_id", "decision", "report_workspace_id", "dataset_id", "dataset_name",
                "dataset_workspace_id", "capacity_id", "utilization", "target_workspace_id", "target_capacity_id"]
RECOVERY_COLUMNS = ["policy_id", "report_id", "report_workspace_id", "target_dataset_id", "initial_dataset_id",
                    "initial_workspace_id", "initial_capacity_id", "initial_peak"]


def with_peak(df: DataFrame, peaks: DataFrame, cap_col: str, out_col: str,
              events_col: str | None = None) -> DataFrame:
    """Attach a capacity's peak; known capacity without events -> 0, unknown -> null.

    ``events_col`` also attaches the number of events behind the peak (0 if none).
    """
    p = peaks.select(F.col("capacity_id").alias(cap_col), F.col("peak_utilization").alias("_peak"),
                     F.col("n_events").alias("_n"))
    cols = {out_col: F.when(F.col(cap_col).isNotNull(), floor_zero(F.col("_peak")))}
    if events_col:
        cols[events_col] = F.coalesce(F.col("_n"), F.lit(0))
    return df.join(p, cap_col, "left").withColumns(cols).drop("_peak", "_n")


# Optional policy columns and their defaults (the reference's behaviour):
#   min_events: events a home capacity needs in the look-back before a recovery
#               is decided (0: silence reads as 0 and counts as recovered)
#   alert_requires_source_over: alert only when some remaining report's own
#               capacity is above T as well (the README's wording, D1)
OPTIONAL_POLICY_COLUMNS = {"min_events": 0, "alert_requires_source_over": False, "headroom": DEFAULT_HEADROOM}


def _option(df: DataFrame, name: str) -> F.Column:
    if name in df.columns:
        return F.coalesce(F.col(name), F.lit(OPTIONAL_POLICY_COLUMNS[name]))
    return F.lit(OPTIONAL_POLICY_COLUMNS[name])


def policy_context(policies: DataFrame, workspaces: DataFrame, peaks: DataFrame) -> DataFrame:
    """Per policy: thresholds, validity, target and its gate."""
    policies = policies.withColumns({c: _option(policies, c) for c in OPTIONAL_POLICY_COLUMNS})
    ctx = with_target(with_checks(policies), workspaces)
    ctx = with_peak(ctx, peaks, "target_capacity_id", "target_peak")
    valid = F.coalesce(F.col("is_valid"), F.lit(False)) & (F.col("resolution") != "UNRESOLVED")
    gate = F.col("headroom") * F.col("move_threshold")
    return ctx.select(
        "policy_id", "move_threshold", "recovery_threshold", "target_workspace_id",
        "target_capacity_id", "resolution", "workspace_name", valid.alias("valid"), "target_peak", gate.alias("gate_threshold"),
        F.coalesce(F.col("target_peak") > gate, F.lit(False)).alias("overloaded"),
        *OPTIONAL_POLICY_COLUMNS)


def state_rows(state: DataFrame) -> DataFrame:
    """The state reduced to one row per report (L1), the smallest, with the number of rows it had."""
    columns = ["initial_dataset_id", "target_dataset_id", "target_workspace_id"]
    one = state.groupBy("report_id").agg(F.min(F.struct(*columns)).alias("_first"), F.count(F.lit(1)).alias("n_state"))
    return one.select("report_id", "n_state", *[F.col("_first")[c].alias(c) for c in columns]).withColumnRenamed(
        "target_workspace_id", "state_target_workspace_id")


def placed_datasets(datasets: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Where every dataset lies: (initial_dataset_id, initial_workspace_id, initial_capacity_id), one row per dataset."""
    d, w = one_dataset(datasets), one_workspace(workspaces)
    home_ds = d.select(F.col("workspace_id").alias("initial_workspace_id"), F.col("dataset_id").alias("initial_dataset_id"))
    home_ws = w.select(F.col("workspace_id").alias("initial_workspace_id"), F.col("capacity_id").alias("initial_capacity_id"))
    return home_ds.join(home_ws, "initial_workspace_id", "left")


def home_of(state: DataFrame, datasets: DataFrame, workspaces: DataFrame, peaks: DataFrame) -> DataFrame:
    """Per report of the state its home: initial dataset -> workspace -> capacity -> peak.

    Resolved on the state alone, so the reports that were never moved (most of them)
    never meet as null keys in these joins.
    """
    s = state_rows(state)
    d, w = one_dataset(datasets), one_workspace(workspaces)
    home_ds = d.select(F.col("dataset_id").alias("initial_dataset_id"),
                       F.col("workspace_id").alias("initial_workspace_id"))
    home_ws = w.select(F.col("workspace_id").alias("initial_workspace_id"),
                       F.col("capacity_id").alias("initial_capacity_id"))
    s = s.join(home_ds, "initial_dataset_id", "left").join(home_ws, "initial_workspace_id", "left")
    return with_peak(s, peaks, "initial_capacity_id", "initial_peak", events_col="initial_events")


def _current_lineage(j: DataFrame, reports: DataFrame, datasets: DataFrame, workspaces: DataFrame) -> DataFrame:
    """J1-J4 on rows with a ``report_id`` (and a ``workspace_id`` where the watched list names it)."""
    r = one_report(reports).withColumnsRenamed({"workspace_id": "report_workspace_id", "n_listed": "n_report"})
    d, w = one_dataset(datasets), one_workspace(workspaces)
    cur_ds = d.select("dataset_id", F.col("name").alias("dataset_name"),
                      F.col("workspace_id").alias("dataset_workspace_id"))
    cur_ws = w.select(F.col("workspace_id").alias("dataset_workspace_id"), "capacity_id")
    j = j.join(r, "report_id", "left")
    if "given_workspace_id" in j.columns:
        given = F.col("given_workspace_id").isNotNull()
        j = j.withColumns({
            "report_workspace_id": F.when(given, F.col("given_workspace_id")).otherwise(F.col("report_workspace_id")),
            "dataset_id": F.when(given, F.col("pair_dataset_id")).otherwise(F.col("dataset_id"))}).drop("pair_dataset_id")
    return j.join(cur_ds, "dataset_id", "left").join(cur_ws, "dataset_workspace_id", "left")


def _given_pairs(watched: DataFrame, reports: DataFrame) -> DataFrame:
    """A watched pair is the report of that workspace; a pair that is not listed resolves to nothing."""
    if "workspace_id" not in watched.columns:
        return watched
    pairs = report_in_workspace(reports).select(
        "report_id", F.col("workspace_id").alias("given_workspace_id"), F.col("dataset_id").alias("pair_dataset_id"))
    j = watched.withColumn("given_workspace_id", py_strip(F.col("workspace_id"))).drop("workspace_id")
    return j.join(pairs, ["report_id", "given_workspace_id"], "left")


def traced_reports(watched: DataFrame, reports: DataFrame, datasets: DataFrame, workspaces: DataFrame) -> DataFrame:
    """The part of the tick that no event and no state touches: every watched report with its current lineage."""
    return _current_lineage(_given_pairs(watched, reports), reports, datasets, workspaces)


def tick_table(watched_ctx: DataFrame, state: DataFrame, reports: DataFrame, datasets: DataFrame,
               workspaces: DataFrame, peaks: DataFrame) -> DataFrame:
    """Every watched report with its state row, both lineages, both peaks and its decision.

    ``watched_ctx`` is the watched list joined with ``policy_context``. Joins:
    the state with its homes and the reports on report_id (co-partitioned, one shuffle
    of each side), datasets on the current dataset id, workspaces and peaks (small;
    broadcast when measured small at run time).
    """
    j = _given_pairs(watched_ctx, reports).join(home_of(state, datasets, workspaces, peaks), "report_id", "left")
    return _decided(_current_lineage(j, reports, datasets, workspaces), peaks)


def tick_of_traced(traced_ctx: DataFrame, state: DataFrame, placed: DataFrame, peaks: DataFrame) -> DataFrame:
    """``tick_table`` from ``traced_reports`` (joined with ``policy_context``) and ``placed_datasets``, both there already."""
    homes = with_peak(state_rows(state).join(placed, "initial_dataset_id", "left"), peaks,
                      "initial_capacity_id", "initial_peak", events_col="initial_events")
    return _decided(traced_ctx.join(homes, "report_id", "left"), peaks)


# Columns that are the same for all reports of a policy and that nothing reads once the decision is taken.
DECIDED_BY = ("recovery_threshold", "resolution", "target_peak", "gate_threshold", "overloaded", "initial_events",
              *OPTIONAL_POLICY_COLUMNS)


def _decided(j: DataFrame, peaks: DataFrame) -> DataFrame:
    j = with_peak(j, peaks, "capacity_id", "utilization")
    valid = F.coalesce(F.col("valid"), F.lit(False))
    recover = (valid & F.col("initial_dataset_id").isNotNull() & F.col("initial_capacity_id").isNotNull()
               & (F.col("initial_peak") < F.col("recovery_threshold"))
               & (F.col("initial_events") >= F.col("min_events")))
    decision = (F.when(~valid, "INVALID_POLICY")
                .when(recover, "RECOVER")
                .when(F.col("overloaded"), "TARGET_OVERLOADED")
                .when(F.col("capacity_id").isNull(), "UNRESOLVED")
                .when(F.col("capacity_id") == F.col("target_capacity_id"), "SAME_CAPACITY")
                .when(F.col("utilization") > F.col("move_threshold"), "MOVE")
                .otherwise("LOW_UTILIZATION"))
    return j.withColumns({"decision": decision, "in_state": F.col("initial_dataset_id").isNotNull(),
                          "valid": valid}).drop(*DECIDED_BY)


# Which of several policies acts on a report they all watch: smaller goes first.
ACTS = {"RECOVER": 0, "MOVE": 1}


def contested(tick: DataFrame) -> DataFrame:
    """(report_id, acting_policy_id) of the reports that several policies would act on in this tick."""
    rank = F.coalesce(*[F.when(F.col("decision") == d, F.lit(r)) for d, r in ACTS.items()])
    acts = tick.where(F.col("decision").isin(*ACTS)).groupBy("report_id").agg(
        F.min(F.struct(rank.alias("rank"), "policy_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    return acts.where("n > 1").select("report_id", F.col("first.policy_id").alias("acting_policy_id"))


def one_action_per_report(tick: DataFrame, contested: DataFrame) -> DataFrame:
    """The tick with the actions that lost to another policy's turned to SUPERSEDED."""
    lost = F.col("decision").isin(*ACTS) & (F.col("acting_policy_id") != F.col("policy_id"))
    return join_small(tick, contested, "report_id").withColumn(
        "decision", F.when(lost, F.lit("SUPERSEDED")).otherwise(F.col("decision"))).drop("acting_policy_id")


def tick_checks(tick: DataFrame) -> list[F.Column]:
    """L1 and key checks as metrics of the pass that writes the tick."""
    return [F.count_if(F.col("n_state") > 1).alias("reports_with_several_state_rows"),
            F.count_if(F.col("n_report") > 1).alias("reports_listed_more_than_once"),
            F.count_if(F.col("move_threshold").isNull()).alias("reports_of_unknown_policies"),
            F.count_if(F.col("decision").isNull()).alias("reports_without_decision")]


def repoint_lookup(tick: DataFrame) -> DataFrame:
    """A watched report's state row, if any (state is unique by report_id)."""
    return tick.where("valid").select("policy_id", "report_id", "in_state", "initial_dataset_id",
                                      "target_dataset_id", "state_target_workspace_id")


def recoveries(tick: DataFrame) -> DataFrame:
    """Moved reports whose home capacity is back below the recovery threshold."""
    return tick.where(F.col("decision") == "RECOVER").select(*RECOVERY_COLUMNS)


def remaining_reports(tick: DataFrame) -> DataFrame:
    """Watched (valid policies) minus recovered."""
    return tick.where(F.col("valid") & (F.col("decision") != "RECOVER"))


def target_gate(ctx: DataFrame, remaining: DataFrame) -> DataFrame:
    """Per policy, the target's peak against headroom x T, and whether it alerts."""
    n = remaining.groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("n_remaining"),
        F.count_if(F.col("utilization") > F.col("move_threshold")).alias("_n_source_over"))
    g = ctx.where("valid").join(n, "policy_id", "left").fillna(0, ["n_remaining", "_n_source_over"])
    source_ok = ~F.col("alert_requires_source_over") | (F.col("_n_source_over") > 0)
    return g.select("policy_id", "target_workspace_id", "target_capacity_id", "target_peak", "gate_threshold",
                    "overloaded", "n_remaining",
                    (F.col("overloaded") & (F.col("n_remaining") > 0) & source_ok).alias("raise_alert"))


def move_decisions(tick: DataFrame) -> DataFrame:
    """Decision for every remaining report, with its lineage."""
    return remaining_reports(tick).select(*MOVE_COLUMNS)


def all_decisions(tick: DataFrame) -> DataFrame:
    """One row per watched report and policy; a recovery is reported on its home capacity."""
    rec = F.col("decision") == "RECOVER"
    inv = F.col("decision") == "INVALID_POLICY"

    def pick(recovering: str, otherwise: str) -> F.Column:
        return F.when(rec, F.col(recovering)).otherwise(F.col(otherwise))

    return tick.select(
        "policy_id", "report_id", "decision",
        F.when(~inv, F.col("report_workspace_id")).alias("report_workspace_id"),
        F.when(~inv, pick("initial_capacity_id", "capacity_id")).alias("capacity_id"),
        F.when(~inv, pick("initial_peak", "utilization")).alias("utilization"),
        pick("initial_workspace_id", "target_workspace_id").alias("target_workspace_id"),
        pick("initial_capacity_id", "target_capacity_id").alias("target_capacity_id"))
