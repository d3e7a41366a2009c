"""Decision log (D-L, K4) and alerts (K5): typed rows built from the run's tables.

One row per decision; all kinds are unioned and written in one append per run
(the reference writes one tiny job per message). Numbers stay in the typed
``value`` column instead of being formatted into the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.functions.timecols import ts_literal
from capshift.params import RunParams

LOG_COLUMNS = ["timestamp", "run_id", "kind", "policy_id", "report_id", "capacity_id", "value", "message"]


def _txt(c: str) -> F.Column:
    return F.coalesce(F.col(c), F.lit("unknown"))


def _rows(df: DataFrame, params: RunParams, kind: str, message: F.Column, policy="policy_id",
          report="report_id", capacity="capacity_id", value="value") -> DataFrame:
    def col_or_null(c, t):
        return F.col(c).cast(t) if c else F.lit(None).cast(t)

    kind_col = F.col("kind") if kind is None else F.lit(kind)
    return df.select(
        ts_literal(params.as_of).alias("timestamp"), F.lit(params.run_id).alias("run_id"), kind_col.alias("kind"),
        col_or_null(policy, "string").alias("policy_id"), col_or_null(report, "string").alias("report_id"),
        col_or_null(capacity, "string").alias("capacity_id"), col_or_null(value, "double").alias("value"),
        message.alias("message"))


# Per-report log kinds and their text, in the order they are logged.
REPORT_KINDS = {
    "SAME_CAPACITY": " already runs on the target capacity",
    "LOW_UTILIZATION": " stays: its capacity is not above the move threshold",
    "UNRESOLVED": " could not be traced to a capacity",
    "INVALID_POLICY": " skipped: its policy is invalid",
    "SUPERSEDED": " is left to another policy in this run",
}


def _report_entries(tick: DataFrame) -> F.Column:
    """The log entries of one watched report, as an array of (kind, capacity, value, message); null where one does not apply."""
    d = F.col("decision")
    rec = d == "RECOVER"
    inv = d == "INVALID_POLICY"
    rid = _txt("report_id")

    def entry(cond, kind, capacity, value, message):
        return F.when(cond, F.struct(
            (kind if isinstance(kind, F.Column) else F.lit(kind)).alias("kind"),
            capacity.cast("string").alias("capacity_id"), value.cast("double").alias("value"),
            message.alias("message")))

    null_s, null_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    cap = F.when(~inv, F.when(rec, F.col("initial_capacity_id")).otherwise(F.col("capacity_id")))
    util = F.when(~inv, F.when(rec, F.col("initial_peak")).otherwise(F.col("utilization")))
    home_ws = F.when(rec, F.col("initial_workspace_id")).otherwise(F.col("target_workspace_id"))
    text = F.coalesce(*[F.when(d == k, F.lit(t)) for k, t in REPORT_KINDS.items()])
    entries = [
        entry(F.lit(True), "CHECKING", null_s, null_d,
              F.concat(F.lit("report "), rid, F.lit(" is under review, its workspace is "),
                       F.coalesce(F.when(~inv, F.col("report_workspace_id")), F.lit("unknown")))),
        entry(F.col("valid") & ~F.col("in_state"), "NOT_IN_CACHE", null_s, null_d,
              F.concat(F.lit("report "), rid, F.lit(" has no repoint to undo"))),
        entry(rec, "REPOINT_BACK", cap, util,
              F.concat(F.lit("report "), rid, F.lit(" goes back home to workspace "),
                       F.coalesce(home_ws, F.lit("unknown")))),
        entry(d.isin(*REPORT_KINDS), d, cap, util, F.concat(F.lit("report "), rid, text)),
    ]
    return F.array(*entries)


def decision_log(params: RunParams, peaks: DataFrame, tick: DataFrame, gate: DataFrame, actions: DataFrame,
                 new_workspaces: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """D-L: capacity readings, one pass over the tick for per-report entries, gates, rebinds, new workspaces, connections."""
    # (nulls are dropped after the explode: filtering inside the array is not compiled, and costs more than the rest)
    per_report = tick.select("policy_id", "report_id", F.explode(_report_entries(tick)).alias("e")).where("e is not null")
    per_report = _rows(per_report.select("policy_id", "report_id", "e.*"), params, None, F.col("message"))
    parts = [
        _rows(peaks, params, "CONSUMPTION",
              F.concat(F.lit("peak utilisation measured for capacity "), _txt("capacity_id")),
              policy=None, report=None, value="peak_utilization"),
        per_report,
        _rows(gate.where("raise_alert"), params, "TARGET_OVERLOADED",
              F.concat(F.lit("no move: target workspace "), _txt("target_workspace_id"), F.lit(" on capacity "),
                       _txt("target_capacity_id"), F.lit(" is above headroom")),
              report=None, capacity="target_capacity_id", value="target_peak"),
        _rows(actions, params, "REPOINTED",
              F.concat(F.lit("report "), _txt("report_id"), F.lit(" rebinds to dataset "),
                       F.coalesce(F.col("target_dataset_id"), F.lit("(new copy)")),
                       F.lit(" in workspace "), _txt("target_workspace_id")),
              capacity=None, value="utilization"),
        _rows(new_workspaces, params, "DEPLOYING_WORKSPACE",
              F.concat(F.lit("workspace "), _txt("workspace_name"), F.lit(" is to be created on capacity "),
                       _txt("target_capacity_id")),
              report=None, capacity="target_capacity_id", value=None),
    ]
    if bindings is not None:
        parts.append(_rows(
            bindings, params, "CONNECTION",
            F.concat(F.lit("dataset "), F.coalesce(F.col("target_dataset_id"), F.lit("(new copy)")),
                     F.lit(" binds datasource "), _txt("datasource_id"), F.lit(" at "), _txt("path")),
            report=None, capacity=None, value=None))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alerts(params: RunParams, gate: DataFrame) -> DataFrame:
    """K5: one alert per policy whose target is overloaded while reports remain."""
    return gate.where("raise_alert").select(
        F.concat(F.lit("Target workspace "), _txt("target_workspace_id"), F.lit(" is on overloaded capacity "),
                 _txt("target_capacity_id"), F.lit(" - consider another target")).alias("alert"),
        ts_literal(params.as_of).alias("timestamp"), F.col("target_peak").alias("operation"), "policy_id")
