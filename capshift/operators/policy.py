"""Policy validation (P12) and target resolution (D-T), for all policies at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.functions.ids import py_strip
from capshift.operators.lineage import workspace_by_name

# Rule codes in the order they are checked.
RULES = (
    "CAPACITY_AND_TARGET",     # capacity to deploy and target workspace both set
    "NAME_AND_TARGET",         # workspace name and target workspace both set
    "CAPACITY_WITHOUT_NAME",   # capacity to deploy set, workspace name empty
    "NO_NAME_NO_TARGET",       # neither workspace name nor target workspace set
    "RECOVERY_NOT_BELOW_MOVE", # recovery threshold must be below the move threshold
)


def _set(c: str) -> F.Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def with_checks(policies: DataFrame) -> DataFrame:
    """P12, D10, D16 as columns on the policies: ``errors`` (rule order) and ``is_valid``."""
    cond = {
        "CAPACITY_AND_TARGET": _set("capacity_to_deploy") & _set("target_workspace"),
        "NAME_AND_TARGET": _set("workspace_name") & _set("target_workspace"),
        "CAPACITY_WITHOUT_NAME": _set("capacity_to_deploy") & ~_set("workspace_name"),
        "NO_NAME_NO_TARGET": ~_set("workspace_name") & ~_set("target_workspace"),
        "RECOVERY_NOT_BELOW_MOVE": ~F.coalesce(F.col("recovery_threshold") < F.col("move_threshold"),
                                               F.lit(False)),
    }
    errors = F.filter(F.array(*[F.when(cond[r], F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return policies.withColumn("error_list", errors).withColumns({
        "n_errors": F.size("error_list"), "errors": F.array_join("error_list", ","),
        "is_valid": F.size("error_list") == 0}).drop("error_list")


def policy_check(policies: DataFrame) -> DataFrame:
    """Every rule a policy breaks, in rule order; none -> valid."""
    return with_checks(policies).select("policy_id", "n_errors", "errors", "is_valid")


def with_target(policies: DataFrame, workspaces: DataFrame) -> DataFrame:
    """D-T as columns on the policies: ``target_workspace_id``, ``target_capacity_id``, ``resolution``.

    Explicit workspace -> its capacity; else an existing workspace of the given
    name; else a workspace to create on ``capacity_to_deploy``. A target whose
    capacity cannot be found leaves ``target_capacity_id`` null (UNRESOLVED).
    Two lookups (by name, then the target's capacity), no join back on policy_id.
    """
    p = workspace_by_name(policies, workspaces)
    caps = workspaces.select(F.col("workspace_id").alias("_ws"), py_strip(F.col("capacity_id")).alias("_cap"))
    explicit = _set("target_workspace")
    by_name = ~explicit & F.col("found_workspace_id").isNotNull()
    create = ~explicit & ~by_name & _set("workspace_name") & _set("capacity_to_deploy")
    ws = (F.when(explicit, py_strip(F.col("target_workspace")))
          .when(by_name, F.col("found_workspace_id")))
    p = p.withColumns({"target_workspace_id": ws,
                       "resolution": F.when(explicit, "EXPLICIT").when(by_name, "BY_NAME")
                       .when(create, "CREATE").otherwise("UNRESOLVED")})
    p = p.join(caps, p["target_workspace_id"] == caps["_ws"], "left")
    cap = F.when(F.col("resolution") == "CREATE", py_strip(F.col("capacity_to_deploy"))).otherwise(F.col("_cap"))
    res = F.when(cap.isNull(), F.lit("UNRESOLVED")).otherwise(F.col("resolution"))
    return p.withColumns({"target_capacity_id": cap, "resolution": res}).drop("_ws", "_cap", "found_workspace_id")


def resolve_target(policies: DataFrame, workspaces: DataFrame) -> DataFrame:
    """D-T: target workspace and capacity per policy."""
    return with_target(policies, workspaces).select("policy_id", "target_workspace_id", "target_capacity_id",
                                                    "resolution")
