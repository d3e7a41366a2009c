"""The requests of a run as one ordered plan: create, assign, copy, bind, schedule, rebind (D-T, D-C, D-A).

Each row is one request with its JSON body. An id that another request of the plan will
only bring about is written as a reference, ``${workspace:<name>}`` or
``${dataset:<workspace>/<name>}``; such a row is PENDING until whoever carries the plan
out knows the id, all others are READY. ``makes`` names what a request brings about and
``waits_for`` what it needs first, so steps of different reports may run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capshift.operators.policy import with_checks, with_target

# Steps of the plan in order.
STEPS = ("CREATE_WORKSPACE", "ASSIGN_CAPACITY", "COPY_DATASET", "BIND_CONNECTION", "SET_SCHEDULE", "REBIND_REPORT")
PLAN_COLUMNS = ["policy_id", "step", "request", "report_id", "source_dataset_id", "makes", "waits_for", "status", "payload"]


def workspace_key(name: Column) -> Column:
    return F.concat(F.lit("workspace:"), name)


def reference(key: Column) -> Column:
    return F.concat(F.lit("${"), key, F.lit("}"))


def workspace_or_reference(workspace_id: Column, name: Column) -> Column:
    return F.coalesce(workspace_id, reference(workspace_key(name)))


def dataset_key(workspace: Column, name: Column) -> Column:
    """A copy by where it goes and its name; the workspace may itself be a reference."""
    return F.concat(F.lit("dataset:"), workspace, F.lit("/"), name)


def _rows(df: DataFrame, request: str, payload: Column, makes: Column | None = None, waits_for: Column | None = None,
          ready: Column | None = None, report: str | None = None, source: str | None = None) -> DataFrame:
    text = F.lit(None).cast("string")
    return df.select(
        "policy_id", F.lit(STEPS.index(request) + 1).alias("step"), F.lit(request).alias("request"),
        (F.col(report) if report else text).alias("report_id"),
        (F.col(source) if source else text).alias("source_dataset_id"),
        (makes if makes is not None else text).alias("makes"),
        (waits_for if waits_for is not None else text).alias("waits_for"),
        F.when(ready if ready is not None else F.lit(True), F.lit("READY")).otherwise(F.lit("PENDING")).alias("status"),
        F.to_json(payload).alias("payload"))


def new_workspaces(policies: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(policy_id, workspace_name, target_capacity_id) of the workspaces to create, each once.

    Where several policies name the same new workspace, the smallest policy id asks for it.
    """
    create = with_target(with_checks(policies), workspaces).where("is_valid and resolution = 'CREATE'")
    first = create.groupBy("workspace_name").agg(F.min(F.struct("policy_id", "target_capacity_id")).alias("first"))
    return first.select("first.policy_id", "workspace_name", "first.target_capacity_id")


def workspace_plan(created: DataFrame) -> DataFrame:
    """Two requests for each workspace to create: the workspace, then its capacity."""
    key = workspace_key(F.col("workspace_name"))
    create = _rows(created, "CREATE_WORKSPACE", F.struct(F.col("workspace_name").alias("name")), makes=key)
    assignment = F.struct(F.col("target_capacity_id").alias("targetCapacityObjectId"),
                          F.array(reference(key)).alias("workspacesToAssign"))
    assign = _rows(created, "ASSIGN_CAPACITY", F.struct(F.array(assignment).alias("capacityMigrationAssignments")),
                   waits_for=key, ready=F.lit(False))
    return create.unionByName(assign)


def _copy_of(df: DataFrame) -> tuple[Column, Column, Column]:
    """(workspace or reference, key of the copy, dataset id or reference) of rows with the columns of a copy."""
    workspace = workspace_or_reference(F.col("target_workspace_id"), F.col("workspace_name"))
    key = dataset_key(workspace, F.col("target_dataset_name"))
    return workspace, key, F.coalesce("target_dataset_id", reference(key))


def copy_requests(moved: DataFrame) -> DataFrame:
    workspace, key, _ = _copy_of(moved)
    body = F.struct(F.col("source_workspace_id").alias("sourceWorkspaceId"), F.col("source_dataset_id").alias("sourceDatasetId"),
                    workspace.alias("targetWorkspaceId"), F.col("target_dataset_name").alias("targetName"))
    there = F.col("target_workspace_id").isNotNull()
    return _rows(moved, "COPY_DATASET", body, makes=key, source="source_dataset_id", ready=there,
                 waits_for=F.when(~there, workspace_key(F.col("workspace_name"))))


def after_copy(plan: DataFrame, request: str) -> DataFrame:
    """Requests on the copies (their body is the ``payload`` of the plan, the copy named beside it)."""
    workspace, key, dataset = _copy_of(plan)
    body = F.struct(workspace.alias("workspaceId"), dataset.alias("datasetId"), F.col("payload").alias("body"))
    return _rows(plan, request, body, waits_for=key, ready=F.col("target_dataset_id").isNotNull(), source="source_dataset_id")


def rebind_requests(actions: DataFrame) -> DataFrame:
    _, key, dataset = _copy_of(actions)
    body = F.struct(F.col("report_workspace_id").alias("workspaceId"), F.col("report_id").alias("reportId"),
                    F.when(F.col("action") == "MOVE", dataset).otherwise(F.col("target_dataset_id")).alias("datasetId"))
    return _rows(actions, "REBIND_REPORT", body, report="report_id", source="source_dataset_id",
                 waits_for=F.when(F.col("action") == "MOVE", key), ready=F.col("target_dataset_id").isNotNull())
