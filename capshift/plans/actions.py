"""Plans the reference computes right before calling a service, as tables.

Nothing here calls a service: each row is one request to make, with its JSON
body built by ``to_json`` (null fields, such as a missing gateway, are left
out of the JSON, as the reference adds them only when present).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.plans.workplan import dataset_key, reference, workspace_or_reference

ACTION_COLUMNS = ["policy_id", "action", "report_id", "report_workspace_id", "source_dataset_id",
                  "target_dataset_name", "target_dataset_id", "target_workspace_id", "utilization"]


def action_table(recovered: DataFrame, copies: DataFrame) -> DataFrame:
    """U1/D-A: report rebinds. Recover -> back to the initial dataset; move -> to the copy.

    ``copies`` carries the moved reports' workspace and utilization, so no join is needed.
    """
    names = "workspace_name" in copies.columns
    back = recovered.select(
        "policy_id", F.lit("RECOVER").alias("action"), "report_id", "report_workspace_id",
        F.col("target_dataset_id").alias("source_dataset_id"),
        F.lit(None).cast("string").alias("target_dataset_name"),
        F.col("initial_dataset_id").alias("target_dataset_id"),
        F.col("initial_workspace_id").alias("target_workspace_id"),
        F.col("initial_peak").alias("utilization"), *([F.lit(None).cast("string").alias("workspace_name")] if names else []))
    fwd = copies.select(
        "policy_id", F.lit("MOVE").alias("action"), "report_id", "report_workspace_id", "source_dataset_id",
        "target_dataset_name", F.col("existing_copy_id").alias("target_dataset_id"), "target_workspace_id",
        "utilization", *(["workspace_name"] if names else []))
    return back.unionByName(fwd)


def with_rebind_payload(actions: DataFrame) -> DataFrame:
    """JSON body of the rebind request, and whether its dataset is known yet.

    A move whose copy does not exist yet is PENDING, and its body refers to the copy.
    """
    dataset = F.col("target_dataset_id")
    if "target_dataset_name" in actions.columns:  # else a copy to come has no name to refer to
        workspace = F.col("target_workspace_id")
        if "workspace_name" in actions.columns:
            workspace = workspace_or_reference(workspace, F.col("workspace_name"))
        dataset = F.coalesce(dataset, reference(dataset_key(workspace, F.col("target_dataset_name"))))
    return actions.withColumns({
        "status": F.when(F.col("target_dataset_id").isNotNull(), F.lit("READY")).otherwise(F.lit("PENDING")),
        "payload": F.to_json(F.struct(dataset.alias("datasetId")))}).drop("workspace_name")


def moved_datasets(copies: DataFrame) -> DataFrame:
    """Distinct source datasets being copied, with where the copy goes."""
    return copies.select("policy_id", "source_dataset_id", "source_workspace_id", "target_dataset_name",
                         "target_workspace_id", F.col("existing_copy_id").alias("target_dataset_id"),
                         *(["workspace_name"] if "workspace_name" in copies.columns else [])).distinct()


def connection_bindings(moved: DataFrame, datasources: DataFrame, connections: DataFrame) -> DataFrame:
    """J11/D-B/F12: one bind request per datasource of each copied dataset."""
    ds = datasources.withColumnRenamed("dataset_id", "source_dataset_id")
    j = moved.join(ds, "source_dataset_id", "inner").join(connections, "datasource_id", "left")
    binding = F.struct(
        F.col("datasource_id").alias("id"), F.col("connectivity_type").alias("connectivityType"),
        F.struct(F.col("connection_details.path").alias("path"),
                 F.col("connection_details.type").alias("type")).alias("connectionDetails"),
        F.col("gateway_id").alias("gatewayId"))
    return j.select(
        "policy_id", "source_dataset_id", "target_workspace_id", "target_dataset_name", "target_dataset_id",
        "datasource_id", "connectivity_type", "gateway_id",
        F.col("connection_details.path").alias("path"), F.col("connection_details.type").alias("type"),
        *(["workspace_name"] if "workspace_name" in moved.columns else []),
        F.to_json(F.struct(binding.alias("connectionBinding"))).alias("payload"))


def refresh_plan(moved: DataFrame, schedules: DataFrame) -> DataFrame:
    """J12/D-R/F14: copy the source schedule to the copy, always enabled."""
    s = schedules.withColumnRenamed("dataset_id", "source_dataset_id")
    j = moved.join(s, "source_dataset_id", "inner")
    body = F.struct(F.lit(True).alias("enabled"), F.col("days"), F.col("times"),
                    F.col("local_time_zone_id").alias("localTimeZoneId"))
    return j.select(
        "policy_id", "source_dataset_id", "target_workspace_id", "target_dataset_name", "target_dataset_id",
        "days", "times", "local_time_zone_id", F.lit(True).alias("enabled"),
        *(["workspace_name"] if "workspace_name" in moved.columns else []),
        F.to_json(F.struct(body.alias("value"))).alias("payload"))
