"""Declared schemas of the model tables.

Ids are strings everywhere; the event payload is JSON text parsed with an
explicit schema (no inference on the hot path).
"""

from pyspark.sql import types as T

# Envelope of the append-only capacity event log.
CAPACITY_EVENTS = T.StructType([
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("data", T.StringType()),
])

# Payload fields of ``data``. Numbers are parsed as doubles; anything that is
# not a number reads as null.
EVENT_PAYLOAD = T.StructType([
    T.StructField("capacityId", T.StringType()),
    T.StructField("capacityUnitMs", T.DoubleType()),
    T.StructField("baseCapacityUnits", T.DoubleType()),
    T.StructField("utilizationInteractive", T.DoubleType()),
    T.StructField("utilizationBackground", T.DoubleType()),
])

POLICIES = T.StructType([
    T.StructField("policy_id", T.StringType()),
    T.StructField("workspace_name", T.StringType()),
    T.StructField("capacity_to_deploy", T.StringType()),
    T.StructField("target_workspace", T.StringType()),
    T.StructField("move_threshold", T.DoubleType()),
    T.StructField("recovery_threshold", T.DoubleType()),
    T.StructField("headroom", T.DoubleType()),
])

# A policy's watched reports in the comma-separated form; a policy may span
# several rows so that no single row has to hold a huge list.
WATCH_LISTS = T.StructType([
    T.StructField("policy_id", T.StringType()),
    T.StructField("report_ids", T.StringType()),
])

WATCHED = T.StructType([
    T.StructField("policy_id", T.StringType()),
    T.StructField("report_id", T.StringType()),
])

# The pair form: the report's workspace is given with it (may be null).
WATCHED_PAIRS = T.StructType(WATCHED.fields + [T.StructField("workspace_id", T.StringType())])

WORKSPACES = T.StructType([
    T.StructField("workspace_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("capacity_id", T.StringType()),
])

DATASETS = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("workspace_id", T.StringType()),
])

REPORTS = T.StructType([
    T.StructField("report_id", T.StringType()),
    T.StructField("workspace_id", T.StringType()),
    T.StructField("dataset_id", T.StringType()),
])

DATASOURCES = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("datasource_id", T.StringType()),
])

CONNECTIONS = T.StructType([
    T.StructField("datasource_id", T.StringType()),
    T.StructField("connectivity_type", T.StringType()),
    T.StructField("gateway_id", T.StringType()),
    T.StructField("connection_details", T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("type", T.StringType()),
    ])),
])

REFRESH_SCHEDULES = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("days", T.ArrayType(T.StringType())),
    T.StructField("times", T.ArrayType(T.StringType())),
    T.StructField("local_time_zone_id", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
])

# Repoint state, unique by report_id.
REPORT_REPOINTS = T.StructType([
    T.StructField("initial_dataset_id", T.StringType()),
    T.StructField("report_workspace_id", T.StringType()),
    T.StructField("report_id", T.StringType()),
    T.StructField("target_dataset_id", T.StringType()),
    T.StructField("target_workspace_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

DECISION_LOG = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("policy_id", T.StringType()),
    T.StructField("report_id", T.StringType()),
    T.StructField("capacity_id", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("message", T.StringType()),
])

ALERTS = T.StructType([
    T.StructField("alert", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("operation", T.DoubleType()),
])


def ddl(schema: T.StructType) -> str:
    """Column list for ``CREATE TABLE`` from a StructType."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
