"""Catalog tables and sinks: DDL (K1), state snapshots (S5), appends (K4, K5), CSV alerts (K6).

Parquet tables cannot MERGE, so the repoint state is kept as one snapshot per
run (``run_id=<id>``); the current state is the newest snapshot. Logs and
alerts are append-only. Every writer targets a folder owned by its run, so a
retried run rewrites the same files instead of appending twice.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capshift import schemas

TABLES = {
    "report_repoints": schemas.REPORT_REPOINTS,
    "decision_log": schemas.DECISION_LOG,
    "alerts": schemas.ALERTS,
}


# The state is joined on report_id by every run: bucketing it by that key lets
# those joins read it without a shuffle (only the other side is exchanged).
BUCKETED = {"report_repoints": "report_id"}


def ensure_tables(spark: SparkSession, database: str | None = None, location: str | None = None,
                  state_buckets: int = 64) -> list[str]:
    """K1: ``CREATE TABLE IF NOT EXISTS`` for state, log and alerts with fixed schemas.

    The tables are partitioned by ``run_id`` so that each run writes (or
    rewrites) only its own partition; the state is also bucketed by report_id.
    """
    names = []
    for name, schema in TABLES.items():
        full = f"{database}.{name}" if database else name
        loc = f" LOCATION '{location.rstrip('/')}/{name}'" if location else ""
        cols = T.StructType([f for f in schema.fields if f.name != "run_id"])
        bucket = (f" CLUSTERED BY ({BUCKETED[name]}) SORTED BY ({BUCKETED[name]}) INTO {state_buckets} BUCKETS"
                  if name in BUCKETED else "")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({schemas.ddl(cols)}, run_id STRING) "
                  f"USING parquet PARTITIONED BY (run_id){bucket}{loc}")
        names.append(full)
    return names


def _partition(run_id: str) -> str:
    return "PARTITION (run_id='" + run_id.replace("\\", "\\\\").replace("'", "\\'") + "')"


def write_run_partition(df: DataFrame, table: str, run_id: str) -> None:
    """K4/K5: append one run's rows; re-running the same run replaces its partition only.

    The partition is dropped first and exists afterwards even without rows, so
    a rerun leaves nothing stale and an empty result is the newest snapshot.
    """
    spark = df.sparkSession
    cols = [f.name for f in spark.table(table).schema.fields if f.name != "run_id"]
    out = df.select(*[F.col(c) for c in cols], F.lit(run_id).alias("run_id"))
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {_partition(run_id)}")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(table)
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {_partition(run_id)}")


def latest_snapshot(spark: SparkSession, table: str) -> DataFrame:
    """The newest ``run_id`` partition of a snapshot table (run ids sort by time).

    The newest id comes from the partition listing, so only its files are read.
    """
    ids = spark.sql(f"SHOW PARTITIONS {table}").select(F.expr("substring(partition, length('run_id=') + 1)").alias("id"))
    newest = ids.agg(F.max("id").alias("id")).first()["id"]
    rows = spark.table(table)
    return (rows.where(F.lit(False)) if newest is None else rows.where(F.col("run_id") == unquote(newest))).drop("run_id")


def write_alerts_csv(alerts: DataFrame, path: str) -> None:
    """K6: alerts as CSV with a header line (read back with ``header=True``)."""
    alerts.select("alert", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                  "operation").write.mode("overwrite").option("header", True).csv(path)


def read_alerts_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("alert", T.StringType()), T.StructField("timestamp", T.StringType()),
                           T.StructField("operation", T.DoubleType())])
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn("timestamp", F.to_timestamp_ntz("timestamp"))
