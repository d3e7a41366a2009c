"""Repoint state: lookup, delete of recovered reports, upsert of moves (K2, K3, A2).

Parquet has no MERGE, so a run computes the whole next snapshot with joins and
writes it under a new run folder; the folder being read is never overwritten.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capshift.functions.timecols import ts_literal

STATE_COLUMNS = ["initial_dataset_id", "report_workspace_id", "report_id", "target_dataset_id",
                 "target_workspace_id", "created_at"]


def repointed_ids(state: DataFrame) -> DataFrame:
    """A2: distinct report ids held in the state."""
    return state.select("report_id").distinct()


def repoint_delete(state: DataFrame, recovered: DataFrame) -> DataFrame:
    """K3: state without the recovered reports."""
    return state.join(recovered.select("report_id").distinct(), "report_id", "left_anti").select(*STATE_COLUMNS)


def repoint_upsert(state: DataFrame, recovered: DataFrame, moved: DataFrame, as_of: dt.datetime) -> DataFrame:
    """K2 (+K3): next snapshot = upsert(state minus recovered, moves) by report_id.

    ``moved`` has the state columns of the new repoints. On a match the original
    ``initial_dataset_id`` is kept and the other columns are overwritten; new
    reports are inserted. A report moved by two policies in one run keeps the
    row of the smallest policy id, so the key stays unique.
    """
    one = Window.partitionBy("report_id").orderBy("policy_id")
    new = (moved.withColumn("_rank", F.row_number().over(one)).where("_rank = 1")
           .select(*[F.col(c).alias(f"n_{c}") for c in STATE_COLUMNS if c != "created_at"]))
    old = repoint_delete(state, recovered)
    j = old.join(new, old["report_id"] == new["n_report_id"], "full_outer")
    hit = F.col("n_report_id").isNotNull()

    def pick(c: str) -> F.Column:
        return F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)

    return j.select(
        F.coalesce(F.col("initial_dataset_id"), F.col("n_initial_dataset_id")).alias("initial_dataset_id"),
        pick("report_workspace_id"),
        F.coalesce(F.col("report_id"), F.col("n_report_id")).alias("report_id"),
        pick("target_dataset_id"), pick("target_workspace_id"),
        F.when(hit, ts_literal(as_of)).otherwise(F.col("created_at")).alias("created_at"))
