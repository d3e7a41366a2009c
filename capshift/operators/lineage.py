"""Watched lists and the report -> dataset -> workspace -> capacity chain.

The reference walks this chain one service lookup at a time per report; here
it is a fixed chain of left equi-joins over inventory snapshots, so a missing
link leaves nulls (the report is kept, never dropped). Large sides
(reports, datasets) shuffle-join on their key; small ones (workspaces,
peaks, policies) are turned into broadcasts by the planner when their size,
measured at run time, allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.functions.ids import py_strip, split_ids
from capshift.params import COPY_SUFFIX


def id_tokens(watch_lists: DataFrame) -> DataFrame:
    """Every token of every list, raw and stripped (duplicates kept)."""
    raw = watch_lists.select("policy_id", F.explode(split_ids(F.col("report_ids"))).alias("raw_id"))
    return raw.select("policy_id", "raw_id", py_strip(F.col("raw_id")).alias("report_id"))


def watched_reports(watch_lists: DataFrame) -> DataFrame:
    """S3 + D15: one row per (policy, report); empty tokens are not ids."""
    return (id_tokens(watch_lists).where(F.col("report_id") != "")
            .select("policy_id", "report_id").distinct())


def first_match(df: DataFrame, keys: list[str], pick: str, alias: str) -> DataFrame:
    """A3: one row per key; the reference takes the first listed, we the smallest id.

    ``min`` aggregates map-side, so a key shared by many rows stays cheap.
    """
    return df.groupBy(*keys).agg(F.min(pick).alias(alias))


def _one_row(df: DataFrame, key: str, others: list[str]) -> DataFrame:
    """A3 on an inventory: ids without surrounding white space, one row per id, the smallest listing.

    Grouped by the key that the joins use, so the grouping's exchange is theirs
    as well; the minimum is taken before the shuffle. ``n_listed`` counts the listings.
    """
    ids = [key, *[c for c in others if c.endswith("_id")]]
    clean = df.select(key, *others).withColumns({c: py_strip(F.col(c)) for c in ids})
    return clean.groupBy(key).agg(F.min(F.struct(*others)).alias("_first"), F.count(F.lit(1)).alias("n_listed")).select(
        key, *[F.col("_first")[c].alias(c) for c in others], "n_listed")


def one_report(reports: DataFrame) -> DataFrame:
    return _one_row(reports, "report_id", ["workspace_id", "dataset_id"])


def report_in_workspace(reports: DataFrame) -> DataFrame:
    """One row per (report, workspace), for lists that name a report's workspace."""
    clean = reports.select(*[py_strip(F.col(c)).alias(c) for c in ("report_id", "workspace_id", "dataset_id")])
    return first_match(clean, ["report_id", "workspace_id"], "dataset_id", "dataset_id")


def one_dataset(datasets: DataFrame) -> DataFrame:
    return _one_row(datasets, "dataset_id", ["workspace_id", "name"])


def one_workspace(workspaces: DataFrame) -> DataFrame:
    return _one_row(workspaces, "workspace_id", ["capacity_id"])


def report_lineage(watched: DataFrame, reports: DataFrame, datasets: DataFrame,
                   workspaces: DataFrame) -> DataFrame:
    """Each watched report with its workspace, dataset, dataset workspace, capacity."""
    r = one_report(reports).drop("n_listed").withColumnRenamed("workspace_id", "report_workspace_id")
    d = one_dataset(datasets).select("dataset_id", F.col("name").alias("dataset_name"),
                                     F.col("workspace_id").alias("dataset_workspace_id"))
    w = one_workspace(workspaces).drop("n_listed").withColumnRenamed("workspace_id", "dataset_workspace_id")
    lineage = ["report_workspace_id", "dataset_id", "dataset_name", "dataset_workspace_id", "capacity_id"]
    return (watched.join(r, "report_id", "left")
            .join(d, "dataset_id", "left")
            .join(w, "dataset_workspace_id", "left")
            .select(*watched.columns, *lineage))


def workspace_by_name(names: DataFrame, workspaces: DataFrame, name_col: str = "workspace_name") -> DataFrame:
    """Workspace id for a name, first match (smallest id), null when absent.

    Workspaces are first reduced to the names asked for (a semi join with a
    side that is small in practice), so the first-match aggregate never runs
    over the whole inventory.
    """
    wanted = names.select(F.col(name_col).alias("name")).where(F.col("name") != "").distinct()
    cand = workspaces.join(wanted, "name", "left_semi")
    by_name = first_match(cand, ["name"], "workspace_id", "found_workspace_id")
    return names.join(by_name, names[name_col] == by_name["name"], "left").drop("name")


def copy_lookup(moves: DataFrame, datasets: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """J10/F8/D-C: copy plan per moved report.

    The copy is named ``<dataset name>_LB`` in the target workspace. An existing
    dataset of that name there (first match) is overwritten by the copy, so its
    id is the copy's id; otherwise the id is null until the copy exists.
    Datasets are first reduced to the (workspace, name) pairs the moves need.
    ``carry`` names columns of ``moves`` to keep.
    """
    plan = moves.select(
        "policy_id", "report_id", F.col("dataset_id").alias("source_dataset_id"),
        F.col("dataset_workspace_id").alias("source_workspace_id"),
        F.concat(F.col("dataset_name"), F.lit(COPY_SUFFIX)).alias("target_dataset_name"),
        "target_workspace_id", *carry)
    wanted = plan.select("target_workspace_id", "target_dataset_name").distinct()
    cand = datasets.join(wanted, (datasets["workspace_id"] == wanted["target_workspace_id"])
                         & (datasets["name"] == wanted["target_dataset_name"]), "inner")
    found = first_match(cand, ["target_workspace_id", "target_dataset_name"], "dataset_id", "existing_copy_id")
    return plan.join(found, ["target_workspace_id", "target_dataset_name"], "left").select(
        "policy_id", "report_id", "source_dataset_id", "source_workspace_id", "target_dataset_name",
        "target_workspace_id", "existing_copy_id", *carry)
