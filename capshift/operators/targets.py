"""Automatic choice of targets: candidates below headroom, filled one after the other (§2.13).

A report that should move brings the share that one report has in its capacity's peak.
Reports are lined up by that load, candidates by their peak and by the room they have
below headroom x T; a report goes to the candidate whose room its place in the line falls
into, so successive moves do not all fill the same target. Loads and rooms are whole
millionths, so places add up exactly.

All reports of a capacity bring the same load, so the line needs only a place inside a
capacity and a running sum over capacities. Places are counted in 256 parts by a digest
of the report id and moved on by what earlier parts hold: a capacity that is home to most
reports is not counted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capshift.functions.ids import py_strip
from capshift.functions.metrics import floor_zero
from capshift.operators.joins import join_small

UNITS = 1_000_000
PICK_COLUMNS = ["policy_id", "report_id", "capacity_id", "load_units", "picked_capacity_id"]


def _units(x: F.Column) -> F.Column:
    return F.floor(x * UNITS).cast("long")


def candidates(context: DataFrame, workspaces: DataFrame, peaks: DataFrame) -> DataFrame:
    """(policy_id, line): per valid policy its candidates in order, as (up_to, pos, capacity_id).

    A candidate is a known capacity whose peak is not above headroom x T; ``up_to`` is the
    room of all candidates up to and with it. One row per policy, as long as there are capacities.
    """
    known = workspaces.select(py_strip(F.col("capacity_id")).alias("capacity_id")).where("capacity_id is not null").distinct()
    caps = known.join(peaks.select("capacity_id", "peak_utilization"), "capacity_id", "left").select(
        "capacity_id", floor_zero(F.col("peak_utilization")).alias("peak"))
    listed = caps.agg(F.array_sort(F.collect_list(F.struct("peak", "capacity_id"))).alias("caps")).scalar()
    gate = F.col("gate_threshold")
    rows = context.where("valid").select("policy_id", gate, listed.alias("caps"))
    rows = rows.select("policy_id", gate, F.posexplode(F.filter("caps", lambda c: c["peak"] <= gate)))
    in_line = Window.partitionBy("policy_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("policy_id", "pos", F.col("col.capacity_id").alias("capacity_id"),
                       F.sum(_units(gate - F.col("col.peak"))).over(in_line).alias("up_to"))
    return rows.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("up_to", "pos", "capacity_id"))).alias("line"))


def pick_targets(tick: DataFrame, context: DataFrame, workspaces: DataFrame, peaks: DataFrame) -> DataFrame:
    """(PICK_COLUMNS) for every report that should leave its capacity; no candidate with room left: null."""
    here = tick.where(F.col("valid") & (F.col("decision") != "RECOVER") & F.col("capacity_id").isNotNull())
    wants = F.col("decision").isin("MOVE", "TARGET_OVERLOADED") & (F.col("utilization") > F.col("move_threshold"))
    part = F.substring(F.md5(F.col("report_id").cast("binary")), 1, 2)
    by_cap = ["policy_id", "capacity_id"]
    parts = here.groupBy(*by_cap, part.alias("part")).agg(
        F.count(F.lit(1)).alias("all"), F.count_if(wants).alias("movers"), F.max("utilization").alias("peak"))
    earlier = Window.partitionBy(*by_cap).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by_cap)
    parts = parts.withColumns({"before": F.coalesce(F.sum("movers").over(earlier), F.lit(0)),
                               "n": F.sum("all").over(whole), "n_movers": F.sum("movers").over(whole)})
    parts = parts.withColumn("load_units", _units(F.col("peak") / F.col("n")))
    caps = parts.where("n_movers > 0").groupBy(*by_cap).agg(
        F.max("peak").alias("peak"), F.max(F.col("load_units") * F.col("n_movers")).alias("brings"))
    line = Window.partitionBy("policy_id").orderBy(F.desc("peak"), "capacity_id").rowsBetween(Window.unboundedPreceding, -1)
    caps = caps.select(*by_cap, F.coalesce(F.sum("brings").over(line), F.lit(0)).alias("start"))
    offsets = parts.join(caps, by_cap).select(*by_cap, "part", "before", "load_units", "start")

    movers = here.where(wants).select("policy_id", "report_id", "capacity_id", part.alias("part"))
    inside = F.row_number().over(Window.partitionBy(*by_cap, "part").orderBy("report_id"))
    placed = join_small(movers.withColumn("n", inside), offsets, [*by_cap, "part"], "inner")
    placed = placed.withColumn("at", F.col("start") + (F.col("before") + F.col("n") - 1) * F.col("load_units"))
    found = join_small(placed, candidates(context, workspaces, peaks), "policy_id")
    pick = F.get(F.filter("line", lambda c: c["up_to"] > F.col("at")), F.lit(0))["capacity_id"]
    return found.withColumn("picked_capacity_id", pick).select(*PICK_COLUMNS)
