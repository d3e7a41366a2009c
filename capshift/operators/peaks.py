"""Peak utilisation per capacity (A1) and along the history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capshift.functions.metrics import floor_zero
from capshift.functions.timecols import micros
from capshift.params import RunParams
from capshift.sources.events import in_lookback, with_metrics

METRICS = ("utilization", "interactive_share")


def _metric_col(metric: str) -> str:
    name = {"overall": "utilization"}.get(metric, metric)
    if name not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return name


def capacity_peak(parsed: DataFrame, params: RunParams, capacities: list[str] | None = None) -> DataFrame:
    """A1: peak of the chosen metric per capacity over the look-back.

    ``capacities`` (P3) restricts the result to the named capacities (exact,
    case-sensitive match); by default every capacity is a group.

    ``max`` is computed with a map-side partial aggregate, so a capacity that
    holds a large share of the events still shuffles one row per task.
    Events without a usable ratio are counted (``n_unmeasured``), not peaked.
    Capacities with no events are absent here; joins read them as 0.
    """
    m = _metric_col(params.metric)
    recent = with_metrics(in_lookback(parsed, params)).where(F.col("capacity_id").isNotNull())
    if capacities is not None:
        recent = recent.where(F.col("capacity_id").isin(list(capacities)))
    return recent.groupBy("capacity_id").agg(
        floor_zero(F.max(m)).alias("peak_utilization"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col(m).isNull()).alias("n_unmeasured"),
    )


def rolling_peak(parsed: DataFrame, lookback: dt.timedelta, metric: str = "overall") -> DataFrame:
    """At every event, the peak over ``[time - lookback, time]`` of its capacity.

    Time is cut into blocks as long as the look-back, so a frame is the start of its
    own block up to the event, and the end of the block before from ``time - lookback``
    on: a prefix maximum and a suffix maximum, one window each over the same shuffle by
    (capacity, block). What an event needs of the block before are only the steps of its
    suffix maximum (where a value exceeds all later ones, few as a rule), so one short
    row per block is shuffled to the next block, and no event is shuffled twice. A
    partition is one look-back of one capacity, however long the history.
    """
    m = _metric_col(metric)
    look_us = int(lookback.total_seconds() * 1_000_000)
    ev = with_metrics(parsed).where(F.col("time").isNotNull() & F.col("capacity_id").isNotNull())
    # never null, so that the join below adds no filter to one side only: both sides must share their exchange
    number = F.coalesce(F.floor(micros(F.col("time")) / look_us).cast("long"), F.lit(0).cast("long"))
    ev = ev.select("capacity_id", "time", F.col(m).alias("value"), number.alias("block"))
    block = Window.partitionBy("capacity_id", "block")
    # both windows read the same four columns, so that they share one exchange
    so_far = ev.withColumn("own", F.max("value").over(block.orderBy("time")))
    to_come = ev.withColumn("rest", F.max("value").over(block.orderBy(F.desc("time")))).where("rest is not null")
    steps = (to_come.groupBy("capacity_id", "block", "rest").agg(F.max("time").alias("until"))
             .groupBy("capacity_id", "block").agg(F.array_sort(F.collect_list(F.struct(
                 micros(F.col("until")).alias("until"), F.col("rest").alias("peak")))).alias("steps"))
             .withColumn("block", F.col("block") + 1))
    start = micros(F.col("time")) - look_us
    tail = F.get(F.filter("steps", lambda step: step["until"] >= start), F.lit(0))["peak"]
    return so_far.join(steps, ["capacity_id", "block"], "left").select(
        "capacity_id", "time", F.col("value").alias(m), floor_zero(F.greatest("own", tail)).alias("rolling_peak"))
