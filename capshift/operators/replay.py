"""Replay the move/recover hysteresis along the whole event history.

The reference gets history by being scheduled again and again with the state
carried in a table. Replaying it is a window over evaluation ticks:

  marker 1 when source peak > T and target peak <= headroom x T
  marker 0 when source peak < R
  state    = last non-null marker so far, starting at 0

This equals running the tick repeatedly because R < T makes the markers
exclusive (policy_check enforces it) and a report recovered in a tick is not
reconsidered in that tick. Assumptions: one fixed target capacity, and the
source capacity differs from it. The state depends only on the report's home
capacity, so it is computed per capacity, as runs of ticks with one state
(``Replay.intervals``); reports take the runs of their home (``Replay.of_reports``),
and ticks are expanded only where they are asked for (``Replay.ticks``).

Scale: events are reduced to one max per (capacity, slice) before anything
fans out; only slice maxima go to the ticks covering them (at most
lookback/step + 1 each), and the window runs over ticks, never over raw
events, so a hot capacity adds no more than one row per slice and per tick.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capshift.functions.metrics import floor_zero
from capshift.functions.timecols import from_micros, micros
from capshift.operators.joins import join_small
from capshift.operators.lineage import one_dataset, one_workspace, report_lineage
from capshift.session import scratch_path
from capshift.sources.events import with_metrics


def tick_peaks(parsed: DataFrame, lookback: dt.timedelta, step: dt.timedelta,
               metric: str = "utilization") -> DataFrame:
    """Peak per (capacity, tick) over ``[tick - lookback, tick]``, ticks every ``step``.

    With slices of width g = gcd(step, lookback), every frame is exactly a run
    of whole slices ``[tick - lookback, tick)`` plus the instant ``tick``
    itself. Events are first reduced to one max per (capacity, slice) (a
    partial aggregate, no per-event fan-out); only those slice maxima are sent
    to the ticks that cover them (at most lookback/step + 1 each), and events
    lying exactly on a tick instant go to that tick.
    """
    look_us = int(lookback.total_seconds() * 1_000_000)
    step_us = int(step.total_seconds() * 1_000_000)
    g = math.gcd(look_us, step_us)
    ev = (with_metrics(parsed).where(F.col("time").isNotNull() & F.col("capacity_id").isNotNull())
          .select("capacity_id", F.col(metric).alias("value"), micros(F.col("time")).alias("t_us")))
    # one scan: every event goes to its slice (kind 0, key j); an event exactly on a
    # tick instant also goes to that tick (kind 1, key k)
    on_tick = F.col("t_us") % step_us == 0
    keys = F.when(on_tick, F.array(F.struct(F.lit(0).alias("kind"), F.expr(f"div(t_us, {g})").alias("key")),
                                   F.struct(F.lit(1).alias("kind"), F.expr(f"div(t_us, {step_us})").alias("key"))))
    keys = keys.otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.expr(f"div(t_us, {g})").alias("key"))))
    parts = (ev.select("capacity_id", "value", F.explode(keys).alias("p"))
             .groupBy("capacity_id", "p.kind", "p.key").agg(F.max("value").alias("value")))
    # slice [j*g, (j+1)*g) lies inside [k*step - L, k*step) for k0 <= k <= k1
    k0 = F.expr(f"div((key + 1) * {g} + {step_us - 1}, {step_us})")
    k1 = F.expr(f"div(key * {g} + {look_us}, {step_us})")
    ticks = F.when(F.col("kind") == 1, F.array(F.col("key"))) \
        .when(k0 <= k1, F.sequence(k0, k1)).otherwise(F.array().cast("array<bigint>"))
    return (parts.select("capacity_id", "value", F.explode(ticks).alias("k")).groupBy("capacity_id", "k")
            .agg(floor_zero(F.max("value")).alias("peak_utilization")))


@dataclass(frozen=True)
class Rules:
    """What a replay decides by; ticks run every ``step``."""

    target_capacity_id: str
    move_threshold: float
    recovery_threshold: float
    headroom: float
    lookback: dt.timedelta
    step: dt.timedelta = dt.timedelta(hours=6)
    metric: str = "utilization"

    @property
    def step_us(self) -> int:
        return int(self.step.total_seconds() * 1_000_000)


class Replay:
    """The replay of one event history: reduced once to tick peaks, which are written and read back."""

    def __init__(self, parsed: DataFrame, rules: Rules):
        spark = parsed.sparkSession
        path = scratch_path(spark, "replay-peaks")
        tick_peaks(parsed, rules.lookback, rules.step, rules.metric).write.parquet(path)
        self.rules, self.peaks = rules, spark.read.parquet(path)
        ends = self.peaks.agg(F.min("k").alias("first"), F.max("k").alias("last")).first()  # two numbers
        self.first, self.last = ends["first"], ends["last"]

    def _with_target(self, rows: DataFrame) -> DataFrame:
        """``rows`` (k) with the target's peak; a tick without target events reads 0."""
        target = self.peaks.where(F.col("capacity_id") == self.rules.target_capacity_id).select(
            "k", F.col("peak_utilization").alias("target_peak"))
        return join_small(rows, target, "k").withColumn("target_peak", F.coalesce("target_peak", F.lit(0.0)))

    def _marker(self) -> F.Column:
        r = self.rules
        return (F.when((F.col("peak_utilization") > r.move_threshold)
                       & (F.col("target_peak") <= r.headroom * r.move_threshold), F.lit(1))
                .when(F.col("peak_utilization") < r.recovery_threshold, F.lit(0)))

    def intervals(self) -> DataFrame:
        """(capacity_id, from_k, to_k, state): runs of ticks with one state, from the first tick to the last.

        Ticks without events are not listed anywhere: the first of a gap reads as peak 0
        and so resets the state (when 0 < R), the others repeat it.
        """
        by_cap = Window.partitionBy("capacity_id").orderBy("k")
        src = self._with_target(self.peaks.where(F.col("capacity_id") != self.rules.target_capacity_id))
        src = src.select("capacity_id", "k", self._marker().alias("marker"), F.lead("k").over(by_cap).alias("next"),
                         F.row_number().over(by_cap).alias("n"))
        gap = F.coalesce("next", F.lit(self.last + 1 if self.last is not None else 0)) > F.col("k") + 1

        def mark(k, order, marker):
            return F.struct(k.cast("long").alias("k"), F.lit(order).alias("o"), marker.cast("int").alias("marker"))

        marks = [F.when(F.col("n") == 1, mark(F.lit(self.first), 0, F.lit(0))), mark(F.col("k"), 1, F.col("marker"))]
        if self.rules.recovery_threshold > 0:
            marks.append(F.when(gap, mark(F.col("k") + 1, 1, F.lit(0))))
        rows = src.select("capacity_id", F.explode(F.array(*marks)).alias("m")).where("m.marker is not null")
        rows = rows.select("capacity_id", "m.*")
        in_order = Window.partitionBy("capacity_id").orderBy("k", "o")
        changes = rows.withColumn("before", F.lag("marker").over(in_order)).where("before is null or before <> marker")
        runs = changes.withColumn("to_k", F.coalesce(F.lead("k").over(in_order) - 1, F.lit(self.last).cast("long")))
        return runs.where("k <= to_k").select("capacity_id", F.col("k").alias("from_k"), "to_k", F.col("marker").alias("state"))

    def ticks(self) -> DataFrame:
        """The intervals expanded: every source capacity at every tick, with peaks, marker and state."""
        grid = self.intervals().select("capacity_id", F.explode(F.sequence("from_k", "to_k")).alias("k"), "state")
        rows = grid.join(self.peaks, ["capacity_id", "k"], "left").withColumn(
            "peak_utilization", F.coalesce("peak_utilization", F.lit(0.0)))
        return self._with_target(rows).select(
            "capacity_id", from_micros(F.col("k") * F.lit(self.rules.step_us)).alias("tick"), "peak_utilization",
            "target_peak", self._marker().alias("marker"), "state")

    def of_reports(self, homes: DataFrame) -> DataFrame:
        """(report_id, capacity_id, from_tick, to_tick, state) for ``homes`` (report_id, capacity_id).

        The intervals of a capacity travel as one row, so a capacity that is the home of
        most reports is joined by broadcast; nothing is expanded to ticks.
        """
        def tick(k):
            return from_micros(k * F.lit(self.rules.step_us))

        runs = self.intervals().groupBy("capacity_id").agg(
            F.array_sort(F.collect_list(F.struct("from_k", "to_k", "state"))).alias("runs"))
        rows = join_small(homes, runs, "capacity_id", "inner").select("report_id", "capacity_id", F.explode("runs").alias("r"))
        return rows.select("report_id", "capacity_id", tick(F.col("r.from_k")).alias("from_tick"),
                           tick(F.col("r.to_k")).alias("to_tick"), F.col("r.state").alias("state"))


def report_homes(watched: DataFrame, state: DataFrame, reports: DataFrame, datasets: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(report_id, capacity_id): where a watched report belongs - by its initial dataset if it was moved, else as it is."""
    current = report_lineage(watched.select("report_id").distinct(), reports, datasets, workspaces)
    d = one_dataset(datasets).select(F.col("dataset_id").alias("initial_dataset_id"), "workspace_id")
    w = one_workspace(workspaces).select("workspace_id", F.col("capacity_id").alias("home_capacity_id"))
    moved = state.groupBy("report_id").agg(F.min("initial_dataset_id").alias("initial_dataset_id"))
    moved = moved.join(d, "initial_dataset_id", "left").join(w, "workspace_id", "left").select("report_id", "home_capacity_id")
    return (current.join(moved, "report_id", "left")
            .select("report_id", F.coalesce("home_capacity_id", "capacity_id").alias("capacity_id"))
            .where("capacity_id is not null"))


def hysteresis_replay(parsed: DataFrame, target_capacity_id: str, move_threshold: float,
                      recovery_threshold: float, headroom: float, lookback: dt.timedelta,
                      step: dt.timedelta = dt.timedelta(hours=6), metric: str = "utilization") -> DataFrame:
    return Replay(parsed, Rules(target_capacity_id, move_threshold, recovery_threshold, headroom, lookback, step, metric)).ticks()
