"""Per-capacity hysteresis on a stream in event-time order, emitting only state changes.

Each capacity keeps its state (moved 0/1) and the samples that may still be preceded by
others, in the state store (RocksDB). A sample above T marks the capacity moved, one
below R marks it home; samples in between are filtered out before the stateful step.
Samples wait until the watermark (newest event time less ``delay``) has passed them: by
then everything older that will be accepted has arrived, so they are applied in order of
time whatever files and micro-batches they came in, and the result does not depend on
``maxFilesPerTrigger`` as long as no sample is later than ``delay``. Later ones are
dropped by the watermark filter of the stateful operator, and counted
(``Drained.late_rows``). What a capacity holds is bounded by its samples within the
delay and one micro-batch; incoming rows are appended chunk by chunk, never collected.

Changes up to the final watermark are emitted when a stream is drained; samples after it
stay in the state until later events move the watermark on.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from capshift.functions.timecols import micros
from capshift.sources.events import parse_events, with_metrics
from capshift.streaming.peak import Drained, drain

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "10 minutes"

OUTPUT = T.StructType([
    T.StructField("capacity_id", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("state", T.IntegerType()),
])
MOVED = T.StructType([T.StructField("state", T.IntegerType())])
SAMPLE = T.StructType([T.StructField("t_us", T.LongType()), T.StructField("utilization", T.DoubleType())])


class Hysteresis(StatefulProcessor):
    def __init__(self, move_threshold: float, recovery_threshold: float):
        self.t, self.r = move_threshold, recovery_threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moved = handle.getValueState("moved", MOVED)
        self.waiting = handle.getListState("waiting", SAMPLE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            if len(chunk):
                self.waiting.appendList(list(zip(chunk["t_us"].tolist(), chunk["utilization"].tolist())))
                least = int(chunk["t_us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            yield from self._apply(key, timerValues.getCurrentWatermarkInMs(), first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._apply(key, timerValues.getCurrentWatermarkInMs(), None)

    def _wake(self, t_us: int) -> None:
        """Come back when the watermark has passed a sample."""
        self.handle.registerTimer(-(-t_us // 1000))

    def _apply(self, key, watermark_ms: int, first: int | None) -> Iterator[pd.DataFrame]:
        """Apply the waiting samples up to the watermark, in order of (time, utilization)."""
        passed = watermark_ms * 1000
        if first is not None and first > passed:
            self._wake(first)  # nothing new to apply; older samples have timers of their own
            return
        held = list(self.waiting.get()) if self.waiting.exists() else []
        if not held:
            return
        t_us = np.array([row[0] for row in held], np.int64)
        u = np.array([row[1] for row in held], np.float64)
        due = t_us <= passed
        if not due.all():
            self.waiting.put([(int(t), float(x)) for t, x in zip(t_us[~due], u[~due])])
            self._wake(int(t_us[~due].min()))
        else:
            self.waiting.clear()
        if not due.any():
            return
        t_us, u = t_us[due], u[due]
        order = np.lexsort((u, t_us))
        t_us, u = t_us[order], u[order]
        state = self.moved.get()[0] if self.moved.exists() else 0
        # the filter before this step leaves only samples that decide the state
        now = (u > self.t).astype("int32")
        changed = now != np.concatenate(([state], now[:-1]))
        self.moved.update((int(now[-1]),))
        if changed.any():
            yield pd.DataFrame({"capacity_id": key[0], "time": pd.to_datetime(t_us[changed], unit="us"),
                                "state": now[changed]})

    def close(self) -> None:
        pass


def hysteresis_changes(parsed_stream: DataFrame, move_threshold: float, recovery_threshold: float,
                       delay: str = DELAY) -> DataFrame:
    u = F.col("utilization")
    ev = (with_metrics(parsed_stream).where(F.col("time").isNotNull())
          .withColumn("event_time", F.col("time").cast("timestamp")).withWatermark("event_time", delay)
          # Samples between R and T (or without a ratio) never change the state, so
          # they are dropped in the JVM before rows are handed to Python. They do move the
          # watermark: the condition names the event time, which keeps it above that step.
          .where(F.when(F.col("event_time").isNotNull(),
                        F.col("capacity_id").isNotNull() & ((u > move_threshold) | (u < recovery_threshold))))
          .select("capacity_id", "event_time", micros(F.col("time")).alias("t_us"), "utilization"))
    return ev.groupBy("capacity_id").transformWithStateInPandas(
        statefulProcessor=Hysteresis(move_threshold, recovery_threshold),
        outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def drain_hysteresis(spark: SparkSession, envelope_stream: DataFrame, move_threshold: float, recovery_threshold: float,
                     delay: str = DELAY, base: str | None = None) -> Drained:
    """The changes written as Parquet, and how many samples came too late to be applied."""
    changes = hysteresis_changes(parse_events(envelope_stream), move_threshold, recovery_threshold, delay)
    return drain(changes, spark, "stream_hysteresis", base=base,
                 conf={"spark.sql.streaming.stateStore.providerClass": ROCKSDB})


def stream_hysteresis(spark: SparkSession, envelope_stream: DataFrame, move_threshold: float,
                      recovery_threshold: float, delay: str = DELAY) -> DataFrame:
    done = drain_hysteresis(spark, envelope_stream, move_threshold, recovery_threshold, delay)
    return spark.read.schema(OUTPUT).parquet(done.path)
