"""Streaming trailing peak.

T1 re-aims the reference's "read the last 5 minutes every run" as a sliding
event-time window (5 minutes, sliding each minute) with a watermark: rows up to
the delay late are aggregated, and in append mode a window is emitted once,
when the watermark passes its end. (Spark does not promise to drop rows later
than the watermark; one whose windows were never emitted is still counted.)
Spark windows are ``[start, end)`` while the batch look-back includes its lower
bound; they differ only for an event exactly on a window boundary.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capshift.functions.metrics import floor_zero
from capshift.session import scratch_path
from capshift.sources.events import parse_events, with_metrics


def windowed_peaks(parsed_stream: DataFrame, window: str = "5 minutes", slide: str = "1 minute",
                   delay: str = "10 minutes", metric: str = "utilization") -> DataFrame:
    """Peak per (window, capacity) on a stream of parsed events."""
    ev = (with_metrics(parsed_stream)
          .where(F.col("time").isNotNull() & F.col("capacity_id").isNotNull())
          # watermarks need TIMESTAMP; with the session in UTC the wall clock is kept.
          .withColumn("event_time", F.col("time").cast("timestamp"))
          .withWatermark("event_time", delay))
    agg = ev.groupBy(F.window("event_time", window, slide).alias("w"), "capacity_id").agg(
        floor_zero(F.max(metric)).alias("peak_utilization"), F.count(F.lit(1)).alias("n_events"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                      "capacity_id", "peak_utilization", "n_events")


@dataclass(frozen=True)
class Drained:
    """Where a drained stream wrote its rows, and how many of its input rows a stateful step dropped as late."""

    path: str
    late_rows: int


@contextmanager
def _session_conf(spark: SparkSession, conf: dict[str, str]):
    """Settings that a query reads when it starts, put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def drain(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append", base: str | None = None,
          conf: dict[str, str] | None = None) -> Drained:
    """Write everything available (``availableNow``) of a stream as Parquet.

    Output and checkpoint lie under ``base``. A query that is given the same ``base``
    again goes on from its checkpoint; without one, a fresh folder under the shared
    checkpoint root is used. Late rows are summed over the progress reports as they come.
    """
    base = base or scratch_path(spark, name)
    with _session_conf(spark, conf or {}):
        q = (stream.writeStream.format("parquet").outputMode(mode)
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
        late: dict[int, int] = {}
        running = True
        while running:
            running = not q.awaitTermination(1)
            for progress in q.recentProgress:
                late[progress["batchId"]] = sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])
    if q.exception() is not None:
        raise q.exception()
    return Drained(f"{base}/out", sum(late.values()))


def stream_peak(spark: SparkSession, envelope_stream: DataFrame, **kw) -> DataFrame:
    """T1 end to end: envelope stream -> closed windows, read back as a batch table."""
    return spark.read.parquet(drain(windowed_peaks(parse_events(envelope_stream), **kw), spark, "stream_peak").path)
