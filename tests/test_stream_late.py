"""T1 watermark semantics over two micro-batches.

Spark guarantees that rows within the watermark delay are aggregated and that
a window is emitted (once, append mode) only after the watermark passes its
end; rows later than the watermark are not guaranteed to be dropped.
"""

from __future__ import annotations

import datetime as dt

from capshift import schemas
from capshift.sources.events import read_capacity_event_stream
from capshift.streaming.peak import stream_peak

from world import event

T0 = dt.datetime(2024, 1, 22, 12, 0)


def test_windows_close_with_the_watermark(spark, tmp_dir):
    src = f"{tmp_dir}/events"
    first = [event("A", 0.2, when=T0), event("A", 0.3, when=T0 + dt.timedelta(minutes=30))]
    second = [event("A", 0.8, when=T0 + dt.timedelta(minutes=25, seconds=30)),  # within the 10 min delay
              event("A", 0.1, when=T0 + dt.timedelta(minutes=60))]
    spark.createDataFrame(first, schemas.CAPACITY_EVENTS).coalesce(1).write.parquet(f"{src}/part=1")
    spark.createDataFrame(second, schemas.CAPACITY_EVENTS).coalesce(1).write.parquet(f"{src}/part=2")
    stream = read_capacity_event_stream(spark, f"{src}/*", max_files_per_trigger=1, glob="*.parquet")
    rows = stream_peak(spark, stream).collect()
    got = {(r["window_start"], r["peak_utilization"]) for r in rows}
    assert (T0 + dt.timedelta(minutes=25), 0.8) in got        # arrived one batch later, still counted
    assert (T0, 0.2) in got
    final_watermark = T0 + dt.timedelta(minutes=50)
    assert all(r["window_end"] <= final_watermark for r in rows)  # only closed windows are emitted
    assert len({(r["window_start"], r["capacity_id"]) for r in rows}) == len(rows)  # each window once
