"""The balancing tick on a stream.

Every micro-batch is added to the typed event table once (its partition is named by the
run, so a repeated batch writes over itself), the tick looks back over that table as a
scheduled run does - a capacity that is silent in this batch keeps its earlier
samples - and starts from the state that the last published run left. The run's outputs
are published together; a batch that was published already is not run again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capshift.params import RunParams
from capshift.plans.balance import BalanceRun
from capshift.sources.events import ingest_capacity_events, read_typed_events
from capshift.sources.runs import RunStore

# (parameters, state, typed events) -> the run to make
MakeRun = Callable[[RunParams, DataFrame, DataFrame], BalanceRun]


def balance_each_batch(spark: SparkSession, store: RunStore, events_path: str, make_run: MakeRun, lookback: dt.timedelta,
                       initial_state: DataFrame | None = None, name: str = "batch"):
    """A ``foreachBatch`` function: one published run per micro-batch that holds events."""
    def step(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{name}-{batch_id:09d}"
        if store.find(run_id) is not None:
            return
        ingest_capacity_events(batch, events_path, run_id)
        newest = (spark.read.parquet(events_path).where(F.col("ingest_batch") == run_id)
                  .agg(F.max("time").alias("t")).first()["t"])  # one scalar
        if newest is None:
            return
        last = store.latest()
        as_of = newest if last is None else max(newest, last["as_of"])
        params = RunParams(as_of=as_of, lookback=lookback, run_id=run_id)
        store.publish(make_run(params, store.state(initial_state), read_typed_events(spark, events_path)))

    return step


def balance_stream(spark: SparkSession, envelope_stream: DataFrame, root: str, make_run: MakeRun, lookback: dt.timedelta,
                   initial_state: DataFrame | None = None) -> RunStore:
    """Drain a stream of event envelopes, one published run per micro-batch; ``root`` holds runs, events and checkpoint."""
    store = RunStore(spark, f"{root}/runs")
    step = balance_each_batch(spark, store, f"{root}/events", make_run, lookback, initial_state)
    query = (envelope_stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return store
