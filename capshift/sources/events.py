"""Capacity event log: scan (batch), parse and time filter.

The log is an append-only envelope ``(time, data)`` whose ``data`` is JSON.
Reading uses an explicit schema; parsing uses ``from_json`` with a declared
payload schema so unused fields are pruned and no inference happens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capshift import schemas
from capshift.functions.metrics import interactive_share, utilization
from capshift.functions.timecols import as_event_time, ts_literal
from capshift.params import RunParams


def read_capacity_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan the envelope. ``fmt`` is ``parquet`` or ``json`` (JSON lines)."""
    reader = spark.read.schema(schemas.CAPACITY_EVENTS)
    if fmt == "json":
        # Event time arrives as text in JSON logs; keep it as text and let
        # parse_events turn bad values into null.
        reader = spark.read.schema("time STRING, data STRING")
    return reader.format(fmt).load(path)


def read_capacity_event_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                               max_files_per_trigger: int = 256, glob: str | None = None) -> DataFrame:
    """The envelope as a stream of newly arriving files.

    ``maxFilesPerTrigger`` bounds every micro-batch, which bounds what a
    stateful operator sees of one capacity at a time.
    """
    schema = schemas.CAPACITY_EVENTS if fmt != "json" else "time STRING, data STRING"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def parse_events(envelope: DataFrame) -> DataFrame:
    """Envelope -> typed columns (bad JSON or bad time -> nulls)."""
    time_type = dict(envelope.dtypes)["time"]
    # The payload's fields come out of a generator, which filters on them are not moved
    # below: each payload is parsed once, in one place. The time filter is moved below.
    # (An explicit option keeps Catalyst from splitting the parse into one per field.)
    p = F.from_json(F.col("data"), schemas.EVENT_PAYLOAD, {"mode": "PERMISSIVE"})
    return envelope.select(
        as_event_time(F.col("time"), time_type).alias("time"), F.inline_outer(F.array(p))).select(
        "time",
        F.col("capacityId").alias("capacity_id"),
        F.col("capacityUnitMs").alias("capacity_unit_ms"),
        F.col("baseCapacityUnits").alias("base_capacity_units"),
        F.col("utilizationInteractive").alias("utilization_interactive"),
        F.col("utilizationBackground").alias("utilization_background"),
    )


def with_metrics(parsed: DataFrame) -> DataFrame:
    """P4 and P5 per event."""
    return parsed.withColumns({
        "utilization": utilization(F.col("capacity_unit_ms"), F.col("base_capacity_units")),
        "interactive_share": interactive_share(F.col("utilization_interactive"),
                                               F.col("utilization_background")),
    })


def in_lookback(parsed: DataFrame, params: RunParams) -> DataFrame:
    """``as_of - lookback <= time <= as_of`` (lower bound inclusive).

    The upper bound makes a run reproducible when replayed later. Both bounds
    are literals on the scan column, so the filter reaches the Parquet reader;
    on an ingested table the same bounds on ``event_date`` prune partitions.
    """
    cond = (F.col("time") >= ts_literal(params.window_start)) & (F.col("time") <= ts_literal(params.as_of))
    if "event_date" in parsed.columns:
        cond = cond & F.col("event_date").between(F.lit(params.window_start.date()), F.lit(params.as_of.date()))
    return parsed.where(cond)


def ingest_capacity_events(envelope: DataFrame, path: str, batch_id: str) -> None:
    """Parse each payload once and add typed events, partitioned by event date and ingest batch.

    Downstream jobs then read columns instead of JSON, and a look-back touches
    only the partitions of its dates. An increment or a late row adds a
    partition beside those already stored for its day; only a retry of the
    same ``batch_id`` replaces what that batch wrote.
    """
    typed = parse_events(envelope).withColumns({"event_date": F.to_date("time"), "ingest_batch": F.lit(batch_id)})
    # Written straight from the input partitions: no shuffle, so a hot capacity
    # or a busy day never lands in one task.
    (typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date", "ingest_batch").parquet(path))


def read_typed_events(spark: SparkSession, path: str) -> DataFrame:
    """The ingested event table: parsed columns plus the ``event_date`` partition."""
    return spark.read.parquet(path).drop("ingest_batch")


def anchor_on_newest_event(parsed: DataFrame, params: RunParams) -> RunParams:
    """Run parameters whose ``as_of`` is the newest event time instead of the clock.

    For logs that arrive late: the look-back then always covers the latest
    samples. One scalar is read (a global ``max``, aggregated map-side).
    """
    import dataclasses

    newest = parsed.agg(F.max("time").alias("t")).first()["t"]
    return dataclasses.replace(params, as_of=newest) if newest is not None else params
