"""Timestamp helpers. Event time is timezone-free wall-clock time (UTC)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_literal(value: dt.datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def as_event_time(c: Column, data_type: str) -> Column:
    """Event time column -> TIMESTAMP_NTZ; unparsable text becomes null."""
    if data_type == "string":
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    if data_type == "timestamp":
        return c.cast("timestamp_ntz")
    return c


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a wall-clock timestamp, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), c.cast("timestamp_ntz"))


def from_micros(c: Column) -> Column:
    """Inverse of ``micros``: a TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", c.cast("bigint"), F.expr(_EPOCH))
