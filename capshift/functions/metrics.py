"""Utilisation metrics as built-in column expressions (stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _no_nan(c: Column) -> Column:
    # NaN ranks above every number in max(); the reference's ``>`` fold never
    # picks it, so NaN is turned into null before any peak is taken.
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def utilization(unit_ms: Column, base_units: Column) -> Column:
    """Consumed unit-milliseconds over the units available in one 30 s sample.

    Zero or missing base units give null (never an error under ANSI mode).
    """
    # Evaluated as base x 1000 x 30 in that order (the reference's formula);
    # floating-point products are not reassociated, so the order is kept.
    return _no_nan(F.try_divide(unit_ms, base_units * 1000 * 30))


def interactive_share(interactive: Column, background: Column) -> Column:
    """Interactive utilisation over interactive + background; 0/0 gives null."""
    return _no_nan(F.try_divide(interactive, background + interactive))


def floor_zero(peak: Column) -> Column:
    """A peak read with the reference's fold: start at 0, keep larger values.

    Missing (no rows, or only null ratios) reads as 0, negatives as 0.
    """
    return F.greatest(F.coalesce(peak, F.lit(0.0)), F.lit(0.0))

