"""Scalar expressions with the null, infinity and rounding rules that market data needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Equal within the larger of a relative and an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)), F.lit(atol))


def at_clock(day: Column, clock: str) -> Column:
    """The instant of a wall clock (`16:05`) on a date, without a zone."""
    hours, minutes = clock.split(":")
    return day.cast("timestamp_ntz") + F.expr(f"INTERVAL '{int(hours)}:{int(minutes):02d}' HOUR TO MINUTE")


def epoch_micros(x: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds since the epoch, told by magnitude, as microseconds."""
    size = F.abs(x)
    return F.when(size < 10**11, x * 1_000_000).when(size < 10**14, x * 1_000).when(size < 10**17, x).otherwise(F.floor(x / 1_000)).cast("long")


def last_first(*names: str) -> list[Column]:
    """Descending order, nulls last."""
    return [F.col(n).desc_nulls_last() for n in names]
