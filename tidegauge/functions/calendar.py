"""Trading calendars: a row for each date with is_open, and the sessions around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.errors import DataError


def with_sessions(calendar: DataFrame, day: str = "cal_date", is_open: str = "is_open") -> DataFrame:
    """The calendar with previous_session and next_session of each date. A calendar has a row a day: its size is that of
    the years covered, whatever the data's, so one window over it is bounded."""
    opened = F.when(F.col(is_open), F.col(day))
    order = Window.orderBy(day)
    return calendar.withColumns(
        {
            "previous_session": F.last(opened, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "next_session": F.first(opened, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    )


def next_sessions(calendar: DataFrame, day: str = "cal_date", is_open: str = "is_open") -> DataFrame:
    """(day, next_session) for every natural day from the first open day of the calendar to the one before the last, whether
    the calendar has it or not. A row a day: bounded by the years covered."""
    opened = calendar.where(F.col(is_open)).select(F.col(day).alias("_open")).distinct()
    spine = opened.agg(F.min("_open").alias("a"), F.max("_open").alias("b")).where("a < b").select(F.explode(F.sequence("a", F.date_sub("b", 1))).alias(day))
    following = F.first("_open", ignorenulls=True).over(Window.orderBy(F.coalesce(day, "_open")).rowsBetween(1, Window.unboundedFollowing))
    return spine.join(opened, spine[day] == F.col("_open"), "full_outer").withColumn("next_session", following).where(F.col(day).isNotNull()).select(day, "next_session")


def previous_open(calendar: DataFrame, before: str, day: str = "cal_date", is_open: str = "is_open") -> DataFrame:
    """One row: the last open day before a date, null if there is none."""
    return calendar.where(F.col(is_open).cast("boolean") & (F.col(day) < F.lit(before).cast("date"))).agg(F.max(day).alias(day))


def open_bounds(calendar: DataFrame, day: str = "cal_date", is_open: str = "is_open") -> tuple:
    """The first and the last open day, None if there is none."""
    return tuple(calendar.where(F.col(is_open)).agg(F.min(day), F.max(day)).first())


def join_next_session(df: DataFrame, calendar: DataFrame, day: str, out: str = "next_session") -> DataFrame:
    """df with the smallest open day after each row's day, be that in the calendar or not; null if the calendar ends before.
    The calendar's days are broadcast: some hundred rows a year."""
    first = open_bounds(calendar)[0]
    spine = next_sessions(calendar).select(F.col("cal_date").alias(day), F.col("next_session").alias(out))
    joined = df.join(F.broadcast(spine), day, "left")
    return joined.withColumn(out, F.when(F.col(day) < F.lit(first).cast("date"), F.lit(first).cast("date")).otherwise(F.col(out)))


def require_reached(df: DataFrame, day: str, last_open) -> None:
    """DataError if a row's day has no open day after it: an eager check that reads this column alone, so that a later
    projection or filter cannot drop it."""
    latest = df.agg(F.max(day)).first()[0]
    if latest is not None and (last_open is None or latest >= last_open):
        raise DataError(f"the calendar ends on {last_open} and does not cover the session after {latest}")


def require_covered(df: DataFrame, column: str = "next_session") -> None:
    """DataError if a row has no session: an eager check, so that a later projection cannot drop it."""
    if not df.where(F.col(column).isNull()).isEmpty():
        raise DataError(f"the calendar does not cover {column} of some rows")
