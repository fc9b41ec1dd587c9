"""Rows with versions and validity: statements, disclosures, dividends, universes, identities, suspensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.errors import DataError, UnavailableError
from tidegauge.operators.bars import latest


def current_versions(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The version of each key that stands at the time of the rows given. Filters on payload belong after it."""
    return latest(df, keys, order)


def last_periods(df: DataFrame, symbol: str, period: str, n: int) -> DataFrame:
    """Rows of each symbol's last n periods, ranked before any further filter."""
    return df.withColumn("_r", F.dense_rank().over(Window.partitionBy(symbol).orderBy(F.col(period).desc_nulls_last()))).where(F.col("_r") <= n).drop("_r")


def valid_at(df: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Rows with start <= day < end; a null end is open."""
    d = F.lit(day).cast("date")
    return df.where((F.col(start) <= d) & (F.col(end).isNull() | (d < F.col(end))))


def masked(df: DataFrame, columns: list[str], shown: Column) -> DataFrame:
    """The columns where `shown` holds, else null."""
    return df.withColumns({c: F.when(shown, F.col(c)) for c in columns})


def canonicalise(df: DataFrame, aliases: DataFrame, code: str, keys: list[str]) -> DataFrame:
    """df under canonical codes (aliases: code, canonical), whole rows distinct; DataError if a key then has two rows."""
    out = df.join(aliases.select(F.col("code").alias(code), "canonical"), code, "left").withColumn(code, F.coalesce("canonical", code)).drop("canonical").distinct()
    if not out.groupBy(*keys).count().where("count > 1").isEmpty():
        raise DataError(f"codes collide on {', '.join(keys)}")
    return out


#: A stretch of a day: `H:MM[:SS]-H:MM[:SS]`, with white space around its clocks.
STRETCH = r"^\s*([01]?[0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))?\s*-\s*([01]?[0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))?\s*$"
# Fixed value: the second of the day at which events without a stretch begin.
WHOLE_DAY_AT = 9 * 3600 + 25 * 60


def stretches(timing: Column) -> Column:
    """The stretches of a timing as structs of seconds (start, stop); null timings have none, and a null struct stands for a
    part that is malformed or does not end after it starts."""
    part = lambda x, k: F.coalesce(F.regexp_extract(x, STRETCH, k).try_cast("int"), F.lit(0))
    seconds = lambda x, k: part(x, k) * 3600 + part(x, k + 1) * 60 + part(x, k + 2)
    one = lambda x: F.when(x.rlike(STRETCH) & (seconds(x, 1) < seconds(x, 4)), F.struct(seconds(x, 1).alias("start"), seconds(x, 4).alias("stop")))
    return F.when(timing.isNull(), F.array().cast("array<struct<start:int,stop:int>>")).otherwise(F.transform(F.split(timing, ","), one))


def valid_timing(timing: Column) -> Column:
    return ~F.exists(stretches(timing), lambda x: x.isNull())


def seconds_of(clock: str) -> float:
    """The seconds since midnight of `HH:MM[:SS[.f]]`."""
    hour, minute, *second = clock.split(":")
    return int(hour) * 3600 + int(minute) * 60 + float(second[0] if second else 0)


def suspended(events: DataFrame, symbols: DataFrame, symbol: str, clock: str, covered: bool = True) -> DataFrame:
    """(symbol, suspended) at a clock time. events: symbol, kind, timing: null for the whole day, else stretches, comma-joined.

    Events that have begun count. Without a stretch an event begins at 9:25 and means suspended (S), not (R) or unknown (any
    other kind). A stretch begins at its start; one of S means suspended until its end and not after it, one of R not, any
    other unknown. While a stretch of S lasts, the symbol is suspended whatever else there is; else the last start decides,
    and the state is unknown (null) if that start's events differ. Without an event it is false, or null where the day is not
    covered. A malformed timing is an UnavailableError, whether its event has begun or not.
    """
    if not events.where(~valid_timing(F.col("timing"))).isEmpty():
        raise UnavailableError("a suspension has a malformed timing")
    now = F.lit(seconds_of(clock))
    whole = F.array(F.struct(F.lit(WHOLE_DAY_AT).alias("start"), F.lit(None).cast("int").alias("stop")))
    each = F.explode(F.when(F.col("timing").isNull(), whole).otherwise(stretches(F.col("timing")))).alias("x")
    begun = events.select(symbol, "kind", each).select(symbol, "kind", "x.*").where(F.col("start") <= now)
    lasts = (F.col("kind") == "S") & (now < F.col("stop"))
    state = F.when(F.col("kind") == "S", F.col("stop").isNull() | (now < F.col("stop"))).when(F.col("kind") == "R", False)
    last = begun.withColumns({"active": F.coalesce(lasts, F.lit(False)), "state": state, "last": F.max("start").over(Window.partitionBy(symbol))})
    at_last = lambda c: F.max(F.when(F.col("start") == F.col("last"), c))
    seen = last.groupBy(symbol).agg(F.bool_or("active").alias("active"), *[at_last(c).alias(n) for n, c in (("yes", F.coalesce("state", F.lit(False))), ("no", F.coalesce(~F.col("state"), F.lit(False))), ("unknown", F.col("state").isNull()))])
    kinds = F.col("yes").cast("int") + F.col("no").cast("int") + F.col("unknown").cast("int")
    decided = F.when(F.col("active"), True).when((kinds == 1) & ~F.col("unknown"), F.col("yes"))
    out = symbols.join(seen, symbol, "left")
    return out.select(symbol, F.when(F.col("active").isNotNull(), decided).otherwise(F.lit(False) if covered else F.lit(None).cast("boolean")).alias("suspended"))
