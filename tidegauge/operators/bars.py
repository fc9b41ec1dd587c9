"""Bars, and rows as they were visible at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.errors import DataError, RequestError, ResultTooLargeError
from tidegauge.functions.values import at_clock


def daily_bars(ticks: DataFrame, symbol: str, at: str, price: str) -> DataFrame:
    """(symbol, day, open, high, low, close, volume) of ticks; open and close are those of the first and last instant."""
    return ticks.groupBy(symbol, F.to_date(at).alias("day")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").alias("volume")
    )


def visible_days(df: DataFrame, as_of: str, clock: str, day: str = "day") -> DataFrame:
    """Rows whose day's clock time is not after as_of. The plain bound on the day reaches the scan; the instant does not."""
    return df.where((F.col(day) <= F.to_date(F.lit(as_of))) & (at_clock(F.col(day), clock) <= F.lit(as_of).cast("timestamp_ntz")))


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an explicit order; ties need a last tie-breaker in it. Spark limits each group before
    the shuffle, so a hot key sends n rows a task."""
    if n < 1:
        raise RequestError("n must be 1 or more")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def capped(df: DataFrame, cap: int) -> DataFrame:
    """df, or ResultTooLargeError if it has more than cap rows."""
    if df.limit(cap + 1).count() > cap:
        raise ResultTooLargeError(f"more than {cap} rows")
    return df


def adjust_by_factor(bars: DataFrame, factors: DataFrame, keys: list[str], prices: list[str], check: bool = False) -> DataFrame:
    """Prices times a day's factor over the symbol's latest factor. factors: keys (symbol, day) and factor, all visible.
    Missing or zero factors give null prices, or DataError if check."""
    symbol = keys[0]
    anchors = factors.groupBy(symbol).agg(F.expr(f"max_by(factor, {keys[1]}) FILTER (WHERE factor IS NOT NULL)").alias("anchor"))
    out = bars.join(factors, keys, "left").join(anchors, symbol, "left").withColumn("_ratio", F.try_divide("factor", "anchor"))
    if check and not out.where("_ratio is null").isEmpty():
        raise DataError("a factor is missing")
    return out.withColumns({p: F.col(p) * F.col("_ratio") for p in prices}).drop("factor", "anchor", "_ratio")


def adjust_by_events(bars: DataFrame, events: DataFrame, symbol: str, day: str, prices: list[str], anchor: str) -> DataFrame:
    """Prices over the product of the ratios of later events up to the anchor date. events: symbol, ex_date, dr. A symbol's
    events are few, so the join is by symbol and the range is a condition on it."""
    right = events.where(F.col("ex_date") <= F.lit(anchor).cast("date")).select(F.col(symbol).alias("_s"), "ex_date", "dr")
    later = bars.select(symbol, day).distinct().join(right, (F.col(symbol) == F.col("_s")) & (F.col("ex_date") > F.col(day)))
    ratio = later.groupBy(symbol, day).agg(F.product("dr").alias("_ratio"))
    out = bars.join(ratio, [symbol, day], "left").withColumn("_ratio", F.coalesce(F.nullif("_ratio", F.lit(0.0)), F.lit(1.0)))
    return out.withColumns({p: F.col(p) / F.col("_ratio") for p in prices}).drop("_ratio")


def momentum(bars: DataFrame, symbol: str, day: str, close: str, days: int, top: int) -> DataFrame:
    """The `top` symbols by last over first close, minus 1, over exactly the last `days` days of the data: symbols that miss
    one, or have a close that is null, NaN or not positive, drop out. Ties go to the smaller symbol; weights are equal."""
    window = bars.select(day).distinct().orderBy(F.desc(day)).limit(days)
    good = F.col(close).isNotNull() & ~F.isnan(close) & (F.col(close) > 0)
    own = bars.join(F.broadcast(window), day, "left_semi").groupBy(symbol).agg(F.count("*").alias("n"), F.bool_and(good).alias("good"), F.min_by(close, day).alias("a"), F.max_by(close, day).alias("b"))
    scored = own.where((F.col("n") == days) & F.col("good")).select(symbol, (F.col("b") / F.col("a") - 1).alias("score"))
    return scored.orderBy(F.desc("score"), symbol).limit(top).withColumn("weight", F.lit(1.0 / top))


def monthly_momentum(bars: DataFrame, factors: DataFrame, calendar: DataFrame, lookback: int, top: int, universe: DataFrame | None = None, every: str = "month") -> DataFrame:
    """(day, symbol, score, weight) at the last session of each month (or week): the `top` symbols by return over exactly
    `lookback` sessions, prices adjusted by the day's factor.

    bars: day, symbol, close; factors: day, symbol, factor; calendar: the open days. A symbol needs a good close and factor on
    each of the lookback + 1 sessions. universe: (day, symbol) that may be chosen. Ties go to the smaller symbol; weights are
    equal. All months are one job: windows by symbol, then the first of each month.
    """
    from tidegauge.operators.backtest import period_ends

    numbered = calendar.select("day").distinct().withColumn("_i", F.row_number().over(Window.orderBy("day")))  # a row a session
    ends = period_ends(calendar.select("day").distinct(), "day", every)
    price = F.col("close") * F.col("factor")
    own = bars.join(factors, ["day", "symbol"], "left").join(F.broadcast(numbered), "day").withColumn("_p", F.when((F.col("close") > 0) & ~F.isnan("close") & (F.col("factor") > 0), price))
    order = Window.partitionBy("symbol").orderBy("_i")
    window = order.rangeBetween(-lookback, 0)
    scored = own.withColumns({"_n": F.count("_p").over(window), "_first": F.first("_p").over(window), "_at": F.min("_i").over(window)})
    good = scored.where((F.col("_n") == lookback + 1) & (F.col("_at") == F.col("_i") - lookback)).join(F.broadcast(ends), "day", "left_semi")
    ranked = good.select("day", "symbol", (F.col("_p") / F.col("_first") - 1).alias("score")).where(~F.isnan("score") & (F.abs("score") < float("inf")))
    ranked = ranked if universe is None else ranked.join(universe, ["day", "symbol"], "left_semi")
    chosen = latest(ranked, ["day"], [F.desc("score"), F.asc("symbol")], top)
    return chosen.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("day")))
