"""Which stocks may be chosen at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.errors import DataError
from tidegauge.reader import ALL_SYMBOLS, AUCTION, View

# Exchanges whose stocks count.
EXCHANGES = ("BSE", "SSE", "SZSE")


def stock_universe(view: View, minimum_sessions: int = 0, exclude_st: bool = False, allowed: list[str] | None = None, exchange: str = "SSE") -> DataFrame:
    """(symbol): listed stocks in domestic currency, listed for minimum_sessions sessions (the listing day is the first), and
    without special treatment if exclude_st. A calendar that is too short to tell, and does not reach back to the first
    listing, is a DataError."""
    stocks = view.reference.stocks(fields=["exchange", "listing_date"]).df.where(F.col("exchange").isin(list(EXCHANGES)))
    if allowed is not None:
        names = allowed if view.reader.history is None else [view.reader.history.code_at(view.reader.history.sid(c), _day(view)) for c in allowed]
        stocks = stocks.where(F.col("symbol").isin(names))
    if minimum_sessions > 0:
        days = view.calendar.sessions("0001-01-01", exchange=exchange).df
        last = [r[0] for r in days.where("is_open").orderBy(F.desc("cal_date")).limit(minimum_sessions).select("cal_date").collect()]
        if len(last) < minimum_sessions:
            first, known = stocks.agg(F.min("listing_date")).first()[0], days.agg(F.min("cal_date")).first()[0]
            if first is not None and (known is None or known > first):
                raise DataError(f"the calendar has {len(last)} sessions of {minimum_sessions} and does not reach back to {first}")
            stocks = stocks.limit(0)  # all listings are covered, and none is old enough
        else:
            stocks = stocks.where(F.col("listing_date") <= F.lit(last[-1]).cast("date"))
    if exclude_st:
        treated = view.visible(view.raw("st_status", ALL_SYMBOLS), AUCTION).where(F.col("trade_date") == F.lit(view.day).cast("date")).where(F.coalesce("type_name", "type").isNotNull())
        stocks = stocks.join(treated.select("symbol").distinct(), "symbol", "left_anti")
    return stocks.select("symbol").distinct()


def _day(view: View):
    from datetime import date

    return date.fromisoformat(view.day)
