"""Point-in-time views over raw market tables: what was known at an instant, and nothing later.

    view = MarketReader(Catalog(frames)).at("2024-01-31 16:05:00")
    view.market.bars(["600000.SH"], "1d", start="2024-01-01 00:00:00", adjustment="forward").df

Clocks are local wall times without a zone. Ranges are half-open but where a method says otherwise. Results are lazy, and
sorted only when they are handed out whole (sorted, to_pandas, iter_batches).
"""

from __future__ import annotations

import hashlib
import json
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import cached_property
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import fields as payloads
from tidegauge.errors import RequestError, ResultTooLargeError, UnavailableError
from tidegauge.functions.calendar import join_next_session, open_bounds, previous_open, require_reached
from tidegauge.functions.values import at_clock, epoch_micros, is_finite, last_first
from tidegauge.identity import CodeHistory
from tidegauge.operators import bars as ops
from tidegauge.operators import versions

ALL_SYMBOLS = "*"
SYMBOL = re.compile(r"[A-Z0-9][A-Z0-9._-]{1,31}")

# The clock at which a day's rows become visible.
OPENING, AUCTION, DAY_BAR, DAY_METRICS = "09:30", "09:25", "16:05", "17:05"
# Minutes of each intraday frequency and the name it is stored under.
INTRADAY = {"1m": ("1m", 1), "5m": ("5m", 5), "15m": ("15m", 15), "30m": ("30m", 30), "60m": ("1h", 60)}
# Fixed value: the plan state of a dividend that was carried out.
IMPLEMENTED = "实施"
# Fixed value: industries have no history before this instant.
INDUSTRY_FROM = "2021-08-02 09:25:00"
# Factors from vendor units to ratios, shares and currency units.
METRICS = {
    "close": 1, "turnover_rate": 0.01, "turnover_rate_f": 0.01, "volume_ratio": 1, "pe": 1, "pe_ttm": 1, "pb": 1, "ps": 1, "ps_ttm": 1,
    "dv_ratio": 0.01, "dv_ttm": 0.01, "total_share": 1e4, "float_share": 1e4, "free_share": 1e4, "total_mv": 1e4, "circ_mv": 1e4,
}
DIVIDEND = {
    "end_date": "end_date", "ann_date": "ann_date", "div_proc": "div_proc", "stock_dividend": "stk_div", "stock_bonus_rate": "stk_bo_rate",
    "stock_conversion_rate": "stk_co_rate", "cash_dividend": "cash_div", "cash_dividend_before_tax": "cash_div_tax",
}
DIVIDEND_WHEN_DONE = {"record_date": "record_date", "ex_date": "ex_date", "pay_date": "pay_date", "listing_date": "div_listdate", "implementation_ann_date": "imp_ann_date", "base_date": "base_date"}

#: Each logical dataset and the raw table that answers it unless a route says otherwise: minutes and quotes of the running
#: day are downloaded, all else is the vendor's.
TABLES = {
    "daily_bars": "daily", "intraday_bars": "intraday", "current": "ticks", "suspensions": "suspend_d", "price_limits": "stk_limit", "st_status": "stock_st",
    "daily_metrics": "daily_basic", "moneyflow": "moneyflow", "income": "income", "balance_sheet": "balancesheet", "cash_flow": "cashflow",
    "indicators": "fina_indicator", "forecast": "forecast", "express": "express", "audit": "fina_audit", "dividends": "dividend",
    "adjustment_factors": "adj_factor", "industry": "sw_industry", "stocks": "stock_basic", "sessions": "trade_cal",
}
#: The raw table of downloaded daily bars, an alternative route of daily_bars, and that of downloaded dividend events.
DOWNLOADED_DAILY, DOWNLOADED_EVENTS = "downloaded_daily", "dividend_factors"
#: Keys of raw tables that rows of several codes of one security must not share.
UNIQUE = {
    "daily": ["ts_code", "trade_date"], "adj_factor": ["ts_code", "trade_date"], "daily_basic": ["ts_code", "trade_date"], "moneyflow": ["ts_code", "trade_date"],
    "stk_limit": ["ts_code", "trade_date"], "stock_basic": ["ts_code"], DOWNLOADED_DAILY: ["code", "trade_date", "adjustment"],
    "intraday": ["code", "event_time", "period", "adjustment"], DOWNLOADED_EVENTS: ["code", "ex_date"],
}
#: The facts of a stock that the reader uses; names may differ between the rows of one security.
STOCK_FACTS = ["ts_code", "exchange", "market", "curr_type", "list_date", "delist_date"]


@dataclass(frozen=True)
class Catalog:
    """Raw tables by name. failed: tables whose last quality check found errors; they are refused. covered: (table, first
    day, last day) ranges that were read from the source without a gap. download_ranges: the same for downloads, a table
    (dataset, code, period, start_date, end_date)."""

    frames: Mapping[str, DataFrame]
    failed: frozenset[str] = frozenset()
    covered: tuple[tuple[str, str, str], ...] = ()
    download_ranges: DataFrame | None = None

    @classmethod
    def of_store(cls, store, names: list[str] | None = None, **options) -> Catalog:
        """The rows that a store's tables have committed now."""
        return cls({n: store.read(n) for n in names or store.tables}, **options)

    def register_views(self, prefix: str = "") -> list[str]:
        """Temporary SQL views of all tables, typed and empty ones included; their names."""
        for name, df in self.frames.items():
            df.createOrReplaceTempView(prefix + name)
        return sorted(prefix + n for n in self.frames)

    def with_status(self, status: Mapping) -> Catalog:
        """The catalog under a report of the quality check (checks.status): tables with errors are refused, and all of them if
        the report is not about the files that the catalog has."""
        if status.get("snapshot_id") != self.snapshot_id:
            return Catalog(self.frames, frozenset(self.frames), self.covered, self.download_ranges)
        return Catalog(self.frames, self.failed | set(status.get("failed", ())), self.covered, self.download_ranges)

    def table(self, name: str) -> DataFrame:
        if name in self.failed:
            raise UnavailableError(f"{name} failed its last check")
        if name not in self.frames:
            raise UnavailableError(f"no table {name}")
        return self.frames[name]

    def covers(self, name: str, day: str) -> bool:
        return any(n == name and a <= day <= b for n, a, b in self.covered)

    @property
    def snapshot_id(self) -> str:
        """A digest of the files, refusals and ranges that the catalog stands for."""
        files = {n: sorted(d.inputFiles()) for n, d in sorted(self.frames.items())}
        return hashlib.sha256(json.dumps([files, sorted(self.failed), sorted(self.covered)]).encode()).hexdigest()


@dataclass(frozen=True)
class Result:
    """A lazy result, the instant it holds for, the tables it came from and the order that it is handed out in."""

    df: DataFrame
    as_of: str
    sources: tuple[str, ...]
    cap: int
    order: tuple[Column, ...] = ()

    @property
    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.order) if self.order else self.df

    def to_pandas(self):
        """All rows in order. At most one row over the cap is computed before a result is refused; whole results only."""
        out = self.sorted.limit(self.cap + 1).toPandas()
        if len(out) > self.cap:
            raise ResultTooLargeError(f"more than {self.cap} rows")
        return out

    def iter_batches(self, rows: int = 65_536) -> Iterator:
        """Arrow record batches of at most `rows` rows in order, a partition at a time on the driver; a result over the cap is
        refused before the first one."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        ops.capped(self.df, self.cap)
        schema, held = to_arrow_schema(self.df.schema), []
        for row in self.sorted.toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict(recursive=True))
            if len(held) == rows:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class Adapter(ABC):
    """A source of one's own: a route that names it gets its raw tables from here."""

    @abstractmethod
    def table(self, route: str) -> DataFrame:
        """The raw table of a logical dataset, with the columns of the table that answers it by default."""


@dataclass(frozen=True)
class MarketReader:
    """Views over a catalog. routes sends a logical dataset to another raw table of the same columns, or to one of the
    adapters. With a history, symbols are the codes valid at the view's day, rows under other codes are found, and results have
    the security's number as their last column, sid; rows of adapters have no known identities, so the two exclude each other."""

    catalog: Catalog
    routes: Mapping[str, str] = field(default_factory=dict)
    cap: int = 1_000_000
    history: CodeHistory | None = None
    adapters: Mapping[str, Adapter] = field(default_factory=dict)

    def __post_init__(self):
        unknown = set(self.routes) - set(TABLES)
        if unknown:
            raise RequestError(f"unknown routes {sorted(unknown)}")
        if self.cap < 1 or (self.adapters and self.history is not None):
            raise RequestError("a cap is 1 or more, and adapters go without a code history")
        object.__setattr__(self, "routes", MappingProxyType({**TABLES, **self.routes}))

    def at(self, as_of: str) -> View:
        if not re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?", as_of):
            raise RequestError("as_of is `YYYY-MM-DD HH:MM:SS`")
        return View(self, as_of)

    def table(self, route: str, code: str = "ts_code") -> DataFrame:
        """A route's table, under canonical codes if there is a history."""
        name = self.routes[route]
        df = self.adapters[name].table(route) if name in self.adapters else self.catalog.table(name)
        return self.canonical(df, name, code)

    def canonical(self, df: DataFrame, name: str, code: str = "ts_code") -> DataFrame:
        if self.history is None or code not in df.columns:
            return df
        if name == "stock_basic":
            df = df.select(STOCK_FACTS)
        return self.history.canonicalise(df, code, UNIQUE.get(name))

    def implemented_dividends(self, symbols: list[str] | str = ALL_SYMBOLS) -> DataFrame:
        """Every version of the dividends that were carried out, for accounts; not point in time."""
        return self._own(self.table("dividends").where(F.col("div_proc") == IMPLEMENTED).withColumnRenamed("ts_code", "symbol"), symbols)

    def security_lifecycles(self, symbols: list[str] | str = ALL_SYMBOLS) -> DataFrame:
        """(symbol, listing_date, delisting_date), for accounts; not point in time."""
        return self._own(self.table("stocks").select(F.col("ts_code").alias("symbol"), F.col("list_date").alias("listing_date"), F.col("delist_date").alias("delisting_date")).distinct(), symbols)

    def _own(self, df: DataFrame, symbols: list[str] | str) -> DataFrame:
        return df if symbols == ALL_SYMBOLS else df.where(F.col("symbol").isin(self.canonical_symbols(symbols)))

    def canonical_symbols(self, symbols: list[str]) -> list[str]:
        checked = check_symbols(symbols)
        return checked if self.history is None else list(self.history.canonical_symbols(checked))

    def snapshot_metadata(self) -> dict:
        """What results depend on: files, refusals and covered ranges, routes and the code history."""
        return {"snapshot_id": self.catalog.snapshot_id, "tables": sorted(self.catalog.frames), "failed": sorted(self.catalog.failed), "covered": sorted(self.catalog.covered), "routes": dict(self.routes), "code_history": self.history.snapshot_id if self.history else None}


@dataclass(frozen=True)
class View:
    """What was known at as_of."""

    reader: MarketReader
    as_of: str

    @property
    def day(self) -> str:
        return self.as_of[:10]

    @property
    def now(self) -> Column:
        return F.lit(self.as_of).cast("timestamp_ntz")

    @cached_property
    def market(self) -> Market:
        return Market(self)

    @cached_property
    def fundamentals(self) -> Fundamentals:
        return Fundamentals(self)

    @cached_property
    def corporate_actions(self) -> CorporateActions:
        return CorporateActions(self)

    @cached_property
    def classification(self) -> Classification:
        return Classification(self)

    @cached_property
    def reference(self) -> Reference:
        return Reference(self)

    @cached_property
    def calendar(self) -> Calendar:
        return Calendar(self)

    # what all domains share

    def raw(self, route: str, symbols: list[str] | str | None = None, code: str = "ts_code") -> DataFrame:
        """A route's table under the column symbol, restricted to the symbols asked for."""
        return self.restricted(self.reader.table(route, code), symbols, code)

    def restricted(self, df: DataFrame, symbols: list[str] | str | None, code: str) -> DataFrame:
        if code in df.columns:
            df = df.drop("symbol").withColumnRenamed(code, "symbol") if code != "symbol" else df
        return df if symbols is None or symbols == ALL_SYMBOLS else df.where(F.col("symbol").isin(self.reader.canonical_symbols(symbols)))

    @cached_property
    def open_days(self) -> DataFrame:
        """The calendar over all exchanges: a day is open if one of them is."""
        return self.raw("sessions").groupBy("cal_date").agg(F.bool_or(F.col("is_open").cast("boolean")).alias("is_open"))

    @cached_property
    def last_open(self):
        return open_bounds(self.open_days)[1]

    def visible(self, df: DataFrame, clock: str, day: str = "trade_date") -> DataFrame:
        return ops.visible_days(df, self.as_of, clock, day)

    def with_next_session(self, df: DataFrame, day: str, out: str = "visible_at") -> DataFrame:
        """Rows with the opening auction of the session after their day; DataError if the calendar does not reach it for
        any candidate row, shown or not."""
        require_reached(df, day, self.last_open)
        found = join_next_session(df, self.open_days, day, "_next")
        return found.withColumn(out, at_clock(F.col("_next"), AUCTION)).drop("_next").where(F.col(out) <= self.now)

    def result(self, df: DataFrame, routes: list[str], keys: list[str], fields: list[str] | None, order: list[tuple[str, bool]]) -> Result:
        """Identity columns and the fields asked for, in order."""
        if fields is not None:
            payload = [c for c in df.columns if c not in keys]
            if len(set(fields)) < len(fields) or not set(fields) <= set(payload):
                raise RequestError(f"fields are some of {payload}, each once")
        shown = df if fields is None else df.select(*keys, *fields)
        if self.reader.history is not None and "symbol" in keys:
            shown = self.reader.history.relabel(shown, "symbol", self.day, "sid")
        names = set(shown.columns)
        known = [F.col(name).asc_nulls_last() if up else F.col(name).desc_nulls_last() for name, up in order if name in names]
        return Result(shown, self.as_of, tuple(self.reader.routes.get(r, r) for r in routes), self.reader.cap, tuple(known))


def check_symbols(symbols: list[str]) -> list[str]:
    if isinstance(symbols, str) or len(set(symbols)) < len(symbols) or not all(SYMBOL.fullmatch(s) for s in symbols):
        raise RequestError("symbols are ALL_SYMBOLS or a list of different codes")
    return list(symbols)


def between(df: DataFrame, column: str, start: str | None, end: str | None, kind: str = "date") -> DataFrame:
    if start is not None and end is not None and start > end:
        raise RequestError("the range ends before it starts")
    df = df if start is None else df.where(F.col(column) >= F.lit(start).cast(kind))
    return df if end is None else df.where(F.col(column) < F.lit(end).cast(kind))


def sorted_by(time: str, order: str, *rest: str) -> list[tuple[str, bool]]:
    """(column, ascending): the order turns the time only."""
    if order not in ("asc", "desc"):
        raise RequestError("order is asc or desc")
    return [(time, order == "asc"), *((c, True) for c in rest)]


def scaled(column: str, factor: float) -> Column:
    return F.col(column).cast("double") * F.lit(float(factor)) if factor != 1 else F.col(column).cast("double")


PRICES = ["open", "high", "low", "close"]


@dataclass(frozen=True)
class Market:
    view: View

    def bars(self, symbols, frequency: str, count: int | None = None, start: str | None = None, end: str | None = None, fields: list[str] | None = None, adjustment: str = "none", order: str = "asc") -> Result:
        """Complete bars: the last `count` of each symbol, or those that begin in [start, end). A daily bar is visible at
        16:05, an intraday bar when it ends. forward: prices times the day's factor over the latest visible one."""
        if (count is None) == (start is None) or adjustment not in ("none", "forward"):
            raise RequestError("give count or start; adjustment is none or forward")
        v = self.view
        if frequency == "1d":
            downloaded, routes = v.reader.routes["daily_bars"] == DOWNLOADED_DAILY, ["daily_bars"]
            found = self._downloaded_daily(symbols) if downloaded else self._daily(symbols)
        elif frequency in INTRADAY:
            downloaded, found, routes = True, self._intraday(symbols, *INTRADAY[frequency]), ["intraday_bars"]
        else:
            raise RequestError(f"no frequency {frequency!r}")
        found = between(found, "interval_start", start, end, "timestamp_ntz")
        if count is not None:
            found = ops.latest(found, ["symbol"], last_first("interval_end", "interval_start"), count)
        if adjustment == "forward" and downloaded:
            found, routes = self._by_events(found, symbols), [*routes, DOWNLOADED_EVENTS]
        elif adjustment == "forward":
            factors = v.visible(v.raw("adjustment_factors", symbols), AUCTION).select("symbol", F.col("trade_date").alias("_day"), F.col("adj_factor").alias("factor"))
            columns = found.columns
            found = ops.adjust_by_factor(found.withColumn("_day", F.to_date("interval_start")), factors, ["symbol", "_day"], [*PRICES, "pre_close"], check=True).select(*columns)
            routes = [*routes, "adjustment_factors"]
        return v.result(found, routes, ["symbol", "interval_start", "interval_end"], fields, [*sorted_by("interval_end", order, "symbol"), ("interval_start", order == "asc")])

    _TIMES = (("interval_start", OPENING), ("interval_end", "15:00"))

    def _daily(self, symbols) -> DataFrame:
        v = self.view
        times = [at_clock(F.col("trade_date"), clock).alias(name) for name, clock in self._TIMES]
        return v.visible(v.raw("daily_bars", symbols), DAY_BAR).select("symbol", *times, *PRICES, "pre_close", scaled("vol", 100).alias("volume"), scaled("amount", 1000).alias("amount"))

    def _downloaded_daily(self, symbols) -> DataFrame:
        v = self.view
        times = [at_clock(F.col("trade_date"), clock).alias(name) for name, clock in self._TIMES]
        rows = v.visible(v.raw("daily_bars", symbols, "code").where("adjustment = 'none'"), DAY_BAR)
        return rows.select("symbol", *times, *PRICES, F.col("preClose").alias("pre_close"), scaled("volume", 100).alias("volume"), F.col("amount").cast("double").alias("amount"))

    def _by_events(self, found: DataFrame, symbols) -> DataFrame:
        """Prices over the product of the ratios of later dividend events. Events are due on their day from the auction on; bars
        whose events were not downloaded without a gap up to then, or meet a ratio that is not positive, are refused."""
        v = self.view
        anchor = v.day if v.as_of[11:16] >= AUCTION else (date.fromisoformat(v.day) - timedelta(days=1)).isoformat()
        events = v.restricted(v.reader.canonical(v.reader.catalog.table(DOWNLOADED_EVENTS), DOWNLOADED_EVENTS, "code"), symbols, "code")
        columns, day, last = found.columns, F.col("_day"), F.lit(anchor).cast("date")
        dated = found.withColumn("_day", F.to_date("interval_start"))
        days = dated.select("symbol", "_day").distinct().where(day < last)
        ranges = v.reader.catalog.download_ranges
        if ranges is None:
            raise UnavailableError("no download ranges are known")
        ranges = v.restricted(v.reader.canonical(ranges.where((F.col("dataset") == DOWNLOADED_EVENTS) & F.col("period").isNull() & (F.col("end_date") >= last)), "ranges", "code"), symbols, "code")
        known = days.join(ranges.groupBy("symbol").agg(F.min("start_date").alias("since")), "symbol", "left")
        if not known.where(F.col("since").isNull() | (F.col("since") > F.date_add("_day", 1))).isEmpty():
            raise UnavailableError("dividend events were not downloaded for all bars")
        bad = events.where((F.col("ex_date") <= last) & (F.col("dr").isNull() | (F.col("dr") <= 0))).groupBy("symbol").agg(F.max("ex_date").alias("bad"))
        if not days.join(bad, "symbol").where(F.col("bad") > day).isEmpty():
            raise UnavailableError("a dividend event has no positive ratio")
        return ops.adjust_by_events(dated, events.select("symbol", "ex_date", "dr"), "symbol", "_day", [*PRICES, "pre_close"], anchor).select(*columns)

    def _intraday(self, symbols, stored: str, minutes: int) -> DataFrame:
        """Stored instants are ends of intervals; the record of 09:30 is the auction, a quarter of an hour."""
        v = self.view
        rows = v.raw("intraday_bars", symbols, "code").where((F.col("period") == stored) & (F.col("adjustment") == "none") & (F.col("trading_date") <= F.lit(v.day).cast("date")))
        rows = rows.withColumn("interval_end", local_instant("event_time"))
        length = F.when(F.date_format("interval_end", "HH:mm") == OPENING, F.expr("INTERVAL '15' MINUTE")).otherwise(F.expr(f"INTERVAL '{minutes}' MINUTE"))
        return rows.where(F.col("interval_end") <= v.now).select("symbol", (F.col("interval_end") - length).alias("interval_start"), "interval_end", *PRICES, F.col("preClose").alias("pre_close"), scaled("volume", 100).alias("volume"), F.col("amount").cast("double").alias("amount"))

    def current(self, symbols, fields: list[str] | None = None) -> Result:
        """Today's row. Of the vendor's daily table: the open from 09:30 on, the rest of the day from 16:05 on; else the last
        quote that had been received."""
        v = self.view
        if v.reader.routes["current"] == "ticks":
            return self.ticks(symbols, fields)
        today = v.visible(v.raw("current", symbols).where(F.col("trade_date") == F.lit(v.day).cast("date")), OPENING)
        rows = today.select("symbol", at_clock(F.col("trade_date"), OPENING).alias("event_time"), "open", "high", "low", F.col("close").alias("last"), "pre_close", scaled("vol", 100).alias("volume"), scaled("amount", 1000).alias("amount"))
        shown = versions.masked(rows, ["high", "low", "last", "volume", "amount"], at_clock(F.to_date("event_time"), DAY_BAR) <= v.now)
        return v.result(shown, ["current"], ["symbol"], fields, [("symbol", True)])

    def ticks(self, symbols, fields: list[str] | None = None) -> Result:
        """The last quote of today that had been received; of one instant the larger seq."""
        v = self.view
        name = v.reader.routes["current"] if v.reader.routes["current"] in v.reader.adapters else "ticks"
        raw = v.reader.adapters[name].table("current") if name in v.reader.adapters else v.reader.catalog.table(name)
        rows = v.restricted(v.reader.canonical(raw, name, "code"), symbols, "code").where(F.col("trading_date") == F.lit(v.day).cast("date"))
        last = ops.latest(rows.where(local_instant("received_at") <= v.now), ["symbol"], last_first("received_at", "seq"))
        quote = {"open": "open", "high": "high", "low": "low", "lastPrice": "last", "lastClose": "pre_close"}
        volume = F.coalesce(F.col("quote.pvolume").cast("double"), F.col("quote.volume") * 100.0)
        shown = last.select("symbol", local_instant("event_time").alias("event_time"), *[F.col(f"quote.{a}").alias(b) for a, b in quote.items()], volume.cast("double").alias("volume"), F.col("quote.amount").cast("double").alias("amount"))
        return v.result(shown, [name], ["symbol"], fields, [("symbol", True)])

    def status(self, symbols: list[str], fields: list[str] | None = None) -> Result:
        """A row for each symbol: suspended (null if unknown), price limits, special treatment. Needs a list of symbols."""
        if symbols == ALL_SYMBOLS:
            raise RequestError("status needs a list of symbols")
        v, today = self.view, F.col("trade_date") == F.lit(self.view.day).cast("date")
        wanted = set(fields) if fields is not None else {"suspended", "up_limit", "down_limit", "price_limit_status", "st_type"}
        unknown = wanted - {"suspended", "up_limit", "down_limit", "price_limit_status", "st_type"}
        if unknown:
            raise RequestError(f"status has no {sorted(unknown)}")
        spark = next(iter(v.reader.catalog.frames.values())).sparkSession
        out, routes = spark.createDataFrame([(s,) for s in sorted(v.reader.canonical_symbols(symbols))], "symbol string"), []
        if "suspended" in wanted:
            rows = v.raw("suspensions", symbols).where(today).select("symbol", F.col("suspend_type").alias("kind"), F.col("suspend_timing").alias("timing"))
            known = v.as_of[11:16] >= AUCTION and v.reader.catalog.covers(v.reader.routes["suspensions"], v.day)
            out, routes = out.join(versions.suspended(rows, out, "symbol", v.as_of[11:], known), "symbol", "left"), [*routes, "suspensions"]
        if wanted & {"up_limit", "down_limit", "price_limit_status"}:
            limits = v.visible(v.raw("price_limits", symbols).where(today), AUCTION)
            good = is_finite(F.col("up_limit")) & is_finite(F.col("down_limit")) & (F.col("up_limit") > 0) & (F.col("down_limit") > 0) & (F.col("down_limit") <= F.col("up_limit"))
            limits = limits.select("symbol", "up_limit", "down_limit", F.when(good, "limited").otherwise("unknown").alias("_s"))
            out, routes = out.join(limits, "symbol", "left").withColumn("price_limit_status", F.coalesce("_s", F.lit("unknown"))).drop("_s"), [*routes, "price_limits"]
        if "st_type" in wanted:
            st = ops.latest(v.visible(v.raw("st_status", symbols).where(today), AUCTION), ["symbol"], [F.col("type").asc_nulls_last()])
            out, routes = out.join(st.select("symbol", F.coalesce("type_name", "type").alias("st_type")), "symbol", "left"), [*routes, "st_status"]
        return v.result(out, routes, ["symbol"], fields, [("symbol", True)])

    def daily_metrics(self, symbols, start: str, end: str, fields: list[str] | None = None, order: str = "asc") -> Result:
        v = self.view
        rows = between(v.visible(v.raw("daily_metrics", symbols), DAY_METRICS), "trade_date", start, end)
        shown = rows.select("symbol", "trade_date", *[scaled(c, x).alias(c) for c, x in METRICS.items()])
        return v.result(shown, ["daily_metrics"], ["symbol", "trade_date"], fields, sorted_by("trade_date", order, "symbol"))

    def moneyflow(self, symbols, start: str, end: str, fields: list[str] | None = None, order: str = "asc") -> Result:
        """Visible at the next session's opening auction; volumes in shares, amounts in currency units."""
        v = self.view
        rows = v.with_next_session(between(v.raw("moneyflow", symbols), "trade_date", start, end).where("trade_date is not null"), "trade_date")
        sides = [f"{side}_{size}" for size in ("sm", "md", "lg", "elg") for side in ("buy", "sell")]
        flows = [x for s in [*sides, "net_mf"] for x in (scaled(f"{s}_vol", 100).alias(f"{s.removesuffix('_mf')}_volume"), scaled(f"{s}_amount", 1e4).alias(f"{s.removesuffix('_mf')}_amount"))]
        return v.result(rows.select("symbol", "trade_date", *flows), ["moneyflow"], ["symbol", "trade_date"], fields, sorted_by("trade_date", order, "symbol"))


def local_instant(column: str) -> Column:
    """Epoch numbers of any unit as wall time in Shanghai."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.timestamp_micros(epoch_micros(F.col(column))).cast("timestamp_ntz"))


@dataclass(frozen=True)
class Fundamentals:
    view: View

    def statements(self, kind: str, symbols, report_start: str | None = None, report_end: str | None = None, periods: int | None = None, company_type: str | None = None, fields: list[str] | None = None, order: str = "desc") -> Result:
        """The version of each period that stood: the latest final announcement, then announcement, then report type 4 before
        1, then update flag; other report types are left out. `periods` counts a symbol's periods before the company type is
        looked at. Payload columns have public names (fields.py)."""
        if kind not in ("income", "balance_sheet", "cash_flow"):
            raise RequestError(f"no statement {kind!r}")
        if company_type is not None and company_type not in payloads.COMPANY_TYPES.values():
            raise RequestError(f"no company type {company_type!r}")
        v = self.view
        rows = v.raw(kind, symbols).where("end_date is not null and f_ann_date is not null and report_type in ('1', '4')")
        rows = v.with_next_session(between(rows, "end_date", report_start, report_end), "f_ann_date")
        order_by = [*last_first("f_ann_date", "ann_date"), (F.col("report_type") == "4").desc_nulls_last(), F.col("update_flag").try_cast("int").desc_nulls_last()]
        rows = versions.current_versions(rows, ["symbol", "end_date", "comp_type"], order_by)
        rows = rows if periods is None else versions.last_periods(rows, "symbol", "end_date", periods)
        rows = rows.withColumn("company_type", payloads.company_type("comp_type"))
        rows = rows if company_type is None else rows.where(F.col("company_type") == company_type)
        shown = rows.select("symbol", F.col("end_date").alias("period_end"), "visible_at", F.col("ann_date").alias("announcement_date"), F.col("f_ann_date").alias("actual_announcement_date"), "company_type", *self._payload(kind, fields))
        return v.result(shown, [kind], ["symbol", "period_end", "visible_at", "announcement_date", "actual_announcement_date", "company_type"], fields, sorted_by("period_end", order, "symbol", "company_type"))

    @staticmethod
    def _payload(kind: str, fields: list[str] | None) -> list[Column]:
        """Payload columns, only those asked for, so that the scan reads no others."""
        unknown = set(fields or ()) - set(payloads.PAYLOADS[kind])
        if unknown:
            raise RequestError(f"{kind} has no {sorted(unknown)}")
        return payloads.payload(kind, fields)

    def indicators(self, symbols, report_start: str | None = None, report_end: str | None = None, periods: int | None = None, fields: list[str] | None = None, order: str = "desc") -> Result:
        v = self.view
        rows = v.with_next_session(between(v.raw("indicators", symbols).where("end_date is not null and ann_date is not null"), "end_date", report_start, report_end), "ann_date")
        rows = versions.current_versions(rows, ["symbol", "end_date"], [*last_first("ann_date"), F.col("update_flag").try_cast("int").desc_nulls_last()])
        rows = rows if periods is None else versions.last_periods(rows, "symbol", "end_date", periods)
        shown = rows.select("symbol", F.col("end_date").alias("period_end"), "visible_at", F.col("ann_date").alias("announcement_date"), *self._payload("indicators", fields))
        return v.result(shown, ["indicators"], ["symbol", "period_end", "visible_at", "announcement_date"], fields, sorted_by("period_end", order, "symbol"))

    def disclosures(self, kind: str, symbols, visible_start: str | None = None, visible_end: str | None = None, fields: list[str] | None = None, order: str = "asc") -> Result:
        """The latest version of each period among those that became visible in the closed window."""
        if kind not in ("forecast", "express", "audit"):
            raise RequestError(f"no disclosure {kind!r}")
        v = self.view
        rows = closed(v.with_next_session(v.raw(kind, symbols).where("end_date is not null and ann_date is not null"), "ann_date"), visible_start, visible_end)
        flag = [F.col("update_flag").try_cast("int").desc_nulls_last()] if kind != "audit" else []
        rows = versions.current_versions(rows, ["symbol", "end_date"], [*last_first("ann_date"), *flag])
        shown = rows.select("symbol", "visible_at", F.col("end_date").alias("period_end"), F.col("ann_date").alias("announcement_date"), *self._payload(kind, fields))
        return v.result(shown, [kind], ["symbol", "visible_at", "period_end", "announcement_date"], fields, sorted_by("visible_at", order, "symbol", "period_end", "announcement_date"))


def closed(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    df = df if start is None else df.where(F.col("visible_at") >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.where(F.col("visible_at") <= F.lit(end).cast("timestamp_ntz"))


@dataclass(frozen=True)
class CorporateActions:
    view: View

    def dividends(self, symbols, visible_start: str | None = None, visible_end: str | None = None, fields: list[str] | None = None, order: str = "asc") -> Result:
        """All versions that were visible in the closed window. Dates of the payment are null until it is carried out."""
        v, done = self.view, F.col("div_proc") == IMPLEMENTED
        rows = v.raw("dividends", symbols).withColumn("_announced", F.when(done, F.col("imp_ann_date")).otherwise(F.col("ann_date")))
        rows = closed(v.with_next_session(rows.where(F.col("_announced") < F.lit(v.day).cast("date")), "_announced"), visible_start, visible_end)
        later = [F.when(done, F.col(raw)).alias(name) for name, raw in DIVIDEND_WHEN_DONE.items()]
        shown = rows.select("symbol", "visible_at", *[F.col(raw).alias(name) for name, raw in DIVIDEND.items()], *later, F.when(done, scaled("base_share", 1e4)).alias("base_share"))
        keys = ["symbol", "visible_at", "ex_date", "end_date", "ann_date", "div_proc", "implementation_ann_date"]
        return v.result(shown, ["dividends"], keys, fields, sorted_by("visible_at", order, "symbol", "ex_date", "end_date", "ann_date", "div_proc", "implementation_ann_date"))

    def adjustment_factors(self, symbols, start: str | None = None, end: str | None = None, fields: list[str] | None = None, order: str = "asc") -> Result:
        v = self.view
        rows = between(v.visible(v.raw("adjustment_factors", symbols), AUCTION), "trade_date", start, end)
        return v.result(rows.select("symbol", "trade_date", F.col("adj_factor").alias("factor")), ["adjustment_factors"], ["symbol", "trade_date"], fields, sorted_by("trade_date", order, "symbol"))


@dataclass(frozen=True)
class Classification:
    view: View

    def industry(self, symbols, level: int = 1, fields: list[str] | None = None) -> Result:
        if level not in (1, 2, 3):
            raise RequestError("level is 1, 2 or 3")
        v = self.view
        if v.as_of < INDUSTRY_FROM:
            raise UnavailableError(f"no industries before {INDUSTRY_FROM}")
        rows = v.visible(v.raw("industry", symbols), AUCTION, "in_date").where(F.col("out_date").isNull() | (F.col("out_date") > F.lit(v.day).cast("date")))
        rows = ops.latest(rows, ["symbol"], last_first("in_date"))
        shown = rows.select("symbol", F.lit(level).cast("byte").alias("level"), F.col(f"l{level}_code").alias("industry_code"), F.col(f"l{level}_name").alias("industry_name"))
        return v.result(shown, ["industry"], ["symbol"], fields, [("symbol", True)])


@dataclass(frozen=True)
class Reference:
    view: View

    def stocks(self, exchange: str | None = None, market: str | None = None, currency: str | None = "CNY", fields: list[str] | None = None) -> Result:
        v = self.view
        rows = v.visible(v.raw("stocks"), AUCTION, "list_date").where(F.col("delist_date").isNull() | (F.lit(v.day).cast("date") < F.col("delist_date")))
        for column, x in (("exchange", exchange), ("market", market), ("curr_type", currency)):
            rows = rows if x is None else rows.where(F.col(column) == x)
        shown = rows.select("symbol", "exchange", "market", F.col("curr_type").alias("currency"), F.col("list_date").alias("listing_date")).distinct()
        return v.result(shown, ["stocks"], ["symbol"], fields, [("symbol", True)])


@dataclass(frozen=True)
class Calendar:
    view: View

    def sessions(self, start: str, end: str | None = None, exchange: str | None = None, fields: list[str] | None = None, order: str = "asc") -> Result:
        v = self.view
        rows = between(v.raw("sessions").where(F.col("cal_date") <= F.lit(v.day).cast("date")), "cal_date", start, end)
        rows = rows if exchange is None else rows.where(F.col("exchange") == exchange)
        shown = rows.select("cal_date", "exchange", F.col("is_open").cast("boolean").alias("is_open"), F.col("pretrade_date").alias("previous_session"))
        return v.result(shown, ["sessions"], ["cal_date", "exchange"], fields, sorted_by("cal_date", order, "exchange"))

    def previous_session(self, exchange: str = "SSE"):
        """The last open day before today, None if there is none."""
        return previous_open(self.view.raw("sessions").where(F.col("exchange") == exchange), self.view.day).first()[0]
