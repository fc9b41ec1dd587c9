"""Rows of downloaded histories as store tables: days, minutes, reports and dividend events, and which days of a code are done."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.errors import DataError, RequestError
from tidegauge.functions.values import epoch_micros, is_finite
from tidegauge.sources.ingest import Progress, missing, parse_day, text
from tidegauge.sources.store import Store, TableConfig

# Periods of minute bars, adjustments of bars, and the numbers of a bar, by type.
PERIODS, ADJUSTMENTS = ("1m", "5m", "15m", "30m", "1h"), ("none", "front_ratio")
WHOLE = ("time", "volume", "suspendFlag")
NUMBERS = ("open", "high", "low", "close", "amount", "settelementPrice", "openInterest", "preClose", "dr", "totaldr")
FACTORS = ("interest", "stockBonus", "stockGift", "allotNum", "allotPrice", "gugai", "dr")
_BAR = "time long, open double, high double, low double, close double, volume long, amount double, settelementPrice double, openInterest double, preClose double, suspendFlag long, dr double, totaldr double"


def _config(name: str, schema: str, partition: str, key: tuple[str, ...], prefer: tuple[str, ...] = ()) -> TableConfig:
    return TableConfig(name, StructType.fromDDL(schema), (partition,), key, key, prefer)


def tables() -> dict[str, TableConfig]:
    """The tables of a store of downloads. (A session must be there: it reads the types.)"""
    return {
        "downloaded_daily": _config("downloaded_daily", f"trade_date date, code string, adjustment string, {_BAR}", "trade_date", ("code", "adjustment")),
        "intraday": _config("intraday", f"trading_date date, code string, period string, adjustment string, event_time long, {_BAR}", "trading_date", ("code", "period", "adjustment", "event_time")),
        "financial": _config("financial", "report_date date, code string, dataset string, disclosure_date date, data_json string", "report_date", ("code", "dataset"), ("disclosure_date",)),
        "dividend_factors": _config("dividend_factors", "ex_date date, event_time long, code string, " + ", ".join(f"{c} double" for c in FACTORS), "ex_date", ("code",)),
    }


def index_micros(index: Column) -> Column:
    """The instant of a 14-digit local clock (20240102093000, Shanghai), else of epoch numbers, as microseconds."""
    digits = index.cast("string")
    local = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    instant = F.unix_micros(F.convert_timezone(F.lit("Asia/Shanghai"), F.lit("UTC"), local).cast("timestamp"))
    return F.when(F.length(digits) == 14, F.coalesce(instant, epoch_micros(index))).otherwise(epoch_micros(index))


def day_of(value: Column) -> Column:
    """The day of YYYYMMDD as text or a number, of YYYY-MM-DD, or of an epoch number in Shanghai."""
    digits = F.regexp_replace(F.trim(value.cast("string")), "-", "")
    plain = F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")).cast("date")
    number = digits.try_cast("long")
    epoch = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.timestamp_micros(epoch_micros(number)).cast("timestamp_ntz")))
    return F.when(number.between(19000101, 29991231) | ~digits.rlike("^[0-9]+$"), plain).otherwise(epoch)


def _values(df: DataFrame) -> list[Column]:
    """The numbers of a bar; what is no finite number, or is not there, is null."""
    out = []
    for name in [c.split()[0] for c in _BAR.split(", ")]:
        if name not in df.columns:
            out.append(F.lit(None).cast("long" if name in WHOLE else "double").alias(name))
            continue
        x = F.col(name).cast("double")
        good = F.when(is_finite(x), x)
        out.append((good.cast("long") if name in WHOLE else good).alias(name))
    return out


def _require(df: DataFrame, column: str, what: str) -> DataFrame:
    if not df.where(F.col(column).isNull()).isEmpty():
        raise DataError(f"{what} without {column}")
    return df


def daily_rows(df: DataFrame, adjustment: str) -> DataFrame:
    """Bars (code, index: YYYYMMDD, numbers) as rows of downloaded_daily."""
    if adjustment not in ADJUSTMENTS:
        raise RequestError(f"no adjustment {adjustment!r}")
    return _require(df.select(day_of(F.col("index")).alias("trade_date"), "code", F.lit(adjustment).alias("adjustment"), *_values(df)), "trade_date", "daily bars")


def intraday_rows(df: DataFrame, period: str, adjustment: str) -> DataFrame:
    """Bars (code, index: local clock or epoch, numbers) as rows of intraday."""
    if period not in PERIODS or adjustment not in ADJUSTMENTS:
        raise RequestError(f"no minute bars of {period!r}, {adjustment!r}")
    at = F.coalesce(index_micros(F.col("index")), epoch_micros(F.col("time")) if "time" in df.columns else F.lit(None).cast("long"))
    timed = _require(df.withColumn("event_time", at), "event_time", "minute bars")
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.timestamp_micros("event_time").cast("timestamp_ntz")))
    return timed.select(day.alias("trading_date"), "code", F.lit(period).alias("period"), F.lit(adjustment).alias("adjustment"), "event_time", *_values(df))


def financial_rows(df: DataFrame) -> DataFrame:
    """Reports (code, dataset, index, body as JSON) as rows of financial; the body's own dates go before the index."""
    field = lambda *names: F.coalesce(*[F.get_json_object("body", f"$.{n}") for n in names])
    report = day_of(F.coalesce(field("m_timetag", "endDate"), F.col("index").cast("string")))
    out = df.select(report.alias("report_date"), "code", "dataset", day_of(field("m_anntime", "declareDate")).alias("disclosure_date"), F.col("body").alias("data_json"))
    return _require(out, "report_date", "reports")


def factor_rows(df: DataFrame) -> DataFrame:
    """Dividend events (code, date, time, ratios) as rows of dividend_factors."""
    out = df.select(day_of(F.col("date")).alias("ex_date"), epoch_micros(F.col("time")).alias("event_time"), "code", *[F.col(c).cast("double").alias(c) for c in FACTORS])
    return _require(_require(out, "ex_date", "dividend events"), "event_time", "dividend events")


@dataclass
class DownloadSync:
    """Fetches codes' histories into a store, but for the running day. fetch(codes, start, end) gives the rows of a table; a
    code's range is marked as done once its rows are written."""

    store: Store
    today: Callable[[], date]

    def __post_init__(self):
        self.progress = Progress(self.store)

    def run(self, table: str, codes: Sequence[str], start: str | date, end: str | date, fetch: Callable[[list[str], str, str], DataFrame], period: str | None = None, force: bool = False) -> int:
        """Rows written. Codes that lack the same days are fetched together; with force, days that are done are too."""
        a, b = parse_day(start), min(parse_day(end), self.today() - timedelta(days=1))
        if parse_day(start) > parse_day(end) or not codes or table not in self.store.tables:
            raise RequestError("a table of the store, codes, and a range that does not end before it starts")
        gaps: dict[tuple[date, date], list[str]] = {}
        for c in dict.fromkeys(codes):
            for gap in missing(a, b, [] if force else self.progress.done(self._mark(table, c, period))) if a <= b else []:
                gaps.setdefault(gap, []).append(c)
        total = 0
        for (x, y), own in sorted(gaps.items()):
            rows = fetch(own, text(x), text(y))
            n = rows.count()
            if n:
                self.store.append(table, rows)
                self.store.compact(table, [tuple(r) for r in rows.select(*self.store.tables[table].partition_by).distinct().collect()])
            total += n
            for c in own:
                self.progress.mark(self._mark(table, c, period), x, y)
        return total

    @staticmethod
    def _mark(table: str, code: str, period: str | None) -> str:
        return f"{table}/{period or 'all'}/{code}"

    def ranges(self, table: str, codes: Sequence[str], period: str | None = None) -> DataFrame:
        """What Catalog.download_ranges takes: (dataset, code, period, start_date, end_date)."""
        rows = [(table, c, period, x, y) for c in codes for x, y in self.progress.done(self._mark(table, c, period))]
        return self.store.spark.createDataFrame(rows, "dataset string, code string, period string, start_date date, end_date date")
