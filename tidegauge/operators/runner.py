"""Runs from a catalog: the bars that accounts trade on, monthly momentum, results on disk and what they came from."""

from __future__ import annotations

import hashlib
import inspect
import json
import platform
import subprocess
from collections.abc import Mapping
from dataclasses import asdict, dataclass, is_dataclass
from datetime import UTC, date, datetime, time
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.errors import DataError, RequestError
from tidegauge.functions.values import at_clock
from tidegauge.operators import actions, bars, trading, versions
from tidegauge.operators import backtest as bt
from tidegauge.operators.clock import Hours
from tidegauge.operators.universe import EXCHANGES
from tidegauge.reader import MarketReader


def open_sessions(reader: MarketReader, exchange: str = "SSE") -> list[date]:
    """The open days of an exchange: a row a day."""
    rows = reader.table("sessions").where((F.col("exchange") == exchange) & (F.col("is_open").cast("int") == 1)).select("cal_date").distinct().orderBy("cal_date").collect()
    return [r[0] for r in rows]


def market_bars(reader: MarketReader, start: str, end: str, hours: Hours | None = None) -> DataFrame:
    """Daily bars (day, at, start, symbol, open, close, volume, up_limit, down_limit, suspended) as a broker sees them at the
    open: limits of the day, and the state of suspension then; unknown (null) on days whose suspensions are not covered."""
    hours = hours or Hours()
    between = lambda df: df.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    rows = between(reader.table("daily_bars")).select("trade_date", "ts_code", "open", "close", (F.col("vol") * 100.0).alias("volume"))
    limits = between(reader.table("price_limits")).select("trade_date", "ts_code", "up_limit", "down_limit")
    key = F.struct("ts_code", "trade_date")
    halts = between(reader.table("suspensions")).select(key.alias("k"), F.col("suspend_type").alias("kind"), F.col("suspend_timing").alias("timing"))
    state = versions.suspended(halts, halts.select("k").distinct(), "k", hours.segments[0][0] + ":00").select("k.*", "suspended", F.lit(True).alias("_told"))
    ranges = [(a, b) for n, a, b in reader.catalog.covered if n == reader.routes["suspensions"]]
    covered = F.lit(False)
    for a, b in ranges:
        covered = covered | F.col("trade_date").between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    keys = ["ts_code", "trade_date"]
    joined = rows.join(limits, keys, "left").join(state, keys, "left")
    halted = F.when(F.col("_told"), F.col("suspended")).when(covered, False)
    day = F.col("trade_date")
    return joined.select(day.alias("day"), at_clock(day, hours.daily_at).alias("at"), at_clock(day, hours.segments[0][0]).alias("start"), F.col("ts_code").alias("symbol"), "open", "close", "volume", "up_limit", "down_limit", halted.alias("suspended"))


def universe_by_day(reader: MarketReader, days: list[date], sessions: list[date], minimum_sessions: int = 0, exclude_st: bool = True, symbols: list[str] | None = None) -> DataFrame:
    """(day, symbol) of the stocks that may be chosen on each of some days, as universe.stock_universe has it for one."""
    spark = reader.table("stocks").sparkSession
    since = []
    for d in days:
        known = [s for s in sessions if s <= d]
        since.append((d, known[-minimum_sessions] if 0 < minimum_sessions <= len(known) else (d if minimum_sessions == 0 else None)))
    ends = spark.createDataFrame(since, "day date, latest date")
    stocks = reader.table("stocks").where((F.col("curr_type") == "CNY") & F.col("exchange").isin(list(EXCHANGES)))
    stocks = stocks if symbols is None else stocks.where(F.col("ts_code").isin(symbols))
    listed = (F.col("list_date") <= F.col("latest")) & (F.col("delist_date").isNull() | (F.col("day") < F.col("delist_date")))
    out = stocks.join(F.broadcast(ends), listed).select("day", F.col("ts_code").alias("symbol")).distinct()
    if exclude_st:
        treated = reader.table("st_status").where(F.coalesce("type_name", "type").isNotNull()).select(F.col("trade_date").alias("day"), F.col("ts_code").alias("symbol")).distinct()
        out = out.join(treated, ["day", "symbol"], "left_anti")
    return out


@dataclass(frozen=True)
class Momentum:
    """Return over `lookback` sessions; the `top` symbols of those listed for minimum_sessions, none with special treatment."""

    lookback: int = 20
    top: int = 10
    minimum_sessions: int = 60
    exclude_st: bool = True

    def __post_init__(self):
        if self.lookback < 1 or self.top < 1 or self.minimum_sessions < 0:
            raise RequestError("a lookback and a number of symbols are 1 or more")


def momentum_targets(reader: MarketReader, rule: Momentum, start: str, end: str, symbols: list[str] | None = None) -> DataFrame:
    """(run, day, symbol, weight) at each month's last session in [start, end]; a month without a choice sells everything."""
    sessions = open_sessions(reader)
    spark = reader.table("stocks").sparkSession
    inside = [s for s in sessions if start <= s.isoformat() <= end]
    following = dict(zip(sessions, sessions[1:], strict=False))
    if inside and inside[-1] not in following:
        raise DataError(f"the calendar does not say what follows {inside[-1]}")
    ends = [s for s in inside if (s.year, s.month) != (following[s].year, following[s].month)]
    short = [s for s in ends if sessions.index(s) < rule.lookback]
    if short:
        raise DataError(f"the calendar has fewer than {rule.lookback + 1} sessions up to {short[0]}")
    first = sessions[max(0, sessions.index(inside[0]) - rule.lookback)] if inside else None
    daily = reader.table("daily_bars").where(F.col("trade_date").between(F.lit(first).cast("date"), F.lit(end).cast("date"))).select(F.col("trade_date").alias("day"), F.col("ts_code").alias("symbol"), "close")
    factors = reader.table("adjustment_factors").select(F.col("trade_date").alias("day"), F.col("ts_code").alias("symbol"), F.col("adj_factor").alias("factor"))
    calendar = spark.createDataFrame([(s,) for s in sessions], "day date")
    may = universe_by_day(reader, ends, sessions, rule.minimum_sessions, rule.exclude_st, symbols)
    chosen = bars.monthly_momentum(daily, factors, calendar, rule.lookback, rule.top, may)
    every = spark.createDataFrame([(s,) for s in ends], "day date")
    return every.join(chosen, "day", "left").select(F.lit("momentum").alias("run"), "day", "symbol", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def run_momentum(reader: MarketReader, start: str, end: str, rule: Momentum | None = None, config: bt.Config | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Rows (backtest.SCHEMA) of one run of monthly momentum over the catalog, with dividends and delistings."""
    rule, config = rule or Momentum(), config or bt.Config()
    targets = momentum_targets(reader, rule, start, end, symbols)
    sessions = open_sessions(reader)
    inside = [s for s in sessions if start <= s.isoformat() <= end]
    if not inside:
        raise DataError("no sessions")
    spark = targets.sparkSession
    runs = spark.createDataFrame([("momentum", inside[0], inside[-1])], "run string, first date, last date")
    facts = actions.effective(reader.implemented_dividends()) if "dividend" in reader.catalog.frames else None
    rows = bt.simulate(runs, market_bars(reader, start, end), inside, targets=targets, config=config, actions=facts, lives=reader.security_lifecycles(), calendar=sessions, own_symbols=True)
    # accounts hold securities under the code that stands for them; rows show that of their day
    return rows if reader.history is None else reader.history.relabel_by_day(rows, "symbol", "day")


def run_metadata(reader: MarketReader, strategy: object) -> dict:
    """What a run depends on, as it is before the run: code, strategy and data."""
    kind = strategy if isinstance(strategy, type) else type(strategy)
    source = inspect.getsourcefile(kind)
    found: dict = {}
    for name in ("pyspark", "pandas", "pyarrow", "numpy"):
        try:
            found[name] = version(name)
        except PackageNotFoundError:
            found[name] = None
    try:
        git = lambda *a: subprocess.run(["git", "-C", str(Path(__file__).parent), *a], capture_output=True, text=True, check=True, timeout=10).stdout
        commit, dirty = git("rev-parse", "HEAD").strip(), bool(git("status", "--porcelain"))
    except (OSError, subprocess.SubprocessError):
        commit, dirty = None, None
    parameters = strategy.parameters() if hasattr(strategy, "parameters") else asdict(strategy) if is_dataclass(strategy) and not isinstance(strategy, type) else {}
    made = {
        "schema_version": 1, "captured_at": datetime.now(UTC), "code": {"commit": commit, "dirty": dirty, "python": platform.python_version(), "dependencies": found},
        "strategy": {"type": f"{kind.__module__}.{kind.__qualname__}", "parameters": parameters, "schedule": getattr(strategy, "schedule", None), "source_sha256": hashlib.sha256(Path(source).read_bytes()).hexdigest() if source and Path(source).is_file() else None},
        "data": reader.snapshot_metadata(),
    }
    return json.loads(json.dumps(made, default=_plain, allow_nan=False))


def _plain(value):
    if is_dataclass(value) and not isinstance(value, type):
        return asdict(value)
    if isinstance(value, date | datetime | time):
        return value.isoformat()
    raise TypeError(f"{type(value).__name__} cannot be written as JSON")


PARTS = {"orders": "kind = 'submitted'", "order_updates": "kind in ('blocked', 'canceled', 'expired', 'fill')", "fills": "kind = 'fill'", "equity": "kind = 'equity'"}
COLUMNS = {
    "orders": ["run", "order_id", "symbol", "side", "quantity", "at"], "order_updates": ["run", "order_id", "kind", "at", "quantity", "reason"],
    "fills": ["run", "order_id", "symbol", "side", "quantity", "at", "price", "notional", "fee", "slippage"],
    "equity": ["run", "day", "cash", "receivable", "market_value", "equity", "ret", "holdings", "stale"],
}


def write_results(rows: DataFrame, folder: str, config: bt.Config, metadata: Mapping | None = None) -> dict:
    """Orders, their updates, fills and equity as Parquet (an empty one has the same columns), metrics and settings as JSON;
    the metrics, one entry a run."""
    for name, which in PARTS.items():
        rows.where(which).select(COLUMNS[name]).write.option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
    metrics = {r["run"]: {k: v.isoformat() if isinstance(v, date) else v for k, v in r.asDict().items() if k != "run"} for r in trading.run_metrics(rows, config.cash).collect()}  # a row a run
    for r in bt.blocked_reasons(rows).collect():
        metrics[r["run"]].setdefault("blocked_reasons", {})[r["reason"]] = r["n"]
    spark = rows.sparkSession
    for name, value in (("config", asdict(config)), ("metrics", metrics), *([("run_metadata", metadata)] if metadata is not None else [])):
        spark.createDataFrame([(json.dumps(value, default=_plain, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.text(f"{folder}/{name}.json")
    return metrics


def export_csv(df: DataFrame, folder: str, limit: int | None = None) -> None:
    """df as CSV files with a header: fields of structs become columns, lists and maps JSON, dates ISO. limit: at most that many
    rows, if given."""
    if limit is not None and limit < 1:
        raise RequestError("a limit is 1 or more")
    flat = []
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind == "struct":
            flat += [(F.col(f"`{f.name}`.`{x.name}`"), x.dataType.typeName(), f"{f.name}.{x.name}") for x in f.dataType]
        else:
            flat.append((F.col(f"`{f.name}`"), kind, f.name))
    out = df.select(*[(F.to_json(c) if kind in ("array", "map", "struct") else c).alias(name) for c, kind, name in flat])
    (out if limit is None else out.limit(limit)).write.option("header", True).csv(folder)
