"""Raw market tables made from the driver's tables: what a store of vendor and downloaded data would hold.

events stand for quotes of symbols U<user_id>, orders for reports of symbols C<custkey>. Tables are made when they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import fields
from tidegauge.plans.market import _bars, _history, _read, _suspensions
from tidegauge.reader import IMPLEMENTED, Catalog, MarketReader

CODE = "'U' || user_id"
#: Routes to the vendor's daily table where a quote of the running day is not meant.
DAILY = {"current": "daily"}


class Tables(Mapping):
    """Tables by name, made on demand."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self):
        return iter(self.makers)

    def __len__(self):
        return len(self.makers)


def _others(kind: str, *own: str) -> list[str]:
    """Null columns for the raw columns of a report that the stand-in has no values for."""
    named = {x.split()[-1] for x in own}
    raw = [*fields.PAYLOADS[kind].values(), *(fields.STAND_INS.values() if kind == "balance_sheet" else ())]
    return [*own, *[f"cast(null as double) {c}" for c in dict.fromkeys(raw) if c not in named]]


def tables(spark: SparkSession, d: str) -> Tables:
    def bars() -> DataFrame:
        return _bars(spark, d).selectExpr(f"{CODE} ts_code", "day trade_date", "open", "high", "low", "close", "open pre_close", "volume vol", "volume * 2 amount")

    def orders() -> DataFrame:
        return _read(spark, d, "orders").selectExpr("'C' || o_custkey ts_code", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "to_date(o_orderdate) day", "to_date(date_trunc('quarter', o_orderdate)) end_date")

    def calendar() -> DataFrame:
        spine = orders().agg(F.explode(F.sequence(F.min("day"), F.date_add(F.max("day"), 10))).alias("cal_date"))
        return spine.selectExpr("'SSE' exchange", "cal_date", "dayofweek(cal_date) between 2 and 6 is_open", "cast(null as date) pretrade_date")

    def report(kind: str, *own: str, key: str = "end_date", extra: tuple[str, ...] = ()) -> DataFrame:
        return orders().selectExpr("ts_code", "end_date", "day ann_date", "cast(o_orderkey as string) update_flag", *extra, *_others(kind, *own))

    def income() -> DataFrame:
        types = ("day f_ann_date", "decode(o_orderkey % 4, 0, '4', 1, '2', '1') report_type", "decode(o_orderstatus, 'F', '1', 'O', '2', '9') comp_type")
        return report("income", "o_totalprice revenue", extra=types)

    def dividend() -> DataFrame:
        rows = orders().selectExpr("ts_code", "end_date", "day ann_date", f"if(o_orderstatus = 'F', '{IMPLEMENTED}', 'plan') div_proc", "date_add(day, 3) imp_ann_date", "o_orderkey / 10 cash_div", "date_add(day, 9) ex_date")
        return rows.selectExpr("*", "cash_div cash_div_tax", "0d stk_div", "0d stk_bo_rate", "0d stk_co_rate", "ex_date record_date", "ex_date pay_date", "ex_date div_listdate", "end_date base_date", "1d base_share")

    def moneyflow() -> DataFrame:
        sides = [f"{side}_{size}" for size in ("sm", "md", "lg", "elg") for side in ("buy", "sell")]
        both = [x for s in [*sides, "net_mf"] for x in (f"cast(o_orderkey % 100 as double) {s}_vol", f"o_totalprice {s}_amount")]
        return orders().selectExpr("ts_code", "day trade_date", *both)

    def metrics() -> DataFrame:
        names = ["turnover_rate", "turnover_rate_f", "volume_ratio", "pe", "pe_ttm", "pb", "ps", "ps_ttm", "dv_ratio", "dv_ttm", "total_share", "float_share", "free_share", "total_mv", "circ_mv"]
        return bars().selectExpr("ts_code", "trade_date", "close", *[f"vol * 1d {n}" for n in names])

    def industry() -> DataFrame:
        rows = orders().where("o_orderkey % 3 = 0").selectExpr("ts_code", "date_add(day, 8766) in_date", "if(o_orderstatus = 'F', null, date_add(day, 9166)) out_date", "o_orderkey")
        levels = [x for n in (1, 2, 3) for x in (f"'{n}' || o_orderkey l{n}_code", f"'name' || o_orderkey l{n}_name")]
        return rows.groupBy("ts_code", "in_date").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("out_date", "o_orderkey").alias("out_date")).selectExpr("ts_code", "in_date", "out_date", *levels)

    def minutes() -> DataFrame:
        rows = _read(spark, d, "events").withColumn("end", F.date_trunc("minute", "ts") + F.expr("INTERVAL '1' MINUTE"))
        one = rows.groupBy("user_id", "end").agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("volume"))
        return one.selectExpr(f"{CODE} code", "'1m' period", "'none' adjustment", "to_date(end + INTERVAL '8' HOUR) trading_date", "unix_millis(cast(end as timestamp)) event_time", "open", "high", "low", "close", "open preClose", "volume", "volume * 10d amount")

    def ticks() -> DataFrame:
        at = "unix_micros(cast(ts as timestamp))"
        quote = "named_struct('open', value, 'high', value, 'low', value, 'lastPrice', value, 'lastClose', value, 'volume', event_id % 50, 'pvolume', if(event_id % 2 = 0, event_id, null), 'amount', value * 3) quote"
        return _read(spark, d, "events").selectExpr(f"{CODE} code", "to_date(ts + INTERVAL '8' HOUR) trading_date", f"{at} event_time", f"{at} received_at", "event_id seq", quote)

    def suspensions() -> DataFrame:
        rows = _read(spark, d, "events").withColumns({"day": F.to_date("ts"), "s": F.expr(CODE)})
        return rows.select("day", "event_id", "s").transform(lambda x: _suspensions(x.withColumn("k", F.struct("s", "day")), "k")).selectExpr("k.s ts_code", "k.day trade_date", "kind suspend_type", "timing suspend_timing")

    def limits() -> DataFrame:
        return bars().selectExpr("ts_code", "trade_date", "if(vol % 3 = 0, double('NaN'), high) up_limit", "if(vol % 5 = 0, high + 1, low) down_limit")

    return Tables({
        "daily": bars, "adj_factor": lambda: bars().selectExpr("ts_code", "trade_date", "1 + (day(trade_date) % 5) * 0.5d adj_factor"),
        "downloaded_daily": lambda: bars().selectExpr("ts_code code", "trade_date", "explode(array('none', 'front')) adjustment", "open", "high", "low", "close", "pre_close preClose", "vol volume", "amount * 1d amount"),
        "dividend_factors": lambda: bars().where("day(trade_date) % 10 = 0").selectExpr("ts_code code", "trade_date ex_date", "2d dr"),
        "intraday": minutes, "ticks": ticks, "suspend_d": suspensions, "stk_limit": limits, "daily_basic": metrics, "moneyflow": moneyflow,
        "stock_st": lambda: bars().where("vol % 4 = 0").selectExpr("ts_code", "trade_date", "explode(array('S2', 'S1')) type", "if(vol % 8 = 0, null, 'warned') type_name"),
        "trade_cal": calendar, "income": income, "dividend": dividend, "sw_industry": industry,
        "balancesheet": lambda: report("balance_sheet", "if(o_orderkey % 2 = 0, o_totalprice, null) oth_rcv_total", "1d oth_receiv", extra=("day f_ann_date", "'1' report_type", "'4' comp_type")),
        "fina_indicator": lambda: report("indicators", "o_totalprice eps", "o_totalprice roe"),
        "forecast": lambda: report("forecast", "o_totalprice net_profit_min", "o_totalprice p_change_min", "o_orderpriority type"),
        "stock_basic": lambda: orders().groupBy("ts_code").agg(F.min("day").alias("list_date"), F.max("day").alias("delist_date")).selectExpr("*", "'SSE' exchange", "'main' market", "'CNY' curr_type"),
    })


def reader(spark: SparkSession, d: str, routes: Mapping[str, str] | None = None, identities: bool = False, **catalog) -> MarketReader:
    return MarketReader(Catalog(tables(spark, d), **catalog), DAILY if routes is None else routes, history=_history(spark, d) if identities else None)
