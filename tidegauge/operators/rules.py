"""Data-quality rules of the raw tables. A table's row rules are one projection: a scan without a shuffle, whatever their number.

Issues are rows (dataset, partition, key, rule, severity, fix, observed, suggested, day): key, observed and suggested are JSON
objects; fix says whether a rule's issue is patched as suggested (AUTO_FIX) or not (MANUAL); day is what to fetch again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.errors import RequestError
from tidegauge.functions.values import is_close, is_finite
from tidegauge.operators.versions import valid_timing

SCHEMA = "dataset string, partition string, key string, rule string, severity string, fix string, observed string, suggested string, day date"
#: Tables with a row for each symbol of each open day.
DENSE = ("daily", "daily_basic", "adj_factor", "stk_limit", "moneyflow")

# Exchanges, and the suffix of their codes; those that a calendar must have.
SUFFIXES = {"SSE": "SH", "SZSE": "SZ", "BSE": "BJ"}
REQUIRED_EXCHANGES = ("SSE", "SZSE")
# States of a dividend plan, and kinds of forecasts.
DIVIDEND_STATES = ("预案", "预披露", "股东大会通过", "股东大会未通过", "实施", "停止实施", "未通过", "其他")
FORECAST_TYPES = ("预增", "预减", "扭亏", "首亏", "续亏", "续盈", "略增", "略减", "不确定", "增亏", "减亏", "其他")
# Columns of daily metrics, and of dividends, that are never negative.
NOT_NEGATIVE = ("close", "turnover_rate", "turnover_rate_f", "volume_ratio", "dv_ratio", "dv_ttm", "total_share", "float_share", "free_share", "total_mv", "circ_mv")
DIVIDEND_NUMBERS = ("stk_div", "stk_bo_rate", "stk_co_rate", "cash_div", "cash_div_tax", "base_share")
INDUSTRY_TEXTS = ("l1_code", "l1_name", "l2_code", "l2_name", "l3_code", "l3_name")


@dataclass(frozen=True)
class Rule:
    """A rule that a row breaks where `broken` is true (null is no breach); shown are the columns observed."""

    id: str
    broken: Column
    shown: tuple[str, ...]
    severity: str = "ERROR"
    fix: str = "MANUAL"
    suggested: Column | None = None


@dataclass(frozen=True)
class Dataset:
    """How a raw table is partitioned and keyed, which floats must be fetched again if they are not finite, the day to fetch
    again for a row (null: unknown), and its row rules."""

    partition: str
    key: tuple[str, ...]
    rules: Callable[[DataFrame], list[Rule]]
    critical: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    refetch: tuple[str, ...] = ()
    checks: tuple[str, ...] = field(default=())


def _number(name: str) -> Column:
    """A column's finite value, else null: what is not finite breaks only the rule on that."""
    x = F.col(name).cast("double")
    return F.when(is_finite(x), x)


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions), F.lit(False))


def _text(name: str) -> Column:
    """Whether a column has more than white space."""
    return F.coalesce(F.col(name).rlike(r"(?U)\S"), F.lit(False))


def _one_of(name: str, values: Iterable[str], null: bool = False) -> Column:
    return F.coalesce(F.col(name).isin(list(values)), F.lit(null) & F.col(name).isNull())


def quarter_end(name: str) -> Column:
    return F.coalesce(F.date_format(name, "MM-dd").isin("03-31", "06-30", "09-30", "12-31"), F.lit(False))


def announced(name: str) -> Column:
    """An announcement on or after the end of its quarter."""
    return quarter_end("end_date") & F.coalesce(F.col(name) >= F.col("end_date"), F.lit(False))


_FLAG = ("0", "1")


def _daily(df: DataFrame) -> list[Rule]:
    names = ("open", "high", "low", "close", "vol", "amount")
    missing = _any(F.col(c).isNull() for c in names)
    o, h, lo, c, v, a = (_number(x) for x in names)
    known = ~missing & ~_any(~is_finite(F.col(x)) for x in names)
    ranged = (F.least(o, h, lo, c) <= 0) | (v < 0) | (a < 0)
    before, change, percent = _number("pre_close"), _number("change"), _number("pct_chg")
    right = is_close(c, F.rint((before + change) * 100) / 100, 1e-9, 0.0051) & is_close(percent, F.try_divide(change, before) * 100, 1e-9, 0.011)
    return [
        Rule("daily_missing_v1", missing, names),
        Rule("daily_range_v1", known & ranged, names),
        Rule("daily_ohlc_v1", known & ~ranged & ((h < F.greatest(o, lo, c)) | (lo > F.least(o, h, c))), names[:4]),
        Rule("daily_volume_amount_v1", known & ((v == 0) != (a == 0)), ("vol", "amount")),
        Rule("daily_range_v1", known & (before <= 0), ("pre_close",)),
        Rule("daily_arithmetic_v1", known & (before > 0) & ~right, ("close", "pre_close", "change", "pct_chg")),
    ]


def _negative(id_: str, names: Iterable[str]) -> list[Rule]:
    return [Rule(id_, _any(_number(c) < 0 for c in names), tuple(names))]


def _stock_basic(df: DataFrame) -> list[Rule]:
    suffix = reduce(lambda out, e: F.when(F.col("exchange") == e, SUFFIXES[e]).otherwise(out), SUFFIXES, F.lit(None).cast("string"))
    same = F.coalesce(F.col("ts_code") == F.concat("symbol", F.lit("."), suffix), F.lit(False))
    status, listed, delisted = F.col("list_status"), F.col("list_date"), F.col("delist_date")
    alive = _one_of("list_status", ("L", "D", "P")) & listed.isNotNull() & ~_any([listed > delisted, (status == "D") & delisted.isNull(), (status == "L") & delisted.isNotNull()])
    return [Rule("stock_basic_identity_v1", ~same, ("ts_code", "symbol", "exchange")), Rule("stock_basic_lifecycle_v1", ~alive, ("list_status", "list_date", "delist_date"))]


def _stk_limit(df: DataFrame) -> list[Rule]:
    up, down, before = _number("up_limit"), _number("down_limit"), _number("pre_close")
    missing = F.col("up_limit").isNull() | F.col("down_limit").isNull()
    wrong = up.isNotNull() & down.isNotNull() & ((down < 0) | (up < down) | F.coalesce((before > 0) & ~((down <= before) & (before <= up)), F.lit(False)))
    whole = F.col("_whole_partition_missing") if "_whole_partition_missing" in df.columns else F.lit(False)
    return [Rule("stk_limit_missing_v1", ~whole & missing, ("up_limit", "down_limit")), Rule("stk_limit_order_v1", ~whole & wrong, ("pre_close", "up_limit", "down_limit"))]


def _suspend_d(df: DataFrame) -> list[Rule]:
    return [Rule("suspend_value_v1", ~_one_of("suspend_type", ("S", "R")) | ~valid_timing(F.col("suspend_timing")), ("suspend_type", "suspend_timing"))]


def _stock_st(df: DataFrame) -> list[Rule]:
    names = ("name", "type", "type_name")
    return [Rule("stock_st_value_v1", _any(~_text(c) for c in names), names)]


def _moneyflow(df: DataFrame) -> list[Rule]:
    return _negative("moneyflow_range_v1", [c for c in df.columns if c.startswith(("buy_", "sell_"))])


def _dividend(df: DataFrame) -> list[Rule]:
    stripped = F.regexp_replace("div_proc", r"(?U)^\s+|\s+$", "")
    known = F.coalesce(stripped.isin(list(DIVIDEND_STATES)), F.lit(False))
    net, gross = _number("cash_div"), _number("cash_div_tax")
    whole, bonus, converted = (_number(c) for c in ("stk_div", "stk_bo_rate", "stk_co_rate"))
    wrong = _any([*(_number(c) < 0 for c in DIVIDEND_NUMBERS), ~known, (gross > 0) & (net > gross + 1e-8)])
    return [
        Rule("dividend_value_v1", known & (stripped != F.col("div_proc")), ("div_proc",), fix="AUTO_FIX", suggested=_values(stripped.alias("div_proc"))),
        Rule("dividend_value_v1", wrong, (*DIVIDEND_NUMBERS, "div_proc")),
        Rule("dividend_stock_ratio_v1", ~is_close(whole, bonus + converted, 1e-9, 1.1e-6), ("stk_div", "stk_bo_rate", "stk_co_rate")),
    ]


def _forecast(df: DataFrame) -> list[Rule]:
    bounds = ("p_change_min", "p_change_max", "net_profit_min", "net_profit_max")
    low, high, least, most = (_number(c) for c in bounds)
    good = _one_of("type", FORECAST_TYPES) & _one_of("update_flag", _FLAG, null=True) & quarter_end("end_date")
    return [Rule("forecast_value_v1", ~good, ("type", "update_flag")), Rule("forecast_range_v1", _any([low > high, least > most]), bounds)]


def _express(df: DataFrame) -> list[Rule]:
    return [Rule("express_value_v1", ~(announced("ann_date") & _one_of("update_flag", _FLAG, null=True)), ("end_date", "ann_date", "update_flag"))]


def _fina_audit(df: DataFrame) -> list[Rule]:
    annual = F.coalesce(F.month("end_date") == 12, F.lit(False))
    wrong = _any([~announced("ann_date"), _number("audit_fees") < 0, annual & ~(_text("audit_result") & _text("audit_agency"))])
    return [Rule("fina_audit_value_v1", wrong, ("end_date", "ann_date", "audit_result", "audit_fees", "audit_agency"), "WARNING")]


def _statement(name: str) -> Callable[[DataFrame], list[Rule]]:
    def rules(df: DataFrame) -> list[Rule]:
        kind = F.when(F.col("report_type").rlike("^[0-9]+$"), F.col("report_type").try_cast("int"))
        good = announced("f_ann_date") & _one_of("update_flag", _FLAG, null=True) & F.coalesce(kind.between(1, 12), F.lit(False)) & _text("comp_type")
        return [Rule(f"{name}_value_v1", ~good, ("end_date", "ann_date", "f_ann_date", "report_type", "comp_type", "update_flag"))]

    return rules


def _fina_indicator(df: DataFrame) -> list[Rule]:
    good, shown = announced("ann_date") & _one_of("update_flag", _FLAG, null=True), ("end_date", "ann_date", "update_flag")
    early = F.coalesce((F.col("ann_date") < F.col("end_date")) & (F.col("update_flag") == "0"), F.lit(False))
    late = early & (F.col("_formal") if "_formal" in df.columns else F.lit(False))
    return [Rule("fina_indicator_value_v1", ~good & late, shown, fix="AUTO_FIX", suggested=F.lit('{"delete":true}')), Rule("fina_indicator_value_v1", ~good & ~late, shown)]


def _sw_industry(df: DataFrame) -> list[Rule]:
    wrong = _any([*(~_text(c) for c in INDUSTRY_TEXTS), ~_one_of("is_new", ("Y", "N")), F.col("out_date") <= F.col("in_date"), (F.col("is_new") == "Y") & F.col("out_date").isNotNull()])
    return [Rule("sw_industry_value_v1", wrong, (*INDUSTRY_TEXTS, "in_date", "out_date", "is_new"), "WARNING")]


def _trade_cal(df: DataFrame) -> list[Rule]:
    good = _one_of("exchange", SUFFIXES) & F.coalesce(F.col("is_open").cast("int").isin(0, 1), F.lit(False))
    return [Rule("trade_calendar_value_v1", ~good, ("exchange", "is_open"))]


_ANNOUNCED = ("ann_date", "f_ann_date")
_PERIOD = ("ts_code", "report_type", "comp_type", "ann_date", "f_ann_date")
#: Every raw table that is checked.
DATASETS = {
    "stock_basic": Dataset("list_date", ("ts_code",), _stock_basic, refetch=("list_date",), checks=("stock_basic_identity_v1", "stock_basic_lifecycle_v1")),
    "daily": Dataset("trade_date", ("ts_code",), _daily, ("open", "high", "low", "close", "pre_close", "vol", "amount"), refetch=("trade_date",), checks=("daily_missing_v1", "daily_range_v1", "daily_ohlc_v1", "daily_arithmetic_v1", "daily_volume_amount_v1")),
    "daily_basic": Dataset("trade_date", ("ts_code",), lambda df: _negative("daily_basic_range_v1", NOT_NEGATIVE), refetch=("trade_date",), checks=("daily_basic_range_v1",)),
    "adj_factor": Dataset("trade_date", ("ts_code",), lambda df: [Rule("adj_factor_positive_v1", F.col("adj_factor").isNull() | (_number("adj_factor") <= 0), ("adj_factor",))], ("adj_factor",), refetch=("trade_date",), checks=("adj_factor_positive_v1", "adj_factor_daily_coverage_v1")),
    "suspend_d": Dataset("trade_date", ("ts_code", "suspend_type", "suspend_timing"), _suspend_d, refetch=("trade_date",), checks=("suspend_value_v1",)),
    "stk_limit": Dataset("trade_date", ("ts_code",), _stk_limit, ("pre_close", "up_limit", "down_limit"), refetch=("trade_date",), checks=("stk_limit_partition_missing_v1", "stk_limit_missing_v1", "stk_limit_order_v1")),
    "stock_st": Dataset("trade_date", ("ts_code", "type"), _stock_st, checks=("stock_st_value_v1",)),
    "moneyflow": Dataset("trade_date", ("ts_code",), _moneyflow, refetch=("trade_date",), checks=("moneyflow_range_v1",)),
    "dividend": Dataset("end_date", ("ts_code", "ann_date", "div_proc", "imp_ann_date"), _dividend, refetch=("imp_ann_date", "ann_date"), checks=("dividend_value_v1", "dividend_stock_ratio_v1")),
    "forecast": Dataset("end_date", ("ts_code", "ann_date"), _forecast, refetch=_ANNOUNCED, checks=("forecast_value_v1", "forecast_range_v1")),
    "express": Dataset("end_date", ("ts_code", "ann_date"), _express, refetch=_ANNOUNCED, checks=("express_value_v1",)),
    "fina_audit": Dataset("end_date", ("ts_code", "ann_date"), _fina_audit, refetch=_ANNOUNCED, checks=("fina_audit_value_v1",)),
    "income": Dataset("end_date", _PERIOD, _statement("income"), refetch=_ANNOUNCED, checks=("income_value_v1",)),
    "balancesheet": Dataset("end_date", _PERIOD, _statement("balancesheet"), refetch=_ANNOUNCED, checks=("balancesheet_value_v1",)),
    "cashflow": Dataset("end_date", _PERIOD, _statement("cashflow"), refetch=_ANNOUNCED, checks=("cashflow_value_v1",)),
    "fina_indicator": Dataset("end_date", ("ts_code", "ann_date"), _fina_indicator, refetch=_ANNOUNCED, checks=("fina_indicator_value_v1",)),
    "sw_industry": Dataset("in_date", ("ts_code",), _sw_industry, refetch=("in_date",), checks=("sw_industry_value_v1",)),
    "trade_cal": Dataset("cal_date", ("exchange",), _trade_cal, required=("exchange", "cal_date", "is_open"), refetch=("cal_date",), checks=("trade_calendar_value_v1", "calendar_exchange_coverage_v1", "calendar_date_coverage_v1", "calendar_pretrade_v1")),
}
#: Rules that every table has; the two of partitions belong to dense tables only.
COMMON = ("dataset_empty_v1", "manifest_v1", "manifest_file_missing_v1", "parquet_read_v1", "schema_v1", "partition_value_v1", "duplicate_key_v1", "required_value_v1", "finite_float_v1")
DENSE_CHECKS = ("missing_market_partition_v1", "closed_market_partition_v1")


def spec(dataset: str) -> Dataset:
    if dataset not in DATASETS:
        raise RequestError(f"no rules for {dataset}")
    return DATASETS[dataset]


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _values(*columns: Column) -> Column:
    return F.to_json(F.struct(F.struct(*columns).alias("values")), {"ignoreNullFields": "false"})


def refetch(day: Column) -> Column:
    """The suggestion to fetch a day again, null where the day is unknown."""
    return F.when(day.isNotNull(), _json(F.lit("REFETCH").alias("action"), day.alias("start_date"), day.alias("end_date")))


def _issue(dataset: str, partition: Column, key: Column, rule: str, severity: str, fix: str, observed: Column, suggested: Column, day: Column) -> Column:
    fields = {"dataset": F.lit(dataset), "partition": partition.cast("string"), "key": key, "rule": F.lit(rule), "severity": F.lit(severity), "fix": F.lit(fix), "observed": observed, "suggested": suggested.cast("string"), "day": day.cast("date")}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _rows(df: DataFrame, dataset: str, rules: list[Rule]) -> DataFrame:
    """Issues of rows: every rule once, in one pass."""
    own = spec(dataset)
    present = [c for c in own.refetch if c in df.columns]
    day = F.coalesce(*[F.col(c).cast("date") for c in present]) if present else F.lit(None).cast("date")
    key = _json(*[F.col(c) for c in (own.partition, *own.key)])
    made = [F.when(r.broken, _issue(dataset, F.col(own.partition), key, r.id, r.severity, r.fix, _json(*[F.col(c) for c in r.shown]), r.suggested if r.suggested is not None else refetch(day), day)) for r in rules]
    if not made:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return df.select(F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("i")).select("i.*")


def common_rules(df: DataFrame, dataset: str) -> list[Rule]:
    """Required values, and floats that are neither null nor finite: critical ones are fetched again, others set to null."""
    own = spec(dataset)
    out = [Rule("required_value_v1", _any(F.col(c).isNull() for c in own.required), own.required)] if own.required else []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = F.col(name).isNotNull() & ~is_finite(F.col(name))
            critical = name in own.critical
            out.append(Rule("finite_float_v1", bad, (name,), fix="MANUAL" if critical else "AUTO_FIX", suggested=None if critical else F.lit(f'{{"values":{{"{name}":null}}}}')))
    return out


def row_issues(df: DataFrame, dataset: str) -> DataFrame:
    """Issues that rows have by themselves, the table's own rules and those of every table."""
    return _rows(df, dataset, [*common_rules(df, dataset), *spec(dataset).rules(df)])


def duplicates(df: DataFrame, dataset: str) -> DataFrame:
    """One issue a key that several rows of a partition share; null values are equal."""
    own = spec(dataset)
    names = [own.partition, *own.key]
    found = df.groupBy(*names).count().where("count > 1")
    return _rows(found, dataset, [Rule("duplicate_key_v1", F.lit(True), ("count",))])


def limit_issues(df: DataFrame) -> DataFrame:
    """Issues of price limits. A partition whose upper or lower limits are all null is one issue, and its rows are no more.
    Partitions are days: their table is broadcast."""
    per = df.groupBy("trade_date").agg(F.count("*").alias("row_count"), (F.count("up_limit") == 0).alias("up"), (F.count("down_limit") == 0).alias("down"))
    gone = per.where("up or down")
    listed = F.filter(F.array(F.when(F.col("up"), "up_limit"), F.when(F.col("down"), "down_limit")), lambda x: x.isNotNull())
    whole = gone.select(_issue("stk_limit", F.col("trade_date"), _json(F.col("trade_date")), "stk_limit_partition_missing_v1", "ERROR", "MANUAL", _json(listed.alias("all_null_fields"), F.col("row_count")), refetch(F.col("trade_date")), F.col("trade_date")).alias("i")).select("i.*")
    marked = df.join(F.broadcast(gone.select("trade_date", F.lit(True).alias("_gone"))), "trade_date", "left").withColumn("_whole_partition_missing", F.coalesce("_gone", F.lit(False))).drop("_gone")
    return whole.unionByName(row_issues(marked, "stk_limit"))


def indicator_issues(df: DataFrame) -> DataFrame:
    """Issues of indicators. A version before the quarter's end with flag 0 is deleted if its period has a formal version."""
    formal = df.where(announced("ann_date") & (F.col("update_flag") == "1")).select("ts_code", "end_date").distinct().withColumn("_f", F.lit(True))
    return row_issues(df.join(formal, ["ts_code", "end_date"], "left").withColumn("_formal", F.coalesce("_f", F.lit(False))).drop("_f"), "fina_indicator")


def table_issues(df: DataFrame, dataset: str) -> DataFrame:
    """All issues that a table has by itself, but those of its files."""
    special = {"stk_limit": limit_issues, "fina_indicator": indicator_issues}
    return (special[dataset](df) if dataset in special else row_issues(df, dataset)).unionByName(duplicates(df, dataset))


def _day_issues(days: DataFrame, dataset: str, rule: str, observed: Column, severity: str = "ERROR", column: str | None = None) -> DataFrame:
    """An issue for each row of days (day)."""
    name = column or spec(dataset).partition
    d = F.col("day")
    return days.select(_issue(dataset, d, _json(d.alias(name)), rule, severity, "MANUAL", observed, refetch(d), d).alias("i")).select("i.*")


def open_days(calendar: DataFrame, through: str, start: str | None = None) -> DataFrame:
    """(day) on which any exchange is open, up to `through`."""
    days = calendar.where((F.col("is_open").cast("int") == 1) & (F.col("cal_date") <= F.lit(through).cast("date"))).select(F.col("cal_date").alias("day"))
    return (days if start is None else days.where(F.col("day") >= F.lit(start).cast("date"))).distinct()


def observed_days(df: DataFrame, dataset: str, through: str, start: str | None = None) -> DataFrame:
    """(day) of the partitions that a table has within the range."""
    days = df.select(F.col(spec(dataset).partition).alias("day")).where(F.col("day") <= F.lit(through).cast("date"))
    return (days if start is None else days.where(F.col("day") >= F.lit(start).cast("date"))).distinct()


def market_days(df: DataFrame, calendar: DataFrame, dataset: str, through: str, start: str | None = None) -> DataFrame:
    """Of a dense table: open days from its first one (or start) on that it lacks, and closed days that it has. Without a known
    open day nothing is said."""
    opened, actual = open_days(calendar, through, start), observed_days(df, dataset, through, start)
    if opened.isEmpty():
        return df.sparkSession.createDataFrame([], SCHEMA)
    first = F.lit(actual.agg(F.min("day")).first()[0] if start is None else start).cast("date")  # null: no partition at all
    missing = opened.where(F.col("day") >= first).join(actual, "day", "left_anti")
    closed = actual.join(opened, "day", "left_anti")
    a = _day_issues(closed, dataset, "closed_market_partition_v1", F.lit('{"calendar":"closed","partition":"present"}'))
    return a.unionByName(_day_issues(missing, dataset, "missing_market_partition_v1", F.lit('{"partition":"missing"}')))


def calendar_exchanges(calendar: DataFrame) -> DataFrame:
    """Days that lack a required exchange."""
    per = calendar.where("cal_date is not null").groupBy(F.col("cal_date").alias("day")).agg(*[F.count_if(F.col("exchange") == e).alias(e) for e in REQUIRED_EXCHANGES])
    missing = F.filter(F.array(*[F.when(F.col(e) == 0, e) for e in REQUIRED_EXCHANGES]), lambda x: x.isNotNull())
    return _day_issues(per.withColumn("missing", missing).where(F.size("missing") > 0), "trade_cal", "calendar_exchange_coverage_v1", _json(F.col("missing").alias("missing_exchanges")))


def calendar_days(calendar: DataFrame, through: str, start: str | None = None) -> DataFrame:
    """Natural days from the calendar's first one (or start) to `through` that it lacks."""
    seen = observed_days(calendar, "trade_cal", through, start)
    lower = F.min("day") if start is None else F.when(F.count("*") > 0, F.lit(start).cast("date"))
    spine = seen.agg(lower.alias("a")).where(F.col("a") <= F.lit(through).cast("date")).select(F.explode(F.sequence("a", F.lit(through).cast("date"))).alias("day"))
    return _day_issues(spine.join(seen, "day", "left_anti"), "trade_cal", "calendar_date_coverage_v1", F.lit('{"partition":"missing"}'))


def calendar_pretrade(calendar: DataFrame, through: str, start: str | None = None) -> DataFrame:
    """Rows whose pretrade_date is not the exchange's last open day before. An exchange has a row a day, so its window is
    bounded by the years covered."""
    known = calendar.where(F.col("exchange").isin(list(SUFFIXES)) & (F.col("cal_date") <= F.lit(through).cast("date")))
    opened = F.when(F.col("is_open").cast("int") == 1, F.col("cal_date"))
    dated = known.withColumn("_opened", opened).groupBy("exchange", "cal_date").agg(F.max("_opened").alias("_opened"))
    last = F.max("_opened").over(Window.partitionBy("exchange").orderBy("cal_date").rowsBetween(Window.unboundedPreceding, -1))
    expected = dated.withColumn("_expected", last).select("exchange", "cal_date", "_expected")
    rows = known.join(expected, ["exchange", "cal_date"])
    wrong = F.col("_expected").isNotNull() & ~F.col("pretrade_date").eqNullSafe(F.col("_expected"))
    if start is not None:
        wrong = wrong & (F.col("cal_date") >= F.lit(start).cast("date"))
    return _rows(rows, "trade_cal", [Rule("calendar_pretrade_v1", wrong, ("is_open", "pretrade_date"), "WARNING")])


def samples(found: DataFrame, group: list[str], value: str, n: int = 10) -> DataFrame:
    """(group, count, samples): how many rows each group has, and its n smallest different values, of which each task keeps n."""
    order = Window.partitionBy(*group).orderBy(value)
    small = found.select(*group, value).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    listed = small.groupBy(*group).agg(F.array_sort(F.collect_list(value)).alias("samples"))
    return found.groupBy(*group).agg(F.count("*").alias("count")).join(listed, group)


def factor_coverage(daily: DataFrame, factors: DataFrame) -> DataFrame:
    """An issue for each day on which symbols have a daily row and no factor: how many, and the first ten."""
    keys = ["trade_date", "ts_code"]
    lost = daily.where("ts_code is not null").select(*keys).distinct().join(factors.select(*keys).distinct(), keys, "left_anti")
    per = samples(lost, ["trade_date"], "ts_code").withColumnRenamed("trade_date", "day")
    return _day_issues(per, "adj_factor", "adj_factor_daily_coverage_v1", _json(F.col("count"), F.col("samples")))


def issue_id(found: DataFrame) -> DataFrame:
    """found with issue_id, which depends on what the issue says, not on when it was found."""
    digest = F.substring(F.sha2(F.concat_ws("\n", "dataset", "key", "observed", "rule"), 256), 1, 20)
    return found.withColumn("issue_id", F.concat_ws(":", "dataset", "rule", digest))
