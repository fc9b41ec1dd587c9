"""Queries of the data-quality rules, each over a raw table with planted faults, beside the SQL of the rules.

A table is a list of expressions over orders that Spark and DuckDB read alike; k numbers the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import detect, rules
from tidegauge.plans.market import _BARS, _CAL, _bars, _calendar, _read, query

_K = "o_orderkey"
_DAY = "CAST(o_orderdate AS DATE)"
_END = "CAST(CASE WHEN o_orderkey % 9 = 0 THEN DATE '1996-05-17' WHEN o_orderkey % 2 = 0 THEN DATE '1996-06-30' ELSE DATE '1996-12-31' END AS DATE)"
_NAN = "CAST('NaN' AS DOUBLE)"
_CODE = "'C' || o_orderkey AS ts_code"
_FLAG = "CASE o_orderkey % 7 WHEN 0 THEN '2' WHEN 1 THEN NULL WHEN 2 THEN '0' ELSE '1' END AS update_flag"
_STATEMENT = [f"{_END} AS end_date", _CODE, f"{_DAY} AS ann_date", f"CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {_DAY} END AS f_ann_date",
              "CASE o_orderkey % 8 WHEN 0 THEN '13' WHEN 1 THEN 'x' WHEN 2 THEN '12' ELSE '1' END AS report_type", "CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE '1' END AS comp_type", _FLAG]

TABLES = {
    "stock_basic": [f"{_DAY} AS list_date", "o_orderkey || '.SH' AS ts_code", "CAST(o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS STRING) AS symbol", "CASE o_orderkey % 5 WHEN 0 THEN 'BSE' WHEN 1 THEN NULL ELSE 'SSE' END AS exchange",
                    "CASE o_orderkey % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'D' WHEN 2 THEN 'P' ELSE 'X' END AS list_status", f"CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE {_DAY} + 3 - CAST(o_orderkey % 7 AS INT) END AS delist_date"],
    "daily": [f"{_DAY} AS trade_date", "'C' || (o_orderkey - CASE WHEN o_orderkey % 50 = 1 AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS ts_code", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS open", "CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice - 5 ELSE o_totalprice + 5 END AS high",
              "o_totalprice - 4 AS low", "CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE o_totalprice END AS close", f"CASE WHEN o_orderkey % 19 = 0 THEN 0 WHEN o_orderkey % 23 = 0 THEN {_NAN} ELSE o_totalprice - 1 END AS pre_close",
              "CASE WHEN o_orderkey % 29 = 0 THEN 1.5D ELSE 1D END AS change", "CASE WHEN o_orderkey % 31 = 0 THEN 9D ELSE 100D / (o_totalprice - 1) END AS pct_chg", f"CASE WHEN o_orderkey % 37 = 0 THEN 0D WHEN o_orderkey % 41 = 0 THEN {_NAN} ELSE 5D END AS vol", "CASE WHEN o_orderkey % 43 = 0 THEN 0D ELSE 7D END AS amount"],
    "daily_basic": [f"{_DAY} AS trade_date", _CODE, *[f"CASE WHEN o_orderkey % {10 + i} = 0 THEN -1D WHEN o_orderkey % 97 = {i} THEN {_NAN} ELSE 1D END AS {c}" for i, c in enumerate(rules.NOT_NEGATIVE)]],
    "adj_factor": [f"{_DAY} AS trade_date", _CODE, f"CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 0D WHEN 2 THEN {_NAN} ELSE 1D END AS adj_factor"],
    "stk_limit": [f"{_DAY} AS trade_date", _CODE, "CASE WHEN o_orderkey % 7 = 0 THEN 50D ELSE 10D END AS pre_close", f"CASE WHEN dayofmonth(o_orderdate) = 9 OR o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN {_NAN} ELSE 11D END AS up_limit", "CASE WHEN o_orderkey % 9 = 0 THEN -1D WHEN o_orderkey % 10 = 0 THEN 12D ELSE 9D END AS down_limit"],
    "suspend_d": [f"{_DAY} AS trade_date", _CODE, "CASE o_orderkey % 5 WHEN 0 THEN 'X' WHEN 1 THEN 'R' ELSE 'S' END AS suspend_type", "CASE o_orderkey % 6 WHEN 0 THEN '9:30-9:40' WHEN 1 THEN '9:40-9:30' WHEN 2 THEN '9:30:15 - 10:00, 13:00-24:00' WHEN 3 THEN ' 9:30:15 - 10:00, 13:00-14:00' ELSE NULL END AS suspend_timing"],
    "stock_st": [f"{_DAY} AS trade_date", _CODE, "CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE 'ST' END AS type", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'n' END AS name", "'t' AS type_name"],
    "moneyflow": [f"{_DAY} AS trade_date", _CODE, *[f"CASE WHEN o_orderkey % {20 + i} = 0 THEN -1D ELSE 1D END AS {s}_{z}_vol" for i, (s, z) in enumerate((s, z) for z in ("sm", "md", "lg", "elg") for s in ("buy", "sell"))], "-5D AS net_mf_vol"],
    "dividend": [f"{_END} AS end_date", _CODE, f"{_DAY} AS ann_date", "CASE o_orderkey % 6 WHEN 0 THEN ' 实施 ' WHEN 1 THEN 'other' WHEN 2 THEN NULL ELSE '预案' END AS div_proc", f"CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} END AS imp_ann_date",
                 "0.3D AS stk_div", "0.1D AS stk_bo_rate", "CASE WHEN o_orderkey % 7 = 0 THEN 0.1D ELSE 0.2D END AS stk_co_rate", "CASE WHEN o_orderkey % 11 = 0 THEN 2D ELSE 1D END AS cash_div", "CASE WHEN o_orderkey % 22 = 0 THEN 0D ELSE 1D END AS cash_div_tax", "CASE WHEN o_orderkey % 13 = 0 THEN -1D ELSE 1D END AS base_share"],
    "forecast": [f"{_END} AS end_date", _CODE, f"{_DAY} AS ann_date", "CASE o_orderkey % 5 WHEN 0 THEN '预增' WHEN 1 THEN 'other' ELSE '减亏' END AS type", _FLAG, "1D AS p_change_min", "CASE WHEN o_orderkey % 11 = 0 THEN 0D ELSE 2D END AS p_change_max", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 1D END AS net_profit_min", "CASE WHEN o_orderkey % 3 = 0 THEN 0D ELSE 2D END AS net_profit_max"],
    "express": [f"{_END} AS end_date", _CODE, f"{_DAY} AS ann_date", _FLAG],
    "fina_audit": [f"{_END} AS end_date", _CODE, f"{_DAY} AS ann_date", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'fine' END AS audit_result", "CASE WHEN o_orderkey % 11 = 0 THEN -1D ELSE 1D END AS audit_fees", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'firm' END AS audit_agency"],
    "income": _STATEMENT, "balancesheet": _STATEMENT, "cashflow": _STATEMENT,
    "fina_indicator": ["DATE '1998-06-30' AS end_date", "'C' || o_custkey AS ts_code", f"{_DAY} AS ann_date", "CASE WHEN o_orderkey % 7 = 0 THEN '2' WHEN o_orderkey % 3 = 0 THEN '1' ELSE '0' END AS update_flag"],
    "sw_industry": [f"{_DAY} AS in_date", _CODE, *[f"CASE WHEN o_orderkey % {15 + i} = 0 THEN ' ' ELSE 'x' END AS {c}" for i, c in enumerate(rules.INDUSTRY_TEXTS)], f"CASE o_orderkey % 4 WHEN 0 THEN {_DAY} WHEN 1 THEN {_DAY} + 9 ELSE NULL END AS out_date", "CASE o_orderkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'maybe' ELSE 'N' END AS is_new"],
}


def _table(spark, d, name: str) -> DataFrame:
    return _read(spark, d, "orders").selectExpr(*TABLES[name])


def _sql(name: str, found: str) -> str:
    """found, over the rows r and their key as JSON."""
    own, cols = rules.DATASETS[name], ", ".join(TABLES[name]).replace("AS STRING", "AS VARCHAR")
    for n in range(10):
        cols = cols.replace(f"{n}D ", f"{n}::DOUBLE ").replace(f"{n}D)", f"{n}::DOUBLE)")
    key = " || ',' || ".join(f"'\"{c}\":' || coalesce('\"' || CAST({c} AS VARCHAR) || '\"', 'null')" for c in (own.partition, *own.key))
    return f"WITH t AS (SELECT {cols} FROM orders), r AS (SELECT *, '{{' || {key} || '}}' AS key FROM t) {found}"


def _rule(rule: str, broken: str, severity: str = "ERROR", fix: str = "MANUAL", source: str = "r") -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, '{fix}' AS fix, key FROM {source} WHERE {broken}"


def _nan(*names: str, critical: bool = False) -> list[str]:
    return [_rule("finite_float_v1", f"NOT isfinite({c})", fix="MANUAL" if critical else "AUTO_FIX") for c in names]


def _shown(found: DataFrame) -> DataFrame:
    return found.select("rule", "severity", "fix", "key")


def _register(name: str, *parts: str) -> None:
    sql = _sql(name, " UNION ALL ".join(p for p in parts if not p.startswith("WITH")))

    def run(spark, d) -> DataFrame:
        return _shown(rules.table_issues(_table(spark, d, name), name))

    run.__name__ = f"dq_{name}"
    query(sql)(run)


_Q = "strftime({}, '%m-%d') IN ('03-31', '06-30', '09-30', '12-31')".format
_FINE = "(update_flag IS NULL OR update_flag IN ('0', '1'))"
_ANN = f"({_Q('end_date')} AND coalesce(ann_date >= end_date, false))"

_register("stock_basic", _rule("stock_basic_identity_v1", "NOT coalesce(ts_code = symbol || '.' || CASE exchange WHEN 'SSE' THEN 'SH' WHEN 'SZSE' THEN 'SZ' WHEN 'BSE' THEN 'BJ' END, false)"),
          _rule("stock_basic_lifecycle_v1", "list_status NOT IN ('L', 'D', 'P') OR coalesce(list_date > delist_date, false) OR (list_status = 'D' AND delist_date IS NULL) OR (list_status = 'L' AND delist_date IS NOT NULL)"))
_SIX = ["open", "high", "low", "close", "vol", "amount"]
_KNOWN = " AND ".join(f"isfinite({c})" for c in _SIX)
_RANGED = "(least(open, high, low, close) <= 0 OR vol < 0 OR amount < 0)"
_register("daily", _rule("daily_missing_v1", " OR ".join(f"{c} IS NULL" for c in _SIX)), _rule("daily_range_v1", f"{_KNOWN} AND {_RANGED}"), _rule("daily_ohlc_v1", f"{_KNOWN} AND NOT {_RANGED} AND (high < greatest(open, low, close) OR low > least(open, high, close))"),
          _rule("daily_volume_amount_v1", f"{_KNOWN} AND (vol = 0) <> (amount = 0)"), _rule("daily_range_v1", f"{_KNOWN} AND isfinite(pre_close) AND pre_close <= 0"),
          _rule("daily_arithmetic_v1", f"{_KNOWN} AND isfinite(pre_close) AND pre_close > 0 AND (abs(close - round_even((pre_close + change) * 100, 0) / 100) > greatest(0.0051, 1e-9 * abs(close)) OR abs(pct_chg - change / pre_close * 100) > greatest(0.011, 1e-9 * abs(pct_chg)))"),
          *_nan("pre_close", "vol", critical=True), "SELECT 'duplicate_key_v1', 'ERROR', 'MANUAL', key FROM r GROUP BY key HAVING count(*) > 1")
_register("daily_basic", _rule("daily_basic_range_v1", " OR ".join(f"(isfinite({c}) AND {c} < 0)" for c in rules.NOT_NEGATIVE)), *_nan(*rules.NOT_NEGATIVE))
_register("adj_factor", _rule("adj_factor_positive_v1", "adj_factor IS NULL OR (isfinite(adj_factor) AND adj_factor <= 0)"), *_nan("adj_factor", critical=True))
_register("suspend_d", _rule("suspend_value_v1", "suspend_type NOT IN ('S', 'R') OR coalesce(suspend_timing IN ('9:40-9:30', '9:30:15 - 10:00, 13:00-24:00'), false)"))
_GONE = "trade_date IN (SELECT trade_date FROM r GROUP BY 1 HAVING count(up_limit) = 0 OR count(down_limit) = 0)"
_register("stk_limit", f"SELECT 'stk_limit_partition_missing_v1' AS rule, 'ERROR' AS severity, 'MANUAL' AS fix, '{{\"trade_date\":\"' || trade_date || '\"}}' AS key FROM (SELECT DISTINCT trade_date FROM r WHERE {_GONE})",
          _rule("stk_limit_missing_v1", f"NOT {_GONE} AND (up_limit IS NULL OR down_limit IS NULL)"), _rule("stk_limit_order_v1", f"NOT {_GONE} AND isfinite(up_limit) AND isfinite(down_limit) AND (down_limit < 0 OR up_limit < down_limit OR NOT pre_close BETWEEN down_limit AND up_limit)"), *_nan("up_limit", critical=True))
_register("stock_st", _rule("stock_st_value_v1", "trim(type) = '' OR name IS NULL"))
_FLOWS = [f"{s}_{z}_vol" for z in ("sm", "md", "lg", "elg") for s in ("buy", "sell")]
_register("moneyflow", _rule("moneyflow_range_v1", " OR ".join(f"{c} < 0" for c in _FLOWS)))
_STATES = ", ".join(f"'{x}'" for x in rules.DIVIDEND_STATES)
_register("dividend", _rule("dividend_value_v1", f"trim(div_proc) IN ({_STATES}) AND trim(div_proc) <> div_proc", fix="AUTO_FIX"), _rule("dividend_value_v1", f"base_share < 0 OR NOT coalesce(trim(div_proc) IN ({_STATES}), false) OR (cash_div_tax > 0 AND cash_div > cash_div_tax + 1e-8)"),
          _rule("dividend_stock_ratio_v1", "abs(stk_div - (stk_bo_rate + stk_co_rate)) > 1.1e-6"))
_register("forecast", _rule("forecast_value_v1", f"type NOT IN ({', '.join(repr(x) for x in rules.FORECAST_TYPES)}) OR NOT {_FINE} OR NOT {_Q('end_date')}"), _rule("forecast_range_v1", "coalesce(p_change_min > p_change_max, false) OR coalesce(net_profit_min > net_profit_max, false)"))
_register("express", _rule("express_value_v1", f"NOT ({_ANN} AND {_FINE})"))
_register("fina_audit", _rule("fina_audit_value_v1", f"NOT {_ANN} OR audit_fees < 0 OR (month(end_date) = 12 AND (trim(coalesce(audit_result, '')) = '' OR trim(coalesce(audit_agency, '')) = ''))", "WARNING"))
for _name in ("income", "balancesheet", "cashflow"):
    _register(_name, _rule(f"{_name}_value_v1", f"NOT ({_Q('end_date')} AND coalesce(f_ann_date >= end_date, false) AND {_FINE} AND report_type IN ('1', '2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12') AND trim(comp_type) <> '')"))
_EARLY = "ann_date < end_date AND update_flag = '0' AND ts_code IN (SELECT ts_code FROM r WHERE ann_date >= end_date AND update_flag = '1')"
_register("fina_indicator", _rule("fina_indicator_value_v1", f"NOT (ann_date >= end_date AND {_FINE}) AND {_EARLY}", fix="AUTO_FIX"), _rule("fina_indicator_value_v1", f"NOT (ann_date >= end_date AND {_FINE}) AND NOT ({_EARLY})"),
          "SELECT 'duplicate_key_v1', 'ERROR', 'MANUAL', key FROM r GROUP BY key HAVING count(*) > 1")
_register("sw_industry", _rule("sw_industry_value_v1", " OR ".join(f"trim({c}) = ''" for c in rules.INDUSTRY_TEXTS) + " OR is_new NOT IN ('Y', 'N') OR coalesce(out_date <= in_date, false) OR (is_new = 'Y' AND out_date IS NOT NULL)", "WARNING"))

_EXCHANGES = "x AS (SELECT CAST(o_orderdate AS DATE) AS cal_date, CASE o_orderkey % 4 WHEN 0 THEN 'SSE' WHEN 1 THEN 'SZSE' WHEN 2 THEN 'BSE' ELSE 'NYSE' END AS exchange, max(CASE WHEN isodow(CAST(o_orderdate AS DATE)) <= 5 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 101 = 0 THEN 2 ELSE 0 END) AS is_open, max(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) - 1 END) AS pretrade_date FROM orders GROUP BY 1, 2)"
_DAYKEY = "'{\"cal_date\":\"' || cal_date || '\"}'"
_ROWKEY = "'{\"cal_date\":\"' || cal_date || '\",\"exchange\":\"' || exchange || '\"}'"


def _exchanges(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _read(spark, d, "orders").select(F.to_date("o_orderdate").alias("cal_date"), F.when(k % 4 == 0, "SSE").when(k % 4 == 1, "SZSE").when(k % 4 == 2, "BSE").otherwise("NYSE").alias("exchange"), k.alias("k"))
    opened = F.when(F.weekday("cal_date") < 5, 1).otherwise(0) + F.when(F.col("k") % 101 == 0, 2).otherwise(0)
    return rows.groupBy("cal_date", "exchange").agg(F.max(opened).alias("is_open"), F.max(F.when(F.col("k") % 3 == 0, F.date_sub("cal_date", 1))).alias("pretrade_date"))


@query(f"""WITH {_EXCHANGES} SELECT 'trade_calendar_value_v1' AS rule, 'ERROR' AS severity, 'MANUAL' AS fix, {_ROWKEY} AS key FROM x WHERE exchange = 'NYSE' OR is_open > 1
UNION ALL SELECT 'calendar_exchange_coverage_v1', 'ERROR', 'MANUAL', {_DAYKEY} FROM (SELECT cal_date FROM x GROUP BY 1 HAVING count(*) FILTER (WHERE exchange = 'SSE') = 0 OR count(*) FILTER (WHERE exchange = 'SZSE') = 0)""")
def dq_trade_cal(spark, d) -> DataFrame:
    days = _exchanges(spark, d)
    return _shown(rules.table_issues(days, "trade_cal").unionByName(rules.calendar_exchanges(days)))


@query(f"""WITH {_EXCHANGES}, w AS (SELECT *, max(CASE WHEN is_open = 1 THEN cal_date END) OVER (PARTITION BY exchange ORDER BY cal_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected FROM x WHERE exchange <> 'NYSE')
SELECT 'calendar_pretrade_v1' AS rule, 'WARNING' AS severity, 'MANUAL' AS fix, {_ROWKEY} AS key FROM w WHERE expected IS NOT NULL AND pretrade_date IS DISTINCT FROM expected AND cal_date >= DATE '1996-01-01' AND cal_date <= DATE '1998-01-01'
UNION ALL SELECT 'calendar_date_coverage_v1', 'ERROR', 'MANUAL', {_DAYKEY} FROM (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2002-01-01', INTERVAL 1 DAY)) AS DATE) AS cal_date) WHERE cal_date NOT IN (SELECT cal_date FROM x)""")
def dq_calendar_series(spark, d) -> DataFrame:
    days = _exchanges(spark, d)
    return _shown(rules.calendar_pretrade(days, "1998-01-01", "1996-01-01").unionByName(rules.calendar_days(days, "2002-01-01", "1996-01-01")))


@query(f"""WITH {_CAL}, o AS (SELECT cal_date FROM cal WHERE is_open), a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'closed_market_partition_v1' AS rule, 'ERROR' AS severity, 'MANUAL' AS fix, '{{"trade_date":"' || day || '"}}' AS key FROM a WHERE day NOT IN (SELECT cal_date FROM o) AND day <= DATE '2000-01-01'
UNION ALL SELECT 'missing_market_partition_v1', 'ERROR', 'MANUAL', '{{"trade_date":"' || cal_date || '"}}' FROM o WHERE cal_date BETWEEN (SELECT min(day) FROM a) AND DATE '2000-01-01' AND cal_date NOT IN (SELECT day FROM a)""")
def dq_market_days(spark, d) -> DataFrame:
    rows = _read(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.to_date("o_orderdate").alias("trade_date"))
    return _shown(rules.market_days(rows, _calendar(spark, d), "daily", "2000-01-01"))


@query(f"""WITH {_BARS}, lost AS (SELECT day, 'U' || user_id AS c FROM bars WHERE (user_id + day(day)) % 4 = 0), s AS (SELECT day, count(*) AS n, list_sort(list(c))[1:10] AS c FROM lost GROUP BY 1)
SELECT 'adj_factor_daily_coverage_v1' AS rule, 'ERROR' AS severity, 'MANUAL' AS fix, '{{"trade_date":"' || day || '"}}' AS key, '{{"count":' || n || ',"samples":["' || array_to_string(c, '","') || '"]}}' AS observed FROM s""")
def dq_factor_coverage(spark, d) -> DataFrame:
    daily = _bars(spark, d).selectExpr("'U' || user_id ts_code", "day trade_date", "user_id")
    return rules.factor_coverage(daily, daily.where("(user_id + day(trade_date)) % 4 <> 0")).select("rule", "severity", "fix", "key", "observed")


@query("""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01'),
c AS (SELECT count(*) FILTER (WHERE NOT (day >= e AND strftime(e, '%m-%d') <> '05-17') OR f = '2') AS n FROM (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 9 = 0 THEN DATE '1996-05-17' WHEN o_orderkey % 2 = 0 THEN DATE '1996-06-30' ELSE DATE '1996-12-31' END AS e, CASE WHEN o_orderkey % 7 = 0 THEN '2' ELSE '1' END AS f FROM orders)),
a AS (SELECT count(*) FILTER (WHERE o_orderkey % 9 IN (0, 1)) AS n, count(*) FILTER (WHERE o_orderkey % 9 = 2) AS nan FROM o)
SELECT 'express' AS dataset, 'express_value_v1' AS rule, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS issues FROM c
UNION ALL SELECT 'adj_factor', 'adj_factor_positive_v1', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, n FROM a UNION ALL SELECT 'adj_factor', 'finite_float_v1', CASE WHEN nan > 0 THEN 'FAIL' ELSE 'PASS' END, nan FROM a""")
def dq_report(spark, d) -> DataFrame:
    """A report of two tables: the rules that found something, and how much."""
    found = detect.detect({n: _table(spark, d, n) for n in ("express", "adj_factor")}, "2000-01-01")
    return found.checks_df().where("issues > 0")
