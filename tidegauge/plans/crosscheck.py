"""Queries of the cross-checks: two sources made from orders, with planted differences, beside SQL that states what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import crosscheck as xc
from tidegauge.plans.market import _read, query

_FROM, _TO = "1996-01-01", "1997-12-31"
_O = f"o AS (SELECT 'C' || o_orderkey AS code, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}')"
_SAME = "CASE WHEN l = r OR abs(l - r) <= greatest({} * greatest(abs(l), abs(r)), {}) THEN 'equal' ELSE 'differs' END".format
_PRICES = "(VALUES ('open'), ('high'), ('low'), ('close')) AS f(field)"
_GAP = "CAST(NULL AS DOUBLE) AS left_value, CAST(NULL AS DOUBLE) AS right_value"


def _orders(spark, d) -> DataFrame:
    return _read(spark, d, "orders").selectExpr("'C' || o_orderkey code", "to_date(o_orderdate) day", "o_orderkey k", "o_totalprice p", "o_custkey c", "o_orderstatus s")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("left_value", "right_value")})


@query(f"""WITH {_O}, c AS (SELECT code, day, 'daily_none' AS "check", field, p AS l, p + CASE WHEN k % 5 = 0 THEN 5 ELSE 0 END AS r FROM o, {_PRICES} WHERE k % 7 <> 0),
v AS (SELECT code, day, 'daily_none' AS "check", 'volume' AS field, 100 AS l, CASE WHEN k % 11 = 0 THEN 101 ELSE 100.4 END AS r FROM o WHERE k % 7 <> 0 UNION ALL SELECT code, day, 'daily_none', 'amount', p, p * 1000 / 1000 FROM o WHERE k % 7 <> 0),
g AS (SELECT code, day, 'daily_front' AS "check", field, p * (1 + k % 3) / (1 + k % 3) AS l, p + CASE WHEN k % 13 = 0 THEN 99 ELSE 0.004 END AS r FROM o, {_PRICES} WHERE k % 7 <> 0 AND k % 17 <> 0)
SELECT "check", code, day, '__row__' AS field, {_GAP}, 'right_missing' AS verdict FROM o, (VALUES ('daily_none'), ('daily_front')) AS x("check") WHERE k % 7 = 0
UNION ALL SELECT 'daily_front', code, day, '__row__', {_GAP}, 'no_factor' FROM o WHERE k % 7 <> 0 AND k % 17 = 0
UNION ALL SELECT "check", 'X' || k, day, '__row__', {_GAP}, 'left_missing' FROM o, (VALUES ('daily_none'), ('daily_front')) AS x("check") WHERE k % 19 = 0
UNION ALL SELECT "check", code, day, field, round(l, 4), round(r, 4), {_SAME("1e-6", "CASE WHEN field = 'volume' THEN 0.500001 ELSE 1e-6 END")} FROM (SELECT * FROM c UNION ALL SELECT * FROM v)
UNION ALL SELECT "check", code, day, field, round(l, 4), round(r, 4), {_SAME("1e-5", "0.005001")} FROM g""")
def crosscheck_daily(spark, d) -> DataFrame:
    o = _orders(spark, d)
    vendor = o.selectExpr("code ts_code", "day trade_date", "p open", "p high", "p low", "p close", "100d vol", "p amount")
    raw = "p + if(k % 5 = 0, 5, 0)"
    none = o.where("k % 7 <> 0").selectExpr("code", "day trade_date", "'none' adjustment", *[f"{raw} {c}" for c in xc.PRICES], "if(k % 11 = 0, 101d, 100.4d) volume", "p * 1000 amount")
    front = o.where("k % 7 <> 0").selectExpr("code", "day trade_date", "'front_ratio' adjustment", *[f"p + if(k % 13 = 0, 99d, 0.004d) {c}" for c in xc.PRICES], "0d volume", "0d amount")
    more = o.where("k % 19 = 0").selectExpr("'X' || k code", "day trade_date", "explode(array('none', 'front_ratio')) adjustment", *[f"1d {c}" for c in xc.PRICES], "1d volume", "1d amount")
    factors = o.where("k % 17 <> 0").selectExpr("code ts_code", "day trade_date", "1d + k % 3 adj_factor")
    return _rounded(xc.daily(vendor, factors, none.unionByName(front).unionByName(more), _FROM, _TO))


_SEVEN = "(VALUES ('open'), ('high'), ('low'), ('close'), ('preClose'), ('volume'), ('amount')) AS f(field)"


@query(f"""WITH {_O}, c AS (SELECT code, day, k, field, CASE WHEN field IN ('volume', 'amount') THEN 8 WHEN k % 3 = 1 THEN 4.0 ELSE 8 END AS l, CASE WHEN field IN ('volume', 'amount') OR k % 3 <> 1 THEN 8 WHEN k % 5 = 0 THEN 4.001 ELSE 4 END AS r FROM o, {_SEVEN} WHERE k % 7 <> 0 AND k % 3 <> 2)
SELECT 'front_ratio' AS "check", code, day, '__row__' AS field, {_GAP}, 'right_missing' AS verdict FROM o WHERE k % 7 = 0 UNION ALL SELECT 'front_ratio', code, day, '__row__', {_GAP}, 'invalid' FROM o WHERE k % 7 <> 0 AND k % 3 = 2
UNION ALL SELECT 'front_ratio', code, day, field, round(l, 4), round(r, 4), {_SAME("1e-12", "1e-12")} FROM c""")
def crosscheck_front_ratio(spark, d) -> DataFrame:
    """Orders 3j + 1 have a later event that halves prices, orders 3j + 2 one without a ratio."""
    o = _orders(spark, d).where(F.col("day").between(F.lit(_FROM).cast("date"), F.lit(_TO).cast("date")))
    names = [*xc.PRICES, "preClose", "volume", "amount"]
    raw = o.selectExpr("code", "day trade_date", "'none' adjustment", *[f"8d {c}" for c in names])
    native = o.where("k % 7 <> 0").selectExpr("code", "day trade_date", *[f"CASE WHEN k % 3 <> 1 THEN 8d WHEN k % 5 = 0 THEN 4.001d ELSE 4d END {c}" for c in names[:5]], "8d volume", "8d amount")
    events = o.selectExpr("code", "explode(array(struct(date_add(day, 9) ex_date, CASE k % 3 WHEN 1 THEN 2d WHEN 2 THEN 0d ELSE 1d END dr), struct(day ex_date, 7d dr))) e").select("code", "e.*")
    return _rounded(xc.front_ratio(raw, native, events, _FROM, _TO))


@query(f"""WITH {_O} SELECT 'financial_Balance' AS "check", code, day, 'oth_receiv' AS field, CASE WHEN k % 5 = 1 THEN p ELSE p * 2 END AS left_value, CASE k % 5 WHEN 0 THEN p * 2 WHEN 1 THEN NULL ELSE p * 2 + 1 END AS right_value, CASE k % 5 WHEN 0 THEN 'equal' ELSE 'differs' END AS verdict FROM o WHERE k % 3 = 0
UNION ALL SELECT 'financial_Income', code, day, 'basic_eps', 1, 1.004, 'equal' FROM o WHERE k % 3 = 1 UNION ALL SELECT 'financial_Income', code, day, 'revenue', 0, 0, 'equal' FROM o WHERE k % 3 = 1
UNION ALL SELECT 'financial_Income', code, day, '__row__', {_GAP}, 'left_missing' FROM o WHERE k % 3 = 2
UNION ALL SELECT 'financial_Balance', code, day, '__row__', {_GAP}, 'right_missing' FROM o WHERE k % 3 = 1""")
def crosscheck_financial(spark, d) -> DataFrame:
    """Balances nearest to one of two columns, a cent of earnings, nulls that are zero, fields and rows that a side lacks."""
    o = _orders(spark, d)

    def vendor(table: str, rows: DataFrame, **own: str) -> DataFrame:
        columns = dict.fromkeys(c for t, f in xc.REPORTS.values() if t == table for x in f.values() for c in ([x] if isinstance(x, str) else x))
        return rows.selectExpr("code ts_code", "day end_date", "day ann_date", "day f_ann_date", "'1' report_type", "'1' update_flag", *[f"{own.get(c, 'cast(null as double)')} {c}" for c in columns])

    tables = {"balancesheet": vendor("balancesheet", o.where("k % 3 <> 2"), oth_receiv="p", oth_rcv_total="p * 2"), "income": vendor("income", o.where("k % 3 = 1"), basic_eps="1d"), "cashflow": vendor("cashflow", o.limit(0)), "fina_indicator": vendor("fina_indicator", o.limit(0))}
    text = "to_json(map('other_receivable', CASE k % 5 WHEN 0 THEN p * 2 WHEN 1 THEN null ELSE p * 2 + 1 END))"
    balance = o.where("k % 3 = 0").selectExpr("code", "'Balance' dataset", "day report_date", "explode(array(day, date_sub(day, 1))) disclosure_date", f"if(disclosure_date = day, {text}, '{{}}') data_json")
    income = o.where("k % 3 <> 0").selectExpr("code", "'Income' dataset", "day report_date", "day disclosure_date", """'{"s_fa_eps_basic": 1.004, "revenue_inc": 0, "other": true}' data_json""")
    return xc.financial(tables, balance.unionByName(income), _FROM, _TO)


@query(f"""WITH d AS (SELECT 'C' || o_custkey AS code, CAST(o_orderdate AS DATE) + 5 AS day, o_orderkey AS k, date_trunc('quarter', o_orderdate) AS q, CAST(o_orderdate AS DATE) AS a FROM orders WHERE o_orderstatus = 'F'),
l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY code, q, a ORDER BY k DESC) = 1), t AS (SELECT code, day, sum(k % 4) * 1.0 AS cash, sum(k % 3) * 1.0 AS stock FROM l WHERE day BETWEEN DATE '{_FROM}' AND DATE '{_TO}' GROUP BY 1, 2),
e AS (SELECT 'C' || o_custkey AS code, CAST(o_orderdate AS DATE) + 5 AS day, max(o_orderkey % 4)::DOUBLE AS interest, max(o_orderkey % 3)::DOUBLE AS bonus FROM orders WHERE o_orderkey % 9 <> 0 AND CAST(o_orderdate AS DATE) + 5 BETWEEN DATE '{_FROM}' AND DATE '{_TO}' GROUP BY 1, 2),
j AS (SELECT coalesce(t.code, e.code) AS code, coalesce(t.day, e.day) AS day, cash, stock, interest, bonus FROM t FULL JOIN e ON t.code = e.code AND t.day = e.day),
c AS (SELECT code, day, unnest(['cash_div_tax', 'stk_bo_rate', 'stk_co_rate', 'stk_div']) AS field, unnest([cash, stock, 0.0, stock])::DOUBLE AS l, unnest([interest, bonus, 0.0, bonus])::DOUBLE AS r FROM j WHERE cash IS NOT NULL AND interest IS NOT NULL)
SELECT 'dividend' AS "check", code, day, '__row__' AS field, {_GAP}, CASE WHEN cash IS NULL THEN 'left_missing' ELSE 'right_missing' END AS verdict FROM j WHERE cash IS NULL OR interest IS NULL UNION ALL SELECT 'dividend', code, day, field, l, r, {_SAME("1e-6", "1e-6")} FROM c""")
def crosscheck_dividends(spark, d) -> DataFrame:
    o = _read(spark, d, "orders").selectExpr("'C' || o_custkey code", "to_date(o_orderdate) day", "o_orderkey k", "o_orderstatus s")
    vendor = o.selectExpr("code ts_code", "to_date(date_trunc('quarter', day)) end_date", "day ann_date", "if(s = 'F', '实施', 'plan') div_proc", "date_add(date'2000-01-01', cast(k as int)) imp_ann_date", "date_add(day, 5) ex_date", "k % 4 * 1d cash_div_tax", "k % 3 * 1d stk_bo_rate", "cast(null as double) stk_co_rate", "k % 3 * 1d stk_div")
    events = o.where("k % 9 <> 0").groupBy("code", F.date_add("day", 5).alias("ex_date")).agg(F.max(F.col("k") % 4 * 1.0).alias("interest"), F.max(F.col("k") % 3 * 1.0).alias("stockBonus")).withColumn("stockGift", F.lit(None).cast("double"))
    return xc.dividends(vendor, events, _FROM, _TO)
