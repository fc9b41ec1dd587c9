"""Queries through the point-in-time reader, backtests and repairs, on raw tables made from the driver's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.operators import backtest as bt
from tidegauge.operators import repair
from tidegauge.plans.market import _BARS, _CAL, _calendar, _bars, _read, _shared, query
from tidegauge.plans.raw import CODE, DAILY, reader, tables
from tidegauge.reader import ALL_SYMBOLS
from tidegauge.sources.store import Store, TableConfig


@query(f"WITH {_BARS} SELECT 'U' || user_id AS symbol, day + TIME '09:30' AS interval_start, day + TIME '15:00' AS interval_end, open, high, low, close, open AS pre_close, CAST(volume * 100 AS DOUBLE) AS volume, CAST(volume * 2000 AS DOUBLE) AS amount FROM bars WHERE day >= DATE '2024-01-05' AND day + TIME '16:05' <= TIMESTAMP '2024-01-20 16:04:00'")
def view_bars(spark, d) -> DataFrame:
    return reader(spark, d).at("2024-01-20 16:04:00").market.bars(ALL_SYMBOLS, "1d", start="2024-01-05 00:00:00").df


@query(f"""WITH {_BARS}, v AS (SELECT * FROM bars WHERE day < DATE '2024-01-20'), f AS (SELECT user_id, 1 + (day(max(day)) % 5) * 0.5::DOUBLE AS anchor FROM bars WHERE day <= DATE '2024-01-20' GROUP BY 1)
SELECT 'U' || user_id AS symbol, day + TIME '15:00' AS interval_end, round(open * (1 + (day(day) % 5) * 0.5::DOUBLE) / anchor, 6) AS open, round(close * (1 + (day(day) % 5) * 0.5::DOUBLE) / anchor, 6) AS close FROM v JOIN f USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 5""")
def view_bars_forward(spark, d) -> DataFrame:
    """Before 16:05 the day's bar is not out, but its factor is: prices are those of today's scale."""
    found = reader(spark, d).at("2024-01-20 16:04:00").market.bars(ALL_SYMBOLS, "1d", count=5, adjustment="forward").df
    return found.select("symbol", "interval_end", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"))


@query(f"WITH {_BARS} SELECT 'U' || user_id AS symbol, open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS last FROM bars WHERE day = DATE '2024-01-20'")
def view_current(spark, d) -> DataFrame:
    return reader(spark, d).at("2024-01-20 10:00:00").market.current(ALL_SYMBOLS, ["open", "high", "last"]).df


_SPINE = "n AS (SELECT x AS day, (CASE isodow(x) WHEN 5 THEN x + 3 WHEN 6 THEN x + 2 ELSE x + 1 END) AS nxt FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS x FROM orders UNION SELECT DISTINCT CAST(o_orderdate AS DATE) + 3 FROM orders))"


@query(f"""WITH {_SPINE}, r AS (SELECT 'C' || o_custkey AS symbol, date_trunc('quarter', o_orderdate)::DATE AS period_end, nxt + TIME '09:25' AS visible_at, o_orderstatus AS company_type, o_orderkey, CAST(o_orderdate AS DATE) AS a, o_totalprice AS revenue FROM orders JOIN n ON day = CAST(o_orderdate AS DATE) WHERE o_orderkey % 4 <> 1 AND nxt + TIME '09:25' <= TIMESTAMP '1997-06-02 09:24:00'),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol, period_end, company_type ORDER BY a DESC, o_orderkey % 4 = 0 DESC, o_orderkey DESC) = 1)
SELECT symbol, period_end, visible_at, a AS announcement_date, a AS actual_announcement_date, 'industrial' AS company_type, revenue AS operating_revenue, CAST(NULL AS DOUBLE) AS net_income FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS k FROM l) WHERE k <= 4 AND company_type = 'F'""")
def view_statements(spark, d) -> DataFrame:
    return reader(spark, d).at("1997-06-02 09:24:00").fundamentals.statements("income", ALL_SYMBOLS, periods=4, company_type="industrial", fields=["operating_revenue", "net_income"]).df


@query(f"""WITH {_SPINE}, o AS (SELECT *, CAST(o_orderdate AS DATE) AS a, o_orderstatus = 'F' AS done FROM orders), v AS (SELECT *, CASE WHEN done THEN a + 3 ELSE a END AS announced FROM o)
SELECT 'C' || o_custkey AS symbol, nxt + TIME '09:25' AS visible_at, CASE WHEN done THEN a + 9 END AS ex_date, date_trunc('quarter', o_orderdate)::DATE AS end_date, a AS ann_date, CASE WHEN done THEN '实施' ELSE 'plan' END AS div_proc, CASE WHEN done THEN a + 3 END AS implementation_ann_date, o_orderkey / 10 AS cash_dividend, CASE WHEN done THEN 10000.0::DOUBLE END AS base_share FROM v JOIN n ON day = announced WHERE announced < DATE '1997-06-02' AND nxt + TIME '09:25' BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-06-02 09:24:00'""")
def view_dividends(spark, d) -> DataFrame:
    return reader(spark, d).at("1997-06-02 09:24:00").corporate_actions.dividends(ALL_SYMBOLS, "1996-01-01 00:00:00", fields=["cash_dividend", "base_share"]).df


@query("SELECT 'C' || o_custkey AS symbol, 'SSE' AS exchange, min(o_orderdate)::DATE AS listing_date FROM orders GROUP BY 1 HAVING min(o_orderdate)::DATE <= DATE '1998-01-05' AND DATE '1998-01-05' < max(o_orderdate)::DATE")
def view_stocks(spark, d) -> DataFrame:
    return reader(spark, d).at("1998-01-05 09:25:00").reference.stocks(fields=["exchange", "listing_date"]).df


@query(f"WITH {_BARS} SELECT 'U' || user_id AS symbol, day + TIME '09:30' AS interval_start, day + TIME '15:00' AS interval_end, close, CAST(volume * 100 AS DOUBLE) AS volume, CAST(volume * 2 AS DOUBLE) AS amount FROM bars WHERE day + TIME '16:05' <= TIMESTAMP '2024-01-20 16:05:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 5")
def view_bars_download(spark, d) -> DataFrame:
    """Daily bars of the download source."""
    found = reader(spark, d, {"daily_bars": "downloaded_daily"}).at("2024-01-20 16:05:00").market.bars(ALL_SYMBOLS, "1d", count=5, fields=["close", "volume", "amount"])
    return found.df


_DR = "e AS (SELECT DISTINCT user_id, day AS ex_date FROM bars WHERE day(day) % 10 = 0 AND day <= DATE '2024-01-20'), r AS (SELECT b.user_id, b.day, product(2.0) AS ratio FROM bars b JOIN e ON b.user_id = e.user_id AND e.ex_date > b.day GROUP BY 1, 2)"


@query(f"WITH {_BARS}, {_DR} SELECT 'U' || user_id AS symbol, day + TIME '09:30' AS interval_start, day + TIME '15:00' AS interval_end, round(open / coalesce(ratio, 1), 6) AS open, round(close / coalesce(ratio, 1), 6) AS close FROM bars LEFT JOIN r USING (user_id, day) WHERE day < DATE '2024-01-20'")
def view_bars_download_forward(spark, d) -> DataFrame:
    """Prices over the product of the ratios of later events, the day's own included from the auction on."""
    ranges = tables(spark, d)["downloaded_daily"].select("code").distinct().selectExpr("'dividend_factors' dataset", "code", "cast(null as string) period", "date'2024-01-01' start_date", "date'2024-01-31' end_date")
    found = reader(spark, d, {"daily_bars": "downloaded_daily"}, download_ranges=ranges).at("2024-01-20 09:30:00").market.bars(ALL_SYMBOLS, "1d", start="2024-01-01 00:00:00", adjustment="forward", fields=["open", "close"]).df
    return found.withColumns({c: F.round(c, 6) for c in ("open", "close")})


@query("""WITH m AS (SELECT user_id, date_trunc('minute', ts) + INTERVAL 9 HOUR - INTERVAL 59 MINUTE AS interval_end, arg_min(value, event_id) AS open, arg_max(value, event_id) AS close, count(*) AS n FROM events GROUP BY 1, 2)
SELECT 'U' || user_id AS symbol, interval_end - CASE WHEN CAST(interval_end AS TIME) = TIME '09:30' THEN INTERVAL 15 MINUTE ELSE INTERVAL 1 MINUTE END AS interval_start, interval_end, open, close, CAST(n * 100 AS DOUBLE) AS volume FROM m WHERE interval_end <= TIMESTAMP '2024-01-20 10:30:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY interval_end DESC) <= 7""")
def view_bars_intraday(spark, d) -> DataFrame:
    return reader(spark, d).at("2024-01-20 10:30:00").market.bars(ALL_SYMBOLS, "1m", count=7, fields=["open", "close", "volume"]).df


@query("""SELECT 'U' || user_id AS symbol, ts + INTERVAL 8 HOUR AS event_time, value AS last, CAST(CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id % 50 * 100 END AS DOUBLE) AS volume, value * 3 AS amount FROM events WHERE CAST(ts + INTERVAL 8 HOUR AS DATE) = DATE '2024-01-20' AND ts + INTERVAL 8 HOUR <= TIMESTAMP '2024-01-20 14:00:00'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def view_ticks(spark, d) -> DataFrame:
    """The default route of current: the last quote received."""
    return reader(spark, d, {}).at("2024-01-20 14:00:00").market.current(ALL_SYMBOLS, ["event_time", "last", "volume", "amount"]).df


@query(f"""WITH {_BARS}, u AS (SELECT DISTINCT user_id FROM events),
e AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'X' ELSE 'S' END AS kind, event_id % 7 = 0 AS whole, 34200 + event_id % 200 * 60 + event_id % 50 AS a, 36000 + event_id % 200 * 60 + event_id % 50 AS b FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'),
s AS (SELECT user_id, CASE WHEN whole THEN 33900 ELSE a END AS start, CASE WHEN kind = 'X' THEN NULL WHEN kind = 'R' THEN false ELSE whole OR 37845 < b END AS state, kind = 'S' AND NOT whole AND 37845 < b AS active FROM e WHERE whole OR a <= 37845),
l AS (SELECT *, max(start) OVER (PARTITION BY user_id) AS last FROM s),
t AS (SELECT user_id, bool_or(active) AS active, count(DISTINCT coalesce(CAST(state AS VARCHAR), 'unknown')) FILTER (WHERE start = last) AS kinds, bool_or(state) FILTER (WHERE start = last) AS state FROM l GROUP BY 1),
p AS (SELECT user_id, volume, CASE WHEN volume % 3 = 0 THEN 'NaN'::DOUBLE ELSE high END AS up, CASE WHEN volume % 5 = 0 THEN high + 1 ELSE low END AS down FROM bars WHERE day = DATE '2024-01-10')
SELECT 'U' || user_id AS symbol, CASE WHEN t.user_id IS NULL THEN false WHEN active THEN true WHEN kinds = 1 THEN state END AS suspended, CASE WHEN isfinite(up) AND up > 0 AND down > 0 AND down <= up THEN 'limited' ELSE 'unknown' END AS price_limit_status, down AS down_limit, CASE WHEN volume % 8 = 0 THEN 'S1' WHEN volume % 4 = 0 THEN 'warned' END AS st_type
FROM u LEFT JOIN t USING (user_id) LEFT JOIN p USING (user_id)""")
def view_status(spark, d) -> DataFrame:
    """All symbols, by name, as status asks for a list."""
    everyone = [r[0] for r in tables(spark, d)["daily"].select("ts_code").distinct().collect()]
    found = reader(spark, d, covered=(("suspend_d", "2024-01-01", "2024-01-31"),)).at("2024-01-10 10:30:45").market.status(everyone, ["suspended", "price_limit_status", "down_limit", "st_type"])
    return found.df


@query(f"WITH {_BARS} SELECT 'U' || user_id AS symbol, day AS trade_date, close, volume * 0.01::DOUBLE AS turnover_rate, volume * 1e4::DOUBLE AS total_mv, CAST(volume AS DOUBLE) AS pe FROM bars WHERE day >= DATE '2024-01-05' AND day < DATE '2024-01-20' AND day + TIME '17:05' <= TIMESTAMP '2024-01-18 17:04:00'")
def view_daily_metrics(spark, d) -> DataFrame:
    return reader(spark, d).at("2024-01-18 17:04:00").market.daily_metrics(ALL_SYMBOLS, "2024-01-05", "2024-01-20", ["close", "turnover_rate", "total_mv", "pe"]).df


@query(f"WITH {_BARS} SELECT 'U' || user_id AS symbol, day AS trade_date, 1 + (day(day) % 5) * 0.5::DOUBLE AS factor FROM bars WHERE day >= DATE '2024-01-05' AND day <= DATE '2024-01-18'")
def view_adjustment_factors(spark, d) -> DataFrame:
    return reader(spark, d).at("2024-01-18 09:25:00").corporate_actions.adjustment_factors(ALL_SYMBOLS, "2024-01-05").df


@query(f"WITH {_SPINE} SELECT 'C' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS trade_date, CAST(o_orderkey % 100 * 100 AS DOUBLE) AS buy_sm_volume, o_totalprice * 1e4::DOUBLE AS net_amount FROM orders JOIN n ON day = CAST(o_orderdate AS DATE) WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' AND nxt + TIME '09:25' <= TIMESTAMP '1997-06-02 09:24:00'")
def view_moneyflow(spark, d) -> DataFrame:
    return reader(spark, d).at("1997-06-02 09:24:00").market.moneyflow(ALL_SYMBOLS, "1996-01-01", "1998-01-01", ["buy_sm_volume", "net_amount"]).df


@query(f"""WITH {_SPINE}, r AS (SELECT 'C' || o_custkey AS symbol, date_trunc('quarter', o_orderdate)::DATE AS period_end, nxt + TIME '09:25' AS visible_at, CAST(o_orderdate AS DATE) AS announcement_date, o_totalprice AS basic_earnings_per_share, o_totalprice * 0.01 AS return_on_equity, o_orderkey FROM orders JOIN n ON day = CAST(o_orderdate AS DATE) WHERE o_orderdate < DATE '1998-01-01' AND nxt + TIME '09:25' <= TIMESTAMP '1997-06-02 09:25:00'),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol, period_end ORDER BY announcement_date DESC, o_orderkey DESC) = 1)
SELECT * EXCLUDE (o_orderkey) FROM l QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY period_end DESC) <= 2""")
def view_indicators(spark, d) -> DataFrame:
    return reader(spark, d).at("1997-06-02 09:25:00").fundamentals.indicators(ALL_SYMBOLS, report_end="1998-01-01", periods=2, fields=["basic_earnings_per_share", "return_on_equity"]).df


@query(f"""WITH {_SPINE} SELECT 'C' || o_custkey AS symbol, nxt + TIME '09:25' AS visible_at, date_trunc('quarter', o_orderdate)::DATE AS period_end, CAST(o_orderdate AS DATE) AS announcement_date, o_orderpriority AS forecast_type, o_totalprice * 1e4::DOUBLE AS net_income_lower_bound, o_totalprice * 0.01 AS net_income_change_lower_bound
FROM orders JOIN n ON day = CAST(o_orderdate AS DATE) WHERE nxt + TIME '09:25' BETWEEN TIMESTAMP '1996-02-01 00:00:00' AND TIMESTAMP '1996-05-15 12:00:00' QUALIFY row_number() OVER (PARTITION BY symbol, period_end ORDER BY announcement_date DESC, o_orderkey DESC) = 1""")
def view_disclosures(spark, d) -> DataFrame:
    """The latest version within a window: what came later does not count."""
    found = reader(spark, d).at("1997-06-02 09:25:00").fundamentals.disclosures("forecast", ALL_SYMBOLS, "1996-02-01 00:00:00", "1996-05-15 12:00:00", ["forecast_type", "net_income_lower_bound", "net_income_change_lower_bound"])
    return found.df


@query(f"""WITH {_SPINE} SELECT 'C' || o_custkey AS symbol, date_trunc('quarter', o_orderdate)::DATE AS period_end, nxt + TIME '09:25' AS visible_at, CAST(o_orderdate AS DATE) AS announcement_date, CAST(o_orderdate AS DATE) AS actual_announcement_date, 'securities' AS company_type, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 1 END AS other_receivables, CAST(NULL AS DOUBLE) AS total_assets
FROM orders JOIN n ON day = CAST(o_orderdate AS DATE) WHERE nxt + TIME '09:25' <= TIMESTAMP '1997-06-02 09:25:00' QUALIFY row_number() OVER (PARTITION BY symbol, period_end ORDER BY announcement_date DESC, o_orderkey DESC) = 1""")
def view_balance_sheets(spark, d) -> DataFrame:
    """A column of the payload stands in where the public one is null."""
    return reader(spark, d).at("1997-06-02 09:25:00").fundamentals.statements("balance_sheet", ALL_SYMBOLS, fields=["other_receivables", "total_assets"]).df


@query("""WITH i AS (SELECT 'C' || o_custkey AS symbol, CAST(o_orderdate AS DATE) + 8766 AS in_date, max(o_orderkey) AS k, arg_max(CASE WHEN o_orderstatus = 'F' THEN DATE '9999-12-31' ELSE CAST(o_orderdate AS DATE) + 9166 END, o_orderkey) AS out_date FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
SELECT symbol, 2::TINYINT AS level, '2' || k AS industry_code, 'name' || k AS industry_name FROM i WHERE in_date <= DATE '2022-03-01' AND out_date > DATE '2022-03-01' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY in_date DESC) = 1""")
def view_industry(spark, d) -> DataFrame:
    return reader(spark, d).at("2022-03-01 09:25:00").classification.industry(ALL_SYMBOLS, 2).df


@query("SELECT x AS cal_date, 'SSE' AS exchange, isodow(x) <= 5 AS is_open, CAST(NULL AS DATE) AS previous_session FROM (SELECT CAST(unnest(generate_series(DATE '1996-02-03', DATE '1997-06-02', INTERVAL 1 DAY)) AS DATE) AS x)")
def view_sessions(spark, d) -> DataFrame:
    return reader(spark, d).at("1997-06-02 09:25:00").calendar.sessions("1996-02-03").df


@query("SELECT DATE '1997-05-30' AS previous_session")
def view_previous_session(spark, d) -> DataFrame:
    """Of a Monday: the Friday before."""
    found = reader(spark, d).at("1997-06-02 09:25:00").calendar.previous_session()
    return spark.createDataFrame([(found,)], "previous_session date")


@query("SELECT 'C' || o_custkey AS symbol, min(o_orderdate)::DATE AS listing_date, max(o_orderdate)::DATE AS delisting_date FROM orders GROUP BY 1")
def view_lifecycles(spark, d) -> DataFrame:
    return reader(spark, d).security_lifecycles()


@query("SELECT 'C' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS ann_date, o_orderkey / 10 AS cash_div FROM orders WHERE o_orderstatus = 'F'")
def view_implemented_dividends(spark, d) -> DataFrame:
    return reader(spark, d).implemented_dividends().select("symbol", "ann_date", "cash_div")


@query("SELECT DISTINCT 'C' || CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS symbol, CAST(o_orderdate AS DATE) AS ex_date FROM orders WHERE o_orderstatus = 'F'")
def view_renamed_codes(spark, d) -> DataFrame:
    """Two codes of one security: all rows under the code of the day."""
    own = reader(spark, d, identities=True)
    return own.history.relabel(own.implemented_dividends(), "symbol", "2002-01-01").selectExpr("symbol", "ann_date ex_date").distinct()


@query("WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS cal_date FROM orders WHERE isodow(CAST(o_orderdate AS DATE)) <= 5), l AS (SELECT cal_date, lead(cal_date) OVER (ORDER BY cal_date) AS nxt FROM s) SELECT cal_date, 'month' AS every FROM l WHERE month(cal_date) <> month(nxt) UNION ALL SELECT cal_date, 'week' FROM l WHERE yearweek(cal_date) <> yearweek(nxt)")
def schedule_period_ends(spark, d) -> DataFrame:
    days = _calendar(spark, d).where("is_open").select("cal_date")
    return bt.period_ends(days, "cal_date", "month").withColumn("every", F.lit("month")).unionByName(bt.period_ends(days, "cal_date", "week").withColumn("every", F.lit("week")))


@query("""WITH i AS (SELECT DISTINCT o_orderstatus AS dataset, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 200000), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY dataset ORDER BY day) AS INTEGER) AS k FROM i)
SELECT dataset, min(day) AS start_date, max(day) AS end_date FROM g GROUP BY dataset, k""")
def repair_refetch_ranges(spark, d) -> DataFrame:
    found = _read(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderstatus").alias("dataset"), F.lit("daily_range_v1").alias("rule"), F.to_date("o_orderdate").alias("day"))
    return repair.refetch_ranges(found)


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 50 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE NOT (o_custkey % 50 = 1)")
def repair_patch(spark, d) -> DataFrame:
    """Patches in every partition of a store, some of them deletions, under the guard of the values before."""
    orders = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    store = Store(spark, _shared(spark), {"orders": TableConfig("orders", StructType(orders.schema.fields), ("o_orderstatus",), ("o_orderkey",), ("o_orderkey",))})
    store.append("orders", orders)
    patches = orders.where("o_custkey % 50 in (0, 1)").selectExpr("o_orderkey", "o_orderstatus", "0d o_totalprice", "o_totalprice old", "o_custkey % 50 = 1 _delete")
    repair.patch(store, "orders", [(r[0],) for r in orders.select("o_orderstatus").distinct().collect()], patches, {"o_totalprice": "old"})
    return store.read("orders", columns=["o_orderkey", "o_orderstatus", "o_totalprice"])


@query(f"""WITH {_BARS}, b AS (SELECT user_id, day, 10.0::DOUBLE + volume % 7 AS p FROM bars), s AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM b)),
f AS (SELECT user_id, min(day) AS day, arg_min(p, day) AS p, arg_max(p, day) AS last FROM b GROUP BY 1), o AS (SELECT f.user_id, CAST(floor(floor(500000.0 / f.p) / 100) * 100 AS BIGINT) AS q, b.p AS price, last FROM f JOIN s ON f.day = s.day LEFT JOIN b ON b.user_id = f.user_id AND b.day = s.nxt)
SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS run, CASE WHEN price IS NULL THEN 0 ELSE q END AS quantity, round(CASE WHEN price IS NULL THEN 0.0 ELSE greatest(q * price * 0.00025, 5) + q * price * 0.00001 END, 4) AS fee,
round(CASE WHEN price IS NULL THEN 1e6 ELSE 1e6 - q * price - greatest(q * price * 0.00025, 5) - q * price * 0.00001 + q * last END, 4) AS equity FROM o""")
def backtest_hold(spark, d) -> DataFrame:
    """A run for each user: half the cash into one share after its first session, held to the end."""
    rows = bt.backtest(*hold_runs(spark, d), own_bars=True)
    last = F.max_by("equity", F.when(F.col("kind") == "equity", F.col("seq")))
    out = rows.groupBy("run").agg(F.coalesce(F.sum(F.when(F.col("kind") == "fill", F.col("quantity"))), F.lit(0)).alias("quantity"), F.round(F.coalesce(F.sum("fee"), F.lit(0.0)), 4).alias("fee"), F.round(last, 4).alias("equity"))
    return out.withColumn("run", run_label("run"))


def run_label(run: str) -> Column:
    """Six characters, as the SQL shows a run; longer numbers are cut, so labels are no keys."""
    return F.lpad(run, 6, "0")


def hold_runs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Targets and bars of a run for each user; a run's key is the whole number."""
    code = F.lit("600000.SH")
    bars = _bars(spark, d).select("user_id", "day", (10.0 + F.col("volume") % 7).alias("p"), F.col("volume").cast("double").alias("volume"))
    run = F.col("user_id").cast("string")
    every = bars.select(run.alias("run"), "day", code.alias("symbol"), F.col("p").alias("open"), F.col("p").alias("close"), "volume", F.lit(1000.0).alias("up_limit"), F.lit(0.01).alias("down_limit"), F.lit(False).alias("suspended"))
    targets = every.groupBy("run").agg(F.min("day").alias("day")).select("run", "day", code.alias("symbol"), F.lit(0.5).alias("weight"))
    return targets, every
