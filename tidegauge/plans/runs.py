"""Queries of backtests, their events, dividends and universes, beside their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import actions, clock, runner, trading
from tidegauge.operators import backtest as bt
from tidegauge.operators import bars as price
from tidegauge.plans.market import _BARS, _bars, _calendar, _read, query
from tidegauge.plans.raw import DAILY, tables
from tidegauge.reader import Catalog, MarketReader
from tidegauge.streaming import sequence

_DAYS96 = "d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders WHERE isodow(CAST(o_orderdate AS DATE)) <= 5), n AS (SELECT session, lead(session) OVER (ORDER BY session) AS following FROM d)"


@query(f"""WITH {_DAYS96}, e(a, s, kind) AS (VALUES (TIME '09:25', TIME '09:25', 'session_start'), (TIME '09:30', TIME '09:15', 'auction'), (TIME '10:30', TIME '09:30', 'bar'), (TIME '11:30', TIME '10:30', 'bar'), (TIME '14:00', TIME '13:00', 'bar'), (TIME '15:00', TIME '14:00', 'bar'), (TIME '16:05', TIME '16:05', 'session_end'))
SELECT session, session + a AS "at", session + s AS "start", kind FROM n, e WHERE year(session) = 1996 UNION ALL SELECT session, session + TIME '13:00', session + TIME '13:00', 'strategy' FROM n WHERE year(session) = 1996 AND yearweek(session) <> yearweek(following)""")
def backtest_timeline(spark, d) -> DataFrame:
    """Hourly bars of a year, and a call at 13:00 of each week's last session."""
    days = sorted(r[0] for r in _calendar(spark, d).where("is_open").select("cal_date").collect())
    return clock.timeline_df(spark, [x for x in days if x.year == 1996], "60m", schedule=clock.Schedule("week", at="13:00"), calendar=days).drop("seq")


@query("""WITH k AS (SELECT DISTINCT 'C' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day, o_orderkey / 10 AS cash, date_trunc('quarter', o_orderdate)::DATE AS base FROM orders WHERE o_orderstatus = 'F')
SELECT symbol, day + 9 AS record_date, cash, 0.0::DOUBLE AS shares, CASE WHEN count(*) OVER (PARTITION BY symbol, day) > 1 THEN 'record date' END AS conflict FROM k""")
def dividend_facts(spark, d) -> DataFrame:
    """What accounts see of dividends; two amounts on one day contradict each other."""
    rows = tables(spark, d)["dividend"].withColumnRenamed("ts_code", "symbol")
    return actions.effective(rows).select("symbol", "record_date", "cash", "shares", "conflict")


_ENDS = [date(1996, 3, 29), date(1997, 5, 30), date(1998, 12, 31)]


@query("""WITH e(day) AS (VALUES (DATE '1996-03-29'), (DATE '1997-05-30'), (DATE '1998-12-31')),
w AS (SELECT e.day, x AS session, row_number() OVER (PARTITION BY e.day ORDER BY x DESC) AS k FROM e, (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1999-01-01', INTERVAL 1 DAY)) AS DATE) AS x) WHERE isodow(x) <= 5 AND x <= e.day),
s AS (SELECT 'C' || o_custkey AS symbol, min(o_orderdate)::DATE AS listed, max(o_orderdate)::DATE AS delisted FROM orders GROUP BY 1), t AS (SELECT DISTINCT 'C' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 5 = 0)
SELECT w.day, symbol FROM w JOIN s ON k = 60 AND listed <= session AND w.day < delisted WHERE (symbol, w.day) NOT IN (SELECT symbol, day FROM t)""")
def universe_by_day(spark, d) -> DataFrame:
    """Listed for sixty sessions, without special treatment on the day."""
    known = tables(spark, d)
    treated = _read(spark, d, "orders").where("o_orderkey % 5 = 0").selectExpr("'C' || o_custkey ts_code", "to_date(o_orderdate) trade_date", "'ST' type", "cast(null as string) type_name")
    days = spark.sql("select explode(sequence(date'1995-01-01', date'1999-01-01')) d")
    calendar = days.selectExpr("'SSE' exchange", "d cal_date", "weekday(d) < 5 is_open", "cast(null as date) pretrade_date")
    reader = MarketReader(Catalog({"stock_basic": known["stock_basic"], "stock_st": treated, "trade_cal": calendar}), DAILY)
    return runner.universe_by_day(reader, _ENDS, runner.open_sessions(reader), 60, True)


@query(f"""WITH {_BARS}, s AS (SELECT day, row_number() OVER (ORDER BY day) AS i, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM bars)),
p AS (SELECT user_id, b.day, i, CASE WHEN close > 0 THEN close * (1 + day(b.day) % 5 * 0.5::DOUBLE) END AS p, yearweek(b.day) <> yearweek(nxt) AS last FROM bars b JOIN s ON b.day = s.day),
w AS (SELECT *, count(p) OVER v AS n, first_value(p) OVER v AS a, min(i) OVER v AS since FROM p WINDOW v AS (PARTITION BY user_id ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
r AS (SELECT day, 'U' || user_id AS symbol, p / a - 1 AS score FROM w WHERE last AND n = 3 AND since = i - 2 QUALIFY row_number() OVER (PARTITION BY day ORDER BY p / a - 1 DESC, 'U' || user_id) <= 7)
SELECT day, symbol, round(score, 6) AS score, 1.0::DOUBLE / count(*) OVER (PARTITION BY day) AS weight FROM r""")
def momentum_targets(spark, d) -> DataFrame:
    """The seven symbols of each week's end by return over two sessions, adjusted prices."""
    own = _bars(spark, d).selectExpr("day", "'U' || user_id symbol", "close")
    factors = own.selectExpr("day", "symbol", "1 + (day(day) % 5) * 0.5d factor")
    return price.monthly_momentum(own, factors, own.select("day").distinct(), 2, 7, every="week").withColumn("score", F.round("score", 6))


@query(f"""WITH {_BARS}, b AS (SELECT user_id, day, 10.0::DOUBLE + volume % 7 AS p FROM bars), s AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM b)),
f AS (SELECT user_id, min(day) AS day, arg_min(p, day) AS p FROM b GROUP BY 1), o AS (SELECT f.user_id, f.day AS first, s.nxt AS bought, floor(floor(500000.0 / f.p) / 100) * 100 AS q, b.p AS price FROM f JOIN s ON f.day = s.day LEFT JOIN b ON b.user_id = f.user_id AND b.day = s.nxt),
c AS (SELECT *, q * price * 1.00001::DOUBLE + greatest(q * price * 0.00025, 5) AS cost FROM o),
x AS (SELECT c.user_id, s.day, CASE WHEN price IS NULL OR s.day < bought THEN 1e6::DOUBLE ELSE 1e6 - cost + q * last_value(b.p IGNORE NULLS) OVER (PARTITION BY c.user_id ORDER BY s.day) END AS equity, price, q FROM c JOIN s ON s.day >= first LEFT JOIN b ON b.user_id = c.user_id AND b.day = s.day),
e AS (SELECT *, equity / lag(equity, 1, 1e6) OVER w - 1 AS ret, greatest(max(equity) OVER w, 1e6) AS peak FROM x WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS run, count(*) AS n, CAST(CASE WHEN any_value(price) IS NULL THEN 0 ELSE 1 END AS BIGINT) AS fills, round(arg_max(equity, day) / 1e6 - 1, 8) AS total_return, round(stddev_samp(ret) * sqrt(252), 6) AS volatility, round(abs(min(equity / peak - 1)), 8) AS max_drawdown,
round(CASE WHEN any_value(price) IS NULL THEN 0 ELSE any_value(q * price) / ((sum(equity) + 1e6) / (count(*) + 1)) END, 6) AS turnover FROM e GROUP BY user_id""")
def backtest_metrics(spark, d) -> DataFrame:
    """Metrics of a run for each user, all at once: half the cash in one share, held to the end."""
    from tidegauge.plans.views import hold_runs, run_label

    out = trading.run_metrics(bt.backtest(*hold_runs(spark, d), own_bars=True), 1_000_000.0)
    rounded = {"total_return": 8, "volatility": 6, "max_drawdown": 8, "turnover": 6}
    return out.select(run_label("run").alias("run"), "n", "fills", *[F.round(c, k).alias(c) for c, k in rounded.items()])


@query("SELECT 'U' || user_id AS code, event_id AS seq, event_type AS period FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, event_id DESC) = 1")
def last_quotes(spark, d) -> DataFrame:
    """The last quote of each code, a stock's own subscription (here: an error) before the market's."""
    rows = _read(spark, d, "events").selectExpr("event_id seq", "'U' || user_id code", "event_type period", "if(event_type = 'error', 'stock', 'market') source")
    return sequence.last_quotes(rows).select("code", "seq", "period")


@query("""SELECT 'U' || user_id AS code, CAST(ts + INTERVAL 8 HOUR AS DATE) AS trading_date, CASE WHEN event_id % 3 > 0 THEN epoch_us(ts) // 1000 * 1000 END AS event_time, value AS last FROM events""")
def quote_events(spark, d) -> DataFrame:
    """Quotes as they come: times of the body in milliseconds, or none, and the trading day of either."""
    at = "unix_micros(cast(ts as timestamp))"
    body = f"to_json(named_struct('time', if(event_id % 3 > 0, cast({at} div 1000 as bigint), 0L), 'lastPrice', value))"
    rows = _read(spark, d, "events").selectExpr("event_id seq", "'U' || user_id code", "'tick' period", "'market' source", "'SH' subscription", f"{at} received_at", f"{body} quote")
    return sequence.events(rows, sequence.TICK).selectExpr("code", "trading_date", "event_time", "quote.lastPrice last")
