"""The market queries, re-read onto the driver's tables, each beside the SQL that it is compared with.

events stand for quotes (a symbol is a user_id), orders for announcements and sessions, lineitem for keyed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.functions import calendar as cal
from tidegauge.functions.values import at_clock, last_first
from tidegauge.identity import CodeHistory
from tidegauge.operators import bars, checks, tables, trading, versions
from tidegauge.scratch import folder
from tidegauge.sources.store import Store, TableConfig
from tidegauge.streaming.quotes import replay

AS_OF, EARLY = "2024-01-20 16:05:00", "2024-01-20 16:04:00"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _bars(spark, d) -> DataFrame:
    return bars.daily_bars(_read(spark, d, "events"), "user_id", "ts", "value")


def _calendar(spark, d) -> DataFrame:
    days = _read(spark, d, "orders").select(F.to_date("o_orderdate").alias("cal_date")).distinct()
    return days.withColumn("is_open", F.dayofweek("cal_date").between(2, 6))


_BARS = "bars AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"
_CAL = "cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS cal_date, isodow(CAST(o_orderdate AS DATE)) <= 5 AS is_open FROM orders)"
_PRICES = ["open", "high", "low", "close"]


@query(f"WITH {_BARS} SELECT * FROM bars WHERE day >= DATE '2024-01-05' AND day + TIME '16:05' <= TIMESTAMP '{EARLY}'")
def pit_daily_bars_range(spark, d):
    return bars.visible_days(_bars(spark, d).where("day >= date'2024-01-05'"), EARLY, "16:05")


@query(f"WITH {_BARS} SELECT * FROM bars WHERE day + TIME '16:05' <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 5")
def pit_daily_bars_count(spark, d):
    return bars.latest(bars.visible_days(_bars(spark, d), AS_OF, "16:05"), ["user_id"], last_first("day"), 5)


@query(f"""WITH {_BARS}, v AS (SELECT * FROM bars WHERE day + TIME '16:05' <= TIMESTAMP '{AS_OF}'), f AS (SELECT user_id, day, 1 + (day(day) % 5) * 0.5 AS factor FROM v),
a AS (SELECT user_id, arg_max(factor, day) AS anchor FROM f GROUP BY 1)
SELECT user_id, day, round(open * factor / anchor, 6) AS open, round(high * factor / anchor, 6) AS high, round(low * factor / anchor, 6) AS low, round(close * factor / anchor, 6) AS close, volume FROM v JOIN f USING (user_id, day) JOIN a USING (user_id)""")
def forward_adjust_factor(spark, d):
    own = bars.visible_days(_bars(spark, d), AS_OF, "16:05")
    factors = own.select("user_id", "day", (1 + (F.dayofmonth("day") % 5) * 0.5).alias("factor"))
    out = bars.adjust_by_factor(own, factors, ["user_id", "day"], _PRICES)
    return out.withColumns({p: F.round(p, 6) for p in _PRICES}).select("user_id", "day", *_PRICES, "volume")


@query(f"""WITH {_BARS}, e AS (SELECT DISTINCT user_id, day AS ex_date, 2.0::DOUBLE AS dr FROM bars WHERE day(day) % 10 = 0 AND day <= DATE '2024-01-30'),
r AS (SELECT b.user_id, b.day, product(dr) AS ratio FROM bars b JOIN e ON b.user_id = e.user_id AND e.ex_date > b.day GROUP BY 1, 2)
SELECT user_id, day, round(open / coalesce(ratio, 1), 6) AS open, round(high / coalesce(ratio, 1), 6) AS high, round(low / coalesce(ratio, 1), 6) AS low, round(close / coalesce(ratio, 1), 6) AS close, volume FROM bars LEFT JOIN r USING (user_id, day)""")
def forward_adjust_events(spark, d):
    own = _bars(spark, d)
    events = own.where(F.dayofmonth("day") % 10 == 0).select("user_id", F.col("day").alias("ex_date"), F.lit(2.0).alias("dr"))
    out = bars.adjust_by_events(own, events, "user_id", "day", _PRICES, "2024-01-30")
    return out.withColumns({p: F.round(p, 6) for p in _PRICES}).select("user_id", "day", *_PRICES, "volume")


@query("SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-15 10:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def pit_current_tick(spark, d):
    seen = _read(spark, d, "events").where("ts <= timestamp_ntz'2024-01-15 10:00:00'")
    return bars.latest(seen, ["user_id"], last_first("ts", "event_id"))


@query(f"WITH {_BARS} SELECT user_id, day, open, CASE WHEN day + TIME '16:05' <= TIMESTAMP '{EARLY}' THEN close END AS close, CASE WHEN day + TIME '16:05' <= TIMESTAMP '{EARLY}' THEN high END AS high FROM bars WHERE day = DATE '2024-01-20'")
def pit_current_masked(spark, d):
    today = bars.visible_days(_bars(spark, d), EARLY, "09:30").where("day = date'2024-01-20'").select("user_id", "day", "open", "close", "high")
    return versions.masked(today, ["close", "high"], at_clock(F.col("day"), "16:05") <= F.lit(EARLY).cast("timestamp_ntz"))


@query(f"WITH {_CAL}, sparse AS (SELECT * FROM cal WHERE day(cal_date) % 3 <> 0) SELECT l_orderkey, l_linenumber, (SELECT min(n.cal_date) FROM sparse n WHERE n.is_open AND n.cal_date > CAST(l_shipdate AS DATE)) AS next_session FROM lineitem")
def next_session(spark, d):
    """Of days that may not be in the calendar, which lacks a third of them."""
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    return cal.join_next_session(rows, _calendar(spark, d).where("day(cal_date) % 3 <> 0"), "day").drop("day")


@query(f"WITH {_CAL} SELECT max(cal_date) AS previous_session FROM cal WHERE is_open AND cal_date < DATE '1997-03-17'")
def previous_session(spark, d):
    return cal.previous_open(_calendar(spark, d), "1997-03-17").select(F.col("cal_date").alias("previous_session"))


@query(f"WITH {_CAL} SELECT cal_date, is_open, (SELECT max(n.cal_date) FROM cal n WHERE n.is_open AND n.cal_date < cal.cal_date) AS previous_session FROM cal WHERE cal_date >= DATE '1996-01-01' AND cal_date < DATE '1997-01-01'")
def sessions_range(spark, d):
    return cal.with_sessions(_calendar(spark, d)).where("cal_date >= date'1996-01-01' and cal_date < date'1997-01-01'").select("cal_date", "is_open", "previous_session")


@query("SELECT o_orderkey, o_custkey, date_trunc('quarter', o_orderdate)::DATE AS period, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate < DATE '1999-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey, date_trunc('quarter', o_orderdate) ORDER BY o_orderdate DESC, o_orderpriority DESC, o_orderkey DESC) = 1")
def statement_versions(spark, d):
    rows = _read(spark, d, "orders").where("o_orderdate < timestamp_ntz'1999-01-01'").select("o_orderkey", "o_custkey", F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period"), "o_orderdate", "o_orderpriority")
    return versions.current_versions(rows, ["o_custkey", "period"], last_first("o_orderdate", "o_orderpriority", "o_orderkey"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, period FROM (SELECT *, date_trunc('quarter', o_orderdate)::DATE AS period, dense_rank() OVER (PARTITION BY o_custkey ORDER BY date_trunc('quarter', o_orderdate) DESC) AS r FROM orders) WHERE r <= 4 AND o_orderstatus = 'F'")
def statement_periods(spark, d):
    rows = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period"))
    return versions.last_periods(rows, "o_custkey", "period", 4).where("o_orderstatus = 'F'")


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate <= DATE '1996-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def disclosure_window(spark, d):
    rows = _read(spark, d, "orders").where("o_orderdate between timestamp_ntz'1996-01-01' and timestamp_ntz'1996-06-30'")
    return versions.current_versions(rows, ["o_custkey"], last_first("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query(f"WITH {_CAL}, n AS (SELECT cal_date, (SELECT min(m.cal_date) FROM cal m WHERE m.is_open AND m.cal_date > cal.cal_date) AS next_session FROM cal) SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS cash, next_session AS visible_on FROM orders JOIN n ON CAST(o_orderdate AS DATE) = cal_date WHERE next_session <= DATE '1998-01-01'")
def dividend_versions(spark, d):
    rows = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("cash"), F.to_date("o_orderdate").alias("day"))
    shown = versions.masked(rows, ["cash"], F.col("o_orderstatus") == "F")
    return cal.join_next_session(shown, _calendar(spark, d), "day", "visible_on").where("visible_on <= date'1998-01-01'").drop("day")


@query("SELECT o_custkey, listed, delisted FROM (SELECT o_custkey, min(o_orderdate)::DATE AS listed, max(o_orderdate)::DATE AS delisted FROM orders GROUP BY 1) WHERE listed <= DATE '1998-01-05' AND DATE '1998-01-05' < delisted")
def universe_asof(spark, d):
    lives = _read(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("listed"), F.to_date(F.max("o_orderdate")).alias("delisted"))
    return versions.valid_at(lives, "1998-01-05", "listed", "delisted")


@query("SELECT l_suppkey, in_date, p_type FROM (SELECT l_suppkey, l_shipdate::DATE AS in_date, p_type, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE in_date <= DATE '1997-06-01' QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY in_date DESC, l_orderkey DESC, l_linenumber DESC, p_type DESC) = 1")
def industry_asof(spark, d):
    rows = _read(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("in_date"), "l_partkey", "l_orderkey", "l_linenumber").where("in_date <= date'1997-06-01'")
    typed = rows.join(_read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return versions.current_versions(typed, ["l_suppkey"], last_first("in_date", "l_orderkey", "l_linenumber", "p_type")).select("l_suppkey", "in_date", "p_type")


@query("""SELECT n_name, c.n AS customers, s.n AS suppliers, CASE WHEN b.bal IS NULL THEN 'unknown' WHEN b.bal > 0 THEN 'limited' ELSE 'unlimited' END AS status FROM nation
LEFT JOIN (SELECT c_nationkey k, count(*) n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey k, count(*) n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s.k = n_nationkey
LEFT JOIN (SELECT s_nationkey k, min(s_acctbal) bal FROM supplier GROUP BY 1) b ON b.k = n_nationkey""")
def status_merge(spark, d):
    n, c, s = (_read(spark, d, t) for t in ("nation", "customer", "supplier"))
    out = n.select("n_name", F.col("n_nationkey").alias("k"))
    for other in (
        c.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers")),
        s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")),
        s.groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_acctbal").alias("bal")),
    ):
        out = out.join(other, "k", "left")
    status = F.when(F.col("bal").isNull(), "unknown").when(F.col("bal") > 0, "limited").otherwise("unlimited")
    return out.select("n_name", "customers", "suppliers", status.alias("status"))


@query("""WITH e AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'X' ELSE 'S' END AS kind, event_id % 7 = 0 AS whole, 34200 + event_id % 200 * 60 + event_id % 50 AS a, 36000 + event_id % 200 * 60 + event_id % 50 AS b FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'),
s AS (SELECT user_id, CASE WHEN whole THEN 33900 ELSE a END AS start, CASE WHEN kind = 'X' THEN NULL WHEN kind = 'R' THEN false ELSE whole OR 39600 < b END AS state, kind = 'S' AND NOT whole AND 39600 < b AS active FROM e WHERE whole OR a <= 39600),
l AS (SELECT *, max(start) OVER (PARTITION BY user_id) AS last FROM s),
t AS (SELECT user_id, bool_or(active) AS active, count(DISTINCT coalesce(CAST(state AS VARCHAR), 'unknown')) FILTER (WHERE start = last) AS kinds, bool_or(state) FILTER (WHERE start = last) AS state FROM l GROUP BY 1)
SELECT u.user_id, CASE WHEN t.user_id IS NULL THEN false WHEN active THEN true WHEN kinds = 1 THEN state END AS suspended FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN t USING (user_id)""")
def suspension_state(spark, d):
    """At 11:00: whole days, stretches with seconds, expired ones, kinds that no rule knows."""
    events = _read(spark, d, "events")
    return versions.suspended(_suspensions(events.where("to_date(ts) = date'2024-01-10'"), "user_id"), events.select("user_id").distinct(), "user_id", "11:00:00")


def _suspensions(events: DataFrame, symbol: str) -> DataFrame:
    start = F.lit(34200) + F.col("event_id") % 200 * 60 + F.col("event_id") % 50
    clock = lambda s: F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    kind = F.when(F.col("event_id") % 5 == 0, "R").when(F.col("event_id") % 5 == 1, "X").otherwise("S")
    return events.select(symbol, kind.alias("kind"), F.when(F.col("event_id") % 7 != 0, F.concat(clock(start), F.lit(" - "), clock(start + 1800))).alias("timing"))


@query("SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC) = 1")
def pk_dedup_last_wins(spark, d):
    return tables.last_wins(_read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_extendedprice"], [])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice >= 100000) OR (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice < 5000) OR (o_orderstatus NOT IN ('F', 'O') AND o_custkey <> 7)")
def dnf_filter(spark, d):
    rule = [[("o_orderstatus", "=", "F"), ("o_totalprice", ">=", 100000)], [("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), ("o_totalprice", "<", 5000)], [("o_orderstatus", "not in", ["F", "O"]), ("o_custkey", "!=", 7)]]
    return _read(spark, d, "orders").where(tables.predicate(rule)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL BY NAME SELECT o_totalprice, o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def union_by_name(spark, d):
    o = _read(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice").unionByName(o.where("o_orderstatus = 'O'").select("o_totalprice", "o_orderkey"), allowMissingColumns=True)


@query("SELECT DISTINCT 'C' || CASE WHEN o_custkey % 3 = 1 THEN o_custkey - 1 ELSE o_custkey END AS code, o_orderdate, o_totalprice, o_orderkey FROM orders UNION SELECT 'C' || CASE WHEN o_custkey % 3 = 1 THEN o_custkey - 1 ELSE o_custkey END, o_orderdate, o_totalprice, o_orderkey FROM orders WHERE o_custkey % 3 = 0")
def alias_canonical(spark, d):
    """Each third customer has a second code; rows that the source gave under both are one."""
    o = _read(spark, d, "orders").selectExpr("'C' || o_custkey code", "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    both = o.unionByName(o.where("o_custkey % 3 = 0").withColumn("code", F.expr("'C' || (o_custkey + 1)"))).drop("o_custkey")
    return _history(spark, d).canonicalise(both, "code", ["o_orderkey"])


def _history(spark, d) -> CodeHistory:
    """Customers 3k and 3k + 1 are one security, whose code changes on 1995-01-01."""
    keys = _read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    both = keys.union(keys.select(F.col("k") + 1)).distinct()
    sid = F.when(F.col("k") % 3 == 1, F.col("k") - 1).otherwise(F.col("k")) + 1
    second, paired = F.col("k") % 3 == 1, F.col("k") % 3 == 0
    known = both.select(sid.cast("long").alias("sid"), F.concat(F.lit("C"), F.col("k")).alias("code"), F.when(second, F.lit("1995-01-01")).otherwise(F.lit("1900-01-01")).cast("date").alias("valid_from"), F.when(paired, F.lit("1995-01-01").cast("date")).alias("valid_to"))
    return CodeHistory(known)


@query("SELECT 'C' || CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS code, o_orderkey FROM orders")
def alias_relabelled(spark, d):
    """Rows under the codes that are valid on a day after the change."""
    history = _history(spark, d)
    return history.relabel(history.canonicalise(_read(spark, d, "orders").selectExpr("'C' || o_custkey code", "o_orderkey"), "code"), "code", "1996-01-01")


@query("SELECT 'duplicate_key_v1' AS rule, 'ERROR' AS severity, l_orderkey || '|' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def dq_duplicate_key(spark, d):
    return checks.duplicate_keys(_read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'range_v1' AS rule, 'ERROR' AS severity, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_acctbal < 0")
def dq_range(spark, d):
    return checks.issues(_read(spark, d, "customer"), "range_v1", F.col("c_acctbal") < 0, ["c_custkey"])


@query("SELECT 'finite_float_v1' AS rule, 'ERROR' AS severity, CAST(event_id AS VARCHAR) AS key FROM events WHERE event_id % 101 = 0 UNION ALL SELECT 'required_value_v1', 'ERROR', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 103 = 0")
def dq_finite_required(spark, d):
    e = _read(spark, d, "events")
    bad = e.withColumn("value", F.when(F.col("event_id") % 101 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).withColumn("event_type", F.when(F.col("event_id") % 103 != 0, F.col("event_type")))
    return checks.finite(bad, ["value"], ["event_id"]).unionByName(checks.required(bad, ["event_type"], ["event_id"]))


@query(f"WITH {_BARS}, b AS (SELECT *, CASE WHEN volume % 3 = 0 THEN high + 1 ELSE close END AS c2 FROM bars) SELECT 'daily_ohlc_v1' AS rule, 'ERROR' AS severity, user_id || '|' || day AS key FROM b WHERE high < greatest(open, c2, low) OR low > least(open, c2, high)")
def dq_ohlc(spark, d):
    own = _bars(spark, d).withColumn("close", F.when(F.col("volume") % 3 == 0, F.col("high") + 1).otherwise(F.col("close")))
    return checks.ohlc(own, ["user_id", "day"])


@query(f"WITH {_CAL} SELECT 'missing_market_partition_v1' AS rule, 'ERROR' AS severity, CAST(x AS VARCHAR) AS key FROM (SELECT CAST(unnest(generate_series((SELECT min(cal_date) FROM cal), (SELECT max(cal_date) FROM cal), INTERVAL 1 DAY)) AS DATE) AS x) WHERE x NOT IN (SELECT cal_date FROM cal)")
def dq_missing_day(spark, d):
    days = _calendar(spark, d).select("cal_date")
    spine = days.agg(F.explode(F.sequence(F.min("cal_date"), F.max("cal_date"))).alias("cal_date"))
    return checks.uncovered(spine, days, ["cal_date"], "missing_market_partition_v1")


@query("SELECT 'daily_coverage_v1' AS rule, 'ERROR' AS severity, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dq_coverage(spark, d):
    return checks.uncovered(_read(spark, d, "orders").withColumnRenamed("o_orderkey", "k"), _read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k"), ["k"], "daily_coverage_v1")


@query("SELECT 'range_v1' AS rule, 'ERROR' AS severity, count(*) AS issues, array_to_string(list_sort(list(CAST(c_custkey AS VARCHAR)))[1:10], ',') AS sample FROM customer WHERE c_acctbal < 0")
def dq_summary(spark, d):
    return checks.summary(dq_range(spark, d))


_B = "b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice * 1.001 ELSE o_totalprice + 1e-9 END AS p FROM orders WHERE o_orderkey % 97 <> 0)"


@query(f"WITH {_B} SELECT o_orderkey, 'o_totalprice' AS field, round(o_totalprice, 6) AS left_value, round(p, 6) AS right_value, CASE WHEN p IS NULL THEN 'right_missing' WHEN abs(o_totalprice - p) <= greatest(1e-6 * greatest(abs(o_totalprice), abs(p)), 0.005) THEN 'equal' ELSE 'differs' END AS verdict FROM orders FULL JOIN b USING (o_orderkey)")
def reconcile_tolerance(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    b = o.where("o_orderkey % 97 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 89 == 0, F.col("o_totalprice") * 1.001).otherwise(F.col("o_totalprice") + 1e-9).alias("p"))
    out = checks.reconcile(o, b, ["o_orderkey"], [("o_totalprice", "p")], 1e-6, 0.005)
    return out.withColumns({c: F.round(c, 6) for c in ("left_value", "right_value")})


@query("SELECT p_partkey, CASE WHEN abs(p_size * 10.0 - p_retailprice) <= abs(p_size * 40.0 - p_retailprice) THEN p_size * 10.0 ELSE p_size * 40.0 END::DOUBLE AS nearest FROM part")
def reconcile_nearest(spark, d):
    size = F.col("p_size").cast("double")
    return _read(spark, d, "part").select("p_partkey", checks.nearest(F.col("p_retailprice"), [size * 10, size * 40]).alias("nearest"))


_ISLANDS = "r AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 20 AS e FROM orders), g AS (SELECT *, CASE WHEN s > max(e) OVER w + 1 THEN 1 ELSE 0 END AS n FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM g), m AS (SELECT o_custkey, min(s) AS start_date, max(e) AS end_date FROM i GROUP BY o_custkey, k)"


def _ranges(spark, d):
    day = F.to_date("o_orderdate")
    return _read(spark, d, "orders").select("o_custkey", day.alias("start_date"), F.date_add(day, 20).alias("end_date")).distinct()


@query(f"WITH {_ISLANDS} SELECT * FROM m")
def range_merge(spark, d):
    return tables.merge_ranges(_ranges(spark, d), ["o_custkey"])


@query(f"""WITH {_ISLANDS}, q AS (SELECT * FROM m WHERE end_date >= DATE '1996-01-01' AND start_date <= DATE '1996-12-31'),
x AS (SELECT o_custkey, coalesce(lag(end_date) OVER (PARTITION BY o_custkey ORDER BY start_date) + 1, DATE '1996-01-01') AS a, start_date - 1 AS b FROM q
UNION ALL SELECT o_custkey, max(end_date) + 1, DATE '1996-12-31' FROM q GROUP BY 1 UNION ALL SELECT DISTINCT o_custkey, DATE '1996-01-01', DATE '1996-12-31' FROM r WHERE o_custkey NOT IN (SELECT o_custkey FROM q))
SELECT o_custkey, a AS start_date, b AS end_date FROM x WHERE a <= b""")
def range_complement(spark, d):
    return tables.missing_ranges(_ranges(spark, d), ["o_custkey"], "1996-01-01", "1996-12-31")


@query(f"WITH {_BARS}, w AS (SELECT DISTINCT day FROM bars ORDER BY day DESC LIMIT 5) SELECT user_id, round(arg_max(close, day) / arg_min(close, day) - 1, 6) AS score, 0.1::DOUBLE AS weight FROM bars WHERE day IN (SELECT day FROM w) GROUP BY 1 HAVING count(*) = 5 AND bool_and(close > 0) ORDER BY arg_max(close, day) / arg_min(close, day) - 1 DESC, user_id LIMIT 10")
def momentum_topk(spark, d):
    return bars.momentum(_bars(spark, d), "user_id", "day", "close", 5, 10).withColumn("score", F.round("score", 6))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CASE WHEN q < 200 THEN 0 ELSE 200 + floor((q - 200) / 100) * 100 END AS BIGINT) AS lot FROM (SELECT *, CAST(l_quantity * 37 AS BIGINT) AS q FROM lineitem)")
def lot_rounding(spark, d):
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", trading.round_lot((F.col("l_quantity") * 37).cast("long"), F.lit(200), F.lit(100)).alias("lot"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, round(greatest(l_extendedprice * 0.00025, 5) + l_extendedprice * 0.00002 + CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 0.001 ELSE 0 END, 8) AS fee FROM lineitem")
def trade_fees(spark, d):
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(trading.fees(F.col("l_extendedprice"), F.col("l_returnflag") == "R", F.to_date("l_shipdate")), 8).alias("fee"))


@query("SELECT part, count(*) AS n, sum(least(1000, q - part * 1000)) AS total FROM (SELECT q, unnest(range(CAST(ceil(q / 1000.0) AS BIGINT))) AS part FROM (SELECT CAST(l_quantity * 97 AS BIGINT) AS q FROM lineitem) WHERE q > 0) GROUP BY 1")
def order_split(spark, d):
    rows = _read(spark, d, "lineitem").select((F.col("l_quantity") * 97).cast("long").alias("q"))
    return trading.split_orders(rows, "q", 1000).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"), F.sum("q").alias("total"))


_PATH = "p AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS equity FROM orders GROUP BY 1), e AS (SELECT *, equity / lag(equity, 1, 1e6) OVER (ORDER BY day) - 1 AS ret, greatest(max(equity) OVER (ORDER BY day), 1e6) AS peak FROM p)"


def _path(spark, d):
    daily = _read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("equity"))
    return trading.equity_path(daily, "day", "equity", 1e6)


@query(f"WITH {_PATH} SELECT count(*) AS n, round(arg_max(equity, day) / 1e6 - 1, 6) AS total_return, round(stddev_samp(ret) * sqrt(252), 5) AS volatility, round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) AS sharpe, round(min(equity / peak - 1), 6) AS max_drawdown FROM e")
def equity_metrics(spark, d):
    out = trading.metrics(_path(spark, d), "equity", "day", 1e6)
    return out.select("n", F.round("total_return", 6).alias("total_return"), F.round("volatility", 5).alias("volatility"), F.round("sharpe", 5).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"))


@query(f"WITH {_PATH} SELECT day, round(ret, 6) AS ret, round(equity / peak - 1, 6) AS drawdown FROM e")
def drawdown(spark, d):
    return _path(spark, d).select("day", F.round("ret", 6).alias("ret"), F.round("drawdown", 6).alias("drawdown"))


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_extract(spark, d):
    return _read(spark, d, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("total"))


def _shared(spark) -> str:
    """Stores and streams go to the folder that the cluster shares."""
    return folder(spark, "work")


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_dedup_latest(spark, d):
    root = _shared(spark)
    _read(spark, d, "events").repartitionByRange(4, "event_id").write.parquet(f"{root}/in")
    return replay(spark, f"{root}/in", f"{root}/checkpoint", f"{root}/out", ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT * FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 1000 QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1")
def store_round_trip(spark, d):
    """Two appends of all rows, compacted by key and read back through the manifests."""
    orders = _read(spark, d, "orders")
    table = TableConfig("orders", StructType(orders.schema.fields), ("o_orderstatus",), ("o_custkey",), ("o_custkey",), ("o_totalprice", "o_orderkey"))
    store = Store(spark, _shared(spark), {"orders": table})
    store.append("orders", orders.where("o_orderkey % 2 = 0"))
    store.append("orders", orders)
    store.compact("orders")
    return store.read("orders", filters=[[("o_orderstatus", "!=", "P")], [("o_totalprice", ">", 1000)]])
