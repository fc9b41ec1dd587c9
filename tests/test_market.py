"""Every market query against its SQL, and small cases for the operators."""

import glob
import json
import math
import os
from datetime import date

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.errors import DataError, RequestError, ResultTooLargeError, UnavailableError
from tidegauge.functions import calendar as cal
from tidegauge.functions import values
from tidegauge.operators import bars, checks, detect, rules, tables, trading, versions
from tidegauge.plans import crosscheck, quality, runs, sources, views  # noqa: F401  (they register their queries)
from tidegauge.plans.market import ORACLE_SQL, QUERIES
from tidegauge.reader import Catalog
from tidegauge.sources.store import Buffered, Conflict, Store, TableConfig

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    mine = QUERIES[name](spark, DATA)
    theirs = duck.sql(ORACLE_SQL[name])
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    key = lambda r: [repr(x) for x in r]
    assert sorted([[plain(r[c]) for c in columns] for r in mine.collect()], key=key) == sorted([[plain(r[i]) for i in at] for r in theirs.fetchall()], key=key)


#: So that small tables are joined and merged as large ones are: no broadcast, many partitions, merged by their sizes.
AS_LARGE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


@pytest.fixture
def as_large(spark):
    before = {k: spark.conf.get(k, None) for k in AS_LARGE}
    for k, v in AS_LARGE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def equals_sql_of_events(spark, folder, name, users):
    """A query against its SQL on the events of sf0.001, whose users are renamed by an SQL expression, maybe to several each."""
    con = duckdb.connect()
    con.sql(f"copy (select * exclude (user_id, k), {users} as user_id from '{DATA}/events.parquet', range(40) r(k)) to '{folder}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    theirs = con.sql(ORACLE_SQL[name])
    mine = QUERIES[name](spark, str(folder)).select(theirs.columns).collect()
    key = lambda r: [repr(x) for x in r]
    assert sorted([[plain(x) for x in r] for r in mine], key=key) == sorted([[plain(x) for x in r] for r in theirs.fetchall()], key=key)


def test_hold_of_many_runs(spark, as_large, tmp_path):
    equals_sql_of_events(spark, tmp_path, "backtest_hold", "user_id + 15 * k")


def test_hold_of_long_numbers(spark, tmp_path):
    equals_sql_of_events(spark, tmp_path, "backtest_hold", "CASE WHEN k % 20 > 0 THEN 12345600 + user_id WHEN k > 0 THEN user_id END")


def test_metrics_of_many_and_long_numbers(spark, as_large, tmp_path):
    equals_sql_of_events(spark, tmp_path, "backtest_metrics", "CASE WHEN k % 20 > 0 THEN 12345600 + user_id + k // 20 * 15 WHEN k > 0 THEN user_id END")


def test_metrics_walk_once(spark):
    plan = QUERIES["backtest_metrics"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_visibility_is_inclusive_at_the_clock(spark):
    df = spark.sql("select date'2024-01-02' as day")
    assert bars.visible_days(df, "2024-01-02 16:04:00", "16:05").count() == 0
    assert bars.visible_days(df, "2024-01-02 16:05:00", "16:05").count() == 1


def test_factor_adjustment(spark):
    own = spark.sql("select 'a' s, date'2024-01-02' day, 10d open, 12d high, 9d low, 11d close")
    factors = spark.sql("select * from values ('a', date'2024-01-02', 1d), ('a', date'2024-01-03', 2d) t(s, day, factor)")
    r = bars.adjust_by_factor(own, factors, ["s", "day"], ["open", "high", "low", "close"]).first()
    assert (r.open, r.high, r.low, r.close) == (5, 6, 4.5, 5.5)
    with pytest.raises(DataError):
        bars.adjust_by_factor(own, factors.where("day > date'2024-01-02'"), ["s", "day"], ["open"], check=True)


def test_event_adjustment_stops_at_the_anchor(spark):
    own = spark.sql("select 'a' s, date'2024-01-02' day, 10d close")
    events = spark.sql("select * from values ('a', date'2024-01-03', 2d), ('a', date'2024-01-09', 5d), ('a', date'2024-01-02', 7d) t(s, ex_date, dr)")
    assert bars.adjust_by_events(own, events, "s", "day", ["close"], "2024-01-04").first().close == 5
    assert bars.adjust_by_events(own, events.limit(0), "s", "day", ["close"], "2024-01-04").first().close == 10


def test_later_rows_change_nothing_before_them(spark):
    rows = spark.sql("select * from values ('a', date'2024-01-02', 1), ('a', date'2024-01-03', 2) t(s, day, v)")
    more = rows.union(spark.sql("select 'a', date'2024-01-09', 3"))
    at = lambda df: bars.latest(bars.visible_days(df, "2024-01-03 16:05:00", "16:05"), ["s"], values.last_first("day")).collect()
    assert at(rows) == at(more)


def test_caps_refuse(spark):
    with pytest.raises(ResultTooLargeError):
        bars.capped(spark.range(5), 4)
    assert bars.capped(spark.range(5), 5).count() == 5
    with pytest.raises(RequestError):
        bars.latest(spark.range(2), ["id"], [F.col("id")], 0)


def test_momentum_needs_every_day(spark):
    df = spark.sql("select * from values ('a',1,1.0d),('a',2,1.1d),('a',3,1.2d),('b',1,1.0d),('b',3,9.0d),('c',1,1.0d),('c',2,double('nan')),('c',3,2.0d) t(s, day, close)")
    rows = bars.momentum(df, "s", "day", "close", 3, 5).collect()
    assert [r.s for r in rows] == ["a"] and math.isclose(rows[0].score, 0.2)


def test_next_session_must_be_covered(spark):
    known = spark.sql("select * from values (date'2024-01-05', true), (date'2024-01-06', false), (date'2024-01-08', true) t(cal_date, is_open)")
    df = cal.join_next_session(spark.sql("select date'2024-01-06' as day"), known, "day")
    assert str(df.first().next_session) == "2024-01-08"
    cal.require_covered(df)
    with pytest.raises(DataError):
        cal.require_covered(cal.join_next_session(spark.sql("select date'2024-01-08' as day"), known, "day"))


def test_last_wins_with_null_keys_and_preference(spark):
    df = spark.sql("select * from values (cast(null as string), 1, 1), (null, 2, 2), ('x', 3, 1), ('x', 1, 2) t(k, v, p)")
    assert {(r.k, r.v) for r in tables.last_wins(df, ["k"], [], ["p"]).collect()} == {(None, 2), ("x", 1)}
    assert {(r.k, r.v) for r in tables.last_wins(df, ["k"], ["v"], ["p"]).collect()} == {(None, 2), ("x", 3)}


def test_filters(spark):
    df = spark.range(10).withColumn("n", F.when(F.col("id") > 2, F.col("id")))
    ids = lambda f: [r.id for r in df.where(tables.predicate(f)).collect()]
    assert ids([("n", "=", None), ("id", ">=", 1)]) == [1, 2]
    assert ids([[("id", "in", [4])], [("n", "not in", [3, 4, 5, 6, 7, 8])]]) == [4, 9]
    with pytest.raises(RequestError):
        tables.predicate([("id", "~", 1)])


@pytest.mark.parametrize("timing,states", [
    ("09:30-09:40,09:40-09:50", {"09:29": None, "09:30": True, "09:40": True, "09:45": True, "09:50": False}),
    ("9:30-9:40", {"09:35": True, "09:40": False}),
    ("09:30-09:40,10:00-10:10", {"09:45": False, "10:00": True, "10:10": False}),
    ("09:40-09:45,09:30-11:00", {"09:50": True}),
    (" 9:30 - 9:40 , 09:40-09:50 ", {"09:45": True}),
    ("09:34:21-09:44:21,09:46:15-09:56:15", {"09:34:20": None, "09:34:21": True, "09:44:20": True, "09:44:21": False, "09:46:15": True, "09:56:15": False}),
])
def test_stretches_of_a_suspension(spark, timing, states):
    events = spark.createDataFrame([("a", "S", timing)], "s string, kind string, timing string")
    for clock, want in states.items():
        assert versions.suspended(events, events.select("s"), "s", clock, covered=False).first().suspended is want, clock


def test_suspension_states(spark):
    rows = [("a", "S", None), ("b", "S", "9:30-10:00"), ("c", "S", "9:30-12:00"), ("d", "S", "9:30-9:40"), ("d", "R", "9:30-9:50"), ("e", "R", None), ("g", "S", None), ("g", "R", "10:00-15:00"), ("h", "X", None),
            ("i", "S", "9:30-12:00"), ("i", "R", None), ("j", "S", None), ("j", "R", None), ("k", "X", "10:00-10:01"), ("l", "S", "11:00:01-12:00"), ("m", "S", "10:00-12:00"), ("m", "R", "10:30-12:00")]
    events = spark.createDataFrame(rows, "s string, kind string, timing string")
    everyone = spark.sql("select explode(split('a,b,c,d,e,f,g,h,i,j,k,l,m', ',')) s")
    found = {r.s: r.suspended for r in versions.suspended(events, everyone, "s", "11:00").collect()}
    assert found == {"a": True, "b": False, "c": True, "d": False, "e": False, "f": False, "g": False, "h": None, "i": True, "j": None, "k": None, "l": False, "m": True}
    assert versions.suspended(events, spark.sql("select 'f' s"), "s", "11:00", covered=False).first().suspended is None
    assert versions.suspended(events, spark.sql("select 'a' s"), "s", "09:24:59").first().suspended is False
    for bad in ("9:30-9:40,bad", "9:30-9:40,", "9:30-9:40extra", "", "24:00-24:01", "9:40-9:40", "9:60-10:00"):
        with pytest.raises(UnavailableError):
            versions.suspended(spark.createDataFrame([("a", "S", bad)], events.schema), everyone, "s", "9:00")


def test_sessions_after_days_that_a_calendar_lacks(spark):
    sparse = spark.sql("select date(c) cal_date, o is_open from values ('2024-01-02', true), ('2024-01-03', false), ('2024-01-08', true), ('2024-01-08', false), ('2024-01-20', true) t(c, o)")
    days = spark.sql("select date(d) d from values ('2023-12-25'), ('2024-01-01'), ('2024-01-02'), ('2024-01-05'), ('2024-01-08'), ('2024-01-19'), ('2024-01-20'), ('2024-02-01'), (null) t(d)")
    found = {str(r.d): str(r.n) for r in cal.join_next_session(days, sparse, "d", "n").collect()}
    assert found == {"2023-12-25": "2024-01-02", "2024-01-01": "2024-01-02", "2024-01-02": "2024-01-08", "2024-01-05": "2024-01-08", "2024-01-08": "2024-01-20", "2024-01-19": "2024-01-20", "2024-01-20": "None", "2024-02-01": "None", "None": "None"}
    cal.require_reached(days.where("d < '2024-01-20'"), "d", cal.open_bounds(sparse)[1])
    with pytest.raises(DataError):
        cal.require_reached(days, "d", cal.open_bounds(sparse)[1])


def test_reconcile_and_outcome(spark):
    a = spark.sql("select * from values (1, 10.0d), (2, 5.0d), (3, null) t(k, x)")
    b = spark.sql("select * from values (1, 10.004d), (4, 1.0d), (3, null) t(k, y)")
    found = {r.k: r.verdict for r in checks.reconcile(a, b, ["k"], [("x", "y")], 0, 0.005).collect()}
    assert found == {1: "equal", 2: "right_missing", 4: "left_missing"}
    broken = checks.issues(a, "r", F.col("x") > 6, ["k"], "WARNING")
    assert checks.outcome(broken) == "WARN" and checks.outcome(broken.limit(0)) == "PASS"


def test_fees_and_lots(spark):
    r = spark.sql("select 10000d a").select(
        trading.fees(F.col("a"), F.lit(True), F.lit("2023-08-27").cast("date")).alias("old"), trading.fees(F.col("a"), F.lit(True), F.lit("2023-08-28").cast("date")).alias("new"),
        trading.round_lot(F.lit(199), F.lit(200), F.lit(1)).alias("none"), trading.round_lot(F.lit(399), F.lit(100), F.lit(100)).alias("lot"),
    ).first()
    assert math.isclose(r.old, 5 + 0.1 + 10) and math.isclose(r.new, 5 + 0.1 + 5) and (r.none, r.lot) == (0, 300)


def test_epoch_units(spark):
    r = spark.sql("select 1700000000L s, 1700000000000L ms, 1700000000000000L us, 1700000000000000000L ns").first()
    df = spark.createDataFrame([(x,) for x in r], "x long").select(values.epoch_micros(F.col("x")).alias("x"))
    assert {x.x for x in df.collect()} == {1700000000000000}


def test_store(spark, tmp_path):
    kind = spark.createDataFrame([], "day string, id long, value double").schema
    store = Store(spark, str(tmp_path), {"t": TableConfig("t", kind, ("day",), ("id",), ("id",))})
    row = lambda *r: spark.createDataFrame(list(r), kind)
    store.append("t", row(("a", 2, 1.0), ("a", 1, 1.0), (None, 1, 5.0)))
    store.append("t", row(("a", 1, 2.0)))
    assert store.read("t").count() == 4 and store.read("t", [(None,)]).count() == 1
    assert store.compact("t", ("a",)) and not store.compact("t", ("a",))
    assert [(r.id, r.value) for r in store.read("t", [("a",)]).collect()] == [(1, 2.0), (2, 1.0)]
    with pytest.raises(DataError):
        store.replace("t", ("a",), row(("b", 1, 1.0)))
    store.replace("t", ("a",), row())
    assert store.read("t").count() == 1
    store.append("t", spark.sql("select 7 id, 'c' day, 1 value"))  # in another order, types that fit
    assert store.read("t", "c").first().value == 1.0 and store.read("t", {"day": "c"}).count() == store.read("t", [("c",), ("d",)]).count() == 1
    with pytest.raises(DataError):
        store.append("t", row().drop("id"))
    for wrong in ({"id": 1}, ("a", "b")):
        with pytest.raises(RequestError):
            store.read("t", wrong)
    again = Store.open(spark, str(tmp_path))
    assert again.tables["t"] == store.tables["t"] and again.read("t").count() == 2


def test_partitions_are_pruned_by_filters(spark, tmp_path):
    kind = spark.sql("select date'2024-01-01' day, 1 k, 1.0d v").schema
    store = Store(spark, str(tmp_path), {"t": TableConfig("t", kind, ("day", "k"))})
    store.append("t", spark.sql("select date_add(date'2024-01-01', cast(id % 5 as int)) day, if(id % 3 = 0, null, cast(id % 3 as int)) k, id * 1d v from range(30)").coalesce(1))
    read = lambda *f: store.read("t", filters=list(f))
    files = lambda *f: len(read(*f).inputFiles())
    assert files(("v", ">=", 0.0)) == 15 and files(("day", "=", "2024-01-02")) == 3 and files(("day", ">", date(2024, 1, 3)), ("k", "=", None)) == 2
    assert files([("day", "=", "2024-01-01"), ("k", "in", [1])], [("k", "=", 2), ("v", ">", 100.0)]) == 6 and read(("k", "=", None)).count() == 10
    assert read(("k", "!=", None), ("day", "not in", ["2024-01-01"])).count() == 16
    assert store.read("t", {"day": date(2024, 1, 1), "k": None}).count() == 2


def test_two_writers_of_a_partition(spark, tmp_path):
    kind = spark.sql("select 'a' day, 1L id").schema
    made = lambda: Store(spark, str(tmp_path), {"t": TableConfig("t", kind, ("day",), ("id",), ("id",))}, grace=0)
    one, two = made(), made()
    one.append("t", spark.sql("select 'a' day, id from range(5)"))
    (folder,) = one.folders("t")
    stale = one.manifest(folder)
    two.append("t", spark.sql("select 'a' day, id from range(5, 9)"))
    with pytest.raises(Conflict):
        one._commit(folder, stale, [])
    one.append("t", spark.sql("select 'a' day, id from range(9, 10)"))
    assert one.read("t").count() == two.read("t").count() == 10
    for k in range(20):
        two.append("t", spark.sql(f"select 'a' day, {k}L id"))
    with pytest.raises(Conflict):  # the manifests that it knew are gone
        one._commit(folder, stale, [])
    assert two.compact("t") == 1 and two.compact("t") == 0 and sorted(r.id for r in two.read("t").collect()) == sorted({*range(10), *range(20)})


def test_older_manifests_and_missing_files(spark, tmp_path):
    kind = spark.sql("select 'a' day, 1L id").schema
    store = Store(spark, str(tmp_path), {"t": TableConfig("t", kind, ("day",), (), ("id",))})
    store.append("t", spark.sql("select 'a' day, 1L id"))
    (folder,) = store.folders("t")
    name = store.manifest(folder)["files"][0]
    store._fs().delete(store._path(f"{folder}/_manifest.1.json"), False)
    with open(f"{tmp_path}/{folder}/_manifest.json", "w") as f:
        f.write(json.dumps({"version": 1, "files": [name]}))
    assert store.read("t").count() == 1 and store.manifest(folder)["file_committed_at"] == {name: 0}
    store.append("t", spark.sql("select 'a' day, 2L id"))
    assert store.read("t").count() == 2
    os.remove(f"{tmp_path}/{folder}/{name}")
    with pytest.raises(UnavailableError):
        store.read("t")
    with open(f"{tmp_path}/{folder}/_manifest.9.json", "w") as f:
        f.write('{"files": ["../x"]}')
    with pytest.raises(ValueError):
        store.manifest(folder)


def test_buffered_rows(spark, tmp_path):
    kind = spark.sql("select 'a' day, 1L id").schema
    store = Store(spark, str(tmp_path), {"t": TableConfig("t", kind, ("day",), (), ("id",))})
    rows = lambda *ids: pa.table({"id": list(ids), "day": ["a"] * len(ids)})
    with Buffered(store, rows=3) as held:
        held.append("t", rows(1))
        held.append("t", rows())
        assert store.read("t").isEmpty()
        held.append("t", rows(2, 3))
        assert store.read("t").count() == 3
        held.append("t", rows(4))
        with pytest.raises(DataError):
            held.append("t", pa.table({"id": [1]}))
    held.close()
    assert store.read("t").count() == 4
    with pytest.raises(RequestError):
        held.append("t", rows(5))


def test_files_of_a_store_are_checked(spark, tmp_path):
    kind = spark.sql("select 'a' day, 1L id").schema
    store = Store(spark, str(tmp_path), {"t": TableConfig("t", kind, ("day",), (), ("id",))})
    store.append("t", spark.sql("select explode(array('a', 'b', 'c', 'd', 'e f')) day, 1L id"))
    assert detect.file_issues(store, "t").collect() == []
    a, b, c, d, _ = store.folders("t")
    (file_a,), (file_b,), (file_d,) = (store.manifest(x)["files"] for x in (a, b, d))
    for crc in glob.glob(f"{tmp_path}/t/*/.*.crc"):
        os.remove(crc)
    os.replace(f"{tmp_path}/{a}/{file_a}", f"{tmp_path}/{b}/{file_b}")  # a's file is missing, b has a's row
    with open(f"{tmp_path}/{c}/_manifest.7.json", "w") as f:
        f.write("no json")
    spark.sql("select 'd' day, 'x' id").coalesce(1).write.parquet(f"{tmp_path}/other")
    os.replace(glob.glob(f"{tmp_path}/other/*.parquet")[0], f"{tmp_path}/{d}/{file_d}")
    found = {(r.rule, r.partition) for r in detect.file_issues(store, "t").where("rule <> 'partition_value_v1'").collect()}
    assert found == {("manifest_file_missing_v1", a), ("manifest_v1", c), ("schema_v1", d)}
    with open(f"{tmp_path}/{d}/{file_d}", "w") as f:
        f.write("no parquet")
    assert "parquet_read_v1" in {r.rule for r in detect.file_issues(store, "t").where("rule <> 'partition_value_v1'").collect()}
    store.replace("t", "d", spark.sql("select 'd' day, 1L id"))
    store.replace("t", "c", spark.sql("select 'c' day, 1L id")) if store._put(f"{c}/_manifest.8.json", '{"files": []}') else None
    assert [r.partition for r in detect.misplaced(store, "t").collect()] == ["t/day=value%3Ab"]


def test_reports(spark, tmp_path):
    frames = {"adj_factor": spark.sql("select date'2024-01-02' trade_date, 'a' ts_code, 0d adj_factor"), "daily_basic": spark.createDataFrame([], "trade_date date, ts_code string, " + ", ".join(f"{c} double" for c in rules.NOT_NEGATIVE)),
              "stock_basic": spark.sql("select date'2024-01-02' list_date, 'a.SH' ts_code, 'a' symbol, 'SSE' exchange, 'L' list_status, cast(null as date) delist_date"),
              "trade_cal": spark.sql("select e exchange, date'2024-01-02' cal_date, 1 is_open, date'2023-12-29' pretrade_date from values ('SSE'), ('SZSE') t(e)")}
    catalog = Catalog(frames)
    found = detect.detect(frames, "2024-01-03", snapshot_id=catalog.snapshot_id)
    assert not found.passed and found.row_counts == {"stock_basic": 1, "daily_basic": 0, "adj_factor": 1, "trade_cal": 2}
    bad = {(d, r): s for d, r, s, _ in found.checks if s != "PASS"}
    assert bad == {("adj_factor", "adj_factor_positive_v1"): "FAIL", ("daily_basic", "dataset_empty_v1"): "FAIL", ("trade_cal", "calendar_date_coverage_v1"): "FAIL"}
    found.write(str(tmp_path / "report"))
    again = detect.read_report(spark, str(tmp_path / "report"))
    assert again.checks == found.checks and again.row_counts == found.row_counts and sorted(r.issue_id for r in again.issues.collect()) == sorted(r.issue_id for r in found.issues.collect())
    checked = catalog.with_status(found.status())
    assert checked.table("stock_basic").count() == 1
    with pytest.raises(UnavailableError):
        checked.table("adj_factor")
    assert detect.detect(frames, "2024-01-02", "2024-01-02", ["trade_cal", "stock_basic"]).passed
    row = again.issues.where("rule = 'adj_factor_positive_v1'").first()
    assert (row.key, row.day, row.fix) == ('{"trade_date":"2024-01-02","ts_code":"a"}', date(2024, 1, 2), "MANUAL")
    for wrong in (lambda: detect.detect(frames, "2024-01-02", datasets=["x"]), lambda: detect.detect(frames, "2024-01-02", "2024-01-03"), lambda: detect.read_report(spark, str(tmp_path / "report" / "part*"[:0]) + "/_SUCCESS")):
        with pytest.raises(RequestError):
            wrong()


def test_a_sample_is_drawn_by_its_seed(spark):
    from tidegauge.operators import crosscheck as xc

    rows = spark.sql("select 'c' || id ts_code, date'2024-01-02' trade_date, 1d open, 1d high, 1d low, 1d close, 1d vol, 1d amount from range(30)")
    one, two, other = (xc.sample_codes(rows, "2024-01-01", "2024-01-31", 5, seed) for seed in (1, 1, 2))
    assert one == two == sorted(one) != other and len(xc.sample_codes(rows, "2024-01-01", "2024-01-31", 99)) == 30
    for wrong, kind in ((lambda: xc.sample_codes(rows, "2024-01-01", "2024-01-31", 0), RequestError), (lambda: xc.sample_codes(rows, "2023-01-01", "2023-01-31", 5), UnavailableError), (lambda: xc.crosscheck({"daily": rows}, "2024-01-01", "2024-01-31"), UnavailableError)):
        with pytest.raises(kind):
            wrong()
    theirs = rows.selectExpr("ts_code code", "trade_date", "'none' adjustment", "open", "high", "low", "if(ts_code = 'c3', 2d, close) close", "vol volume", "amount * 1000 amount")
    factors = rows.selectExpr("ts_code", "trade_date", "1d adj_factor")
    found = xc.crosscheck({"daily": rows, "adj_factor": factors, "downloaded_daily": theirs}, "2024-01-01", "2024-01-31", 30)
    assert found.counts == {"daily_none": {"compared": 180, "differences": 1}} and not found.passed and found.differences.first().code == "c3"


def test_replay_makes_batches_one_table_and_goes_on(spark, tmp_path):
    from tidegauge.streaming.quotes import replay

    rows = lambda k: spark.createDataFrame([(k % 3, k), (9, k)], "s int, t int").coalesce(1)
    run = lambda: {r.s: r.t for r in replay(spark, str(tmp_path / "in"), str(tmp_path / "c"), str(tmp_path / "out"), ["s"], ["t"], every=3).collect()}
    for k in range(5):
        rows(k).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {0: 3, 1: 4, 2: 2, 9: 4} and os.path.exists(tmp_path / "out" / "upto=2") and not os.path.exists(tmp_path / "out" / "upto=4")
    for k in (5, 6):
        rows(k).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == run() == {0: 6, 1: 4, 2: 5, 9: 6} and os.path.exists(tmp_path / "out" / "upto=5")
