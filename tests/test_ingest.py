import json
import time
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.errors import DataError, RequestError, UnavailableError
from tidegauge.reader import Catalog, MarketReader
from tidegauge.sources import download, ingest
from tidegauge.sources.store import Store, TableConfig
from tidegauge.streaming import sequence as sq

D = [date(2024, 1, d) for d in (2, 3, 4, 5, 8)]


class Vendor:
    """Two codes a day, three exchanges of which weekdays are open, and a plan of dividends that comes under both of its dates."""

    def __init__(self, broken=None):
        self.broken = broken

    def fetch(self, endpoint, params, limit, offset):
        if endpoint == self.broken:
            raise ValueError("down")
        if endpoint == "trade_cal":
            a, b = (ingest.parse_day(params[k]) for k in ("start_date", "end_date"))
            days = [date.fromordinal(k) for k in range(a.toordinal(), b.toordinal() + 1)]
            rows = [{"exchange": params["exchange"], "cal_date": ingest.text(d), "is_open": float(d.weekday() < 5), "pretrade_date": None} for d in days]
        elif endpoint == "daily":
            rows = [{"ts_code": c, "trade_date": params["trade_date"], "close": "1.5", "vol": float("nan")} for c in ("a", "b")]
        elif endpoint == "dividend":
            rows = [{"ts_code": "a", "end_date": "2023-12-31", "ann_date": "20240102", "imp_ann_date": "20240103", "div_proc": "x"}] if params.get("ann_date") == "20240102" or params.get("imp_ann_date") == "20240103" else []
        elif endpoint == "stock_basic":
            rows = [{"ts_code": f"{params['list_status']}{k}", "list_date": "20000101"} for k in range(7)]
        else:
            rows = []
        return rows[offset : offset + limit]


def store_of(spark, path):
    kinds = {
        "trade_cal": ("exchange string, cal_date date, is_open tinyint, pretrade_date date", "exchange", ("cal_date",)), "daily": ("ts_code string, trade_date date, close double, vol double", "trade_date", ("ts_code",)),
        "dividend": ("ts_code string, end_date date, ann_date date, imp_ann_date date, div_proc string", "end_date", ("ts_code", "ann_date", "div_proc", "imp_ann_date")), "stock_basic": ("ts_code string, list_date date", "list_date", ("ts_code",)),
    }
    return Store(spark, str(path), {n: TableConfig(n, StructType.fromDDL(k), (p,), key, key) for n, (k, p, key) in kinds.items()})


def test_pages_end_with_one_that_is_not_full():
    calls = []

    class Client:
        def fetch(self, endpoint, params, limit, offset):
            calls.append(offset)
            return [{"k": k} for k in range(offset, min(offset + limit, 7))]

    got = [r["k"] for p in ingest.pages(Client(), ingest.Request("x", (), 3)) for r in p]
    assert got == list(range(7)) and calls == [0, 3, 6]

    class Same:
        def fetch(self, *_):
            return [{"k": 1}] * 3

    with pytest.raises(DataError, match="offset"):
        list(ingest.pages(Same(), ingest.Request("x", (), 3)))


def test_patience():
    now, slept, calls = [0.0], [], []

    class Client:
        def fetch(self, *_):
            calls.append(now[0])
            if len(calls) < 4:
                raise ConnectionError
            return []

    def sleep(s):
        slept.append(s)
        now[0] += s

    client = ingest.Patient(Client(), per_minute=60, backoff=2, sleep=sleep, now=lambda: now[0])
    assert client.fetch("x", {}, 1, 0) == [] and calls == [0, 2, 6, 14]
    client.fetch("x", {}, 1, 0)
    assert calls[-1] == 15  # a request a second
    with pytest.raises(ConnectionError):
        calls.clear()
        ingest.Patient(Client(), 6e9, retries=2, sleep=sleep, now=lambda: now[0]).fetch("x", {}, 1, 0)


def test_ranges():
    assert ingest.merged([(D[2], D[3]), (D[0], D[1])]) == [(D[0], D[3])] and ingest.missing(D[0], D[4], [(D[1], D[1])]) == [(D[0], D[0]), (D[2], D[4])]
    assert ingest.missing(D[0], D[1], [(D[0], D[4])]) == [] and ingest.chunks(D[0], D[4], 3) == [(D[0], D[2]), (D[3], date(2024, 1, 7)), (D[4], D[4])]
    assert ingest.years_before(date(2024, 2, 29), 3) == date(2021, 2, 28) and ingest.parse_day("2024-01-02") == ingest.parse_day("20240102") == D[0]
    for wrong in ("2024", "x", "20241301"):
        with pytest.raises(RequestError):
            ingest.parse_day(wrong)


def test_sync_fetches_what_is_missing(spark, tmp_path):
    store = store_of(spark, tmp_path)
    sync = ingest.Sync(store, Vendor, per_minute=6e6)
    got = sync.all("20240101", "20240108")
    assert got == {"trade_cal": 24, "daily": 12, "dividend": 1, "stock_basic": 21}
    assert store.read("daily").where("vol is null and close = 1.5").count() == 12 and store.read("trade_cal").where("is_open = 1").count() == 18
    assert sync.all("20240101", "20240108") == dict.fromkeys(got, 0)
    assert sync.progress.done("daily") == [(date(2024, 1, 1), D[4])] and ("daily", "2024-01-01", "2024-01-08") in sync.progress.covered()
    assert sync.one("daily", "20240108", "20240109") == 2 and sync.one("daily", "20240108", "20240108", force=True) == 2
    assert store.read("daily").count() == 14  # one row a key, however often it came
    with pytest.raises(RequestError):
        sync.one("nope", "20240101", "20240102")
    with pytest.raises(RequestError):
        sync.some([], "20240101", "20240102")
    broken = ingest.Sync(store, lambda: Vendor("daily"), per_minute=6e6)
    with pytest.raises(Exception, match="down"):
        broken.one("daily", "20240110", "20240111")
    assert sync.progress.done("daily")[-1][1] == date(2024, 1, 9)  # what failed is not marked


def test_windows_of_a_refresh(spark, tmp_path):
    sync = ingest.Sync(store_of(spark, tmp_path), Vendor, per_minute=6e6)
    monday = sync.windows("20240108")
    assert monday["daily"] == (D[0], D[4]) and monday["adj_factor"][0] == date(2023, 12, 26) and monday["fina_audit"] and monday["income"] == (date(2023, 12, 30), D[4])
    first = sync.windows("20240201")
    assert first["income"] == (date(2021, 2, 1), date(2024, 2, 1)) and first["dividend"][0] == date(2022, 2, 1) and first["fina_audit"] is None
    got = sync.refresh("20240108")
    assert got["daily"] == 10 and got["dividend"] == 1 and got["trade_cal"] == 3 * 427
    assert sync.progress.done("daily") == []


def test_rows_must_have_their_columns(spark):
    class Short:
        def fetch(self, *_):
            return [{"a": 1}]

    with pytest.raises(Exception, match="gives no"):
        ingest.fetched(spark, [ingest.Request("x", ())], StructType.fromDDL("a int, b date"), Short, per_minute=6e6).collect()


def test_downloads(spark, tmp_path):
    store = Store(spark, str(tmp_path), download.tables())
    bars = spark.sql("select 'a' code, i index, 1.0d open, 2.0d close, double('NaN') high, 7.0d volume from values (20240102L), (20240103L) t(i)")
    calls = []

    def fetch(codes, start, end):
        calls.append((codes, start, end))
        return download.daily_rows(bars, "none")

    sync = download.DownloadSync(store, lambda: date(2024, 1, 5))
    assert sync.run("downloaded_daily", ["a", "b"], "20240101", "20240131", fetch) == 2 and calls == [(["a", "b"], "20240101", "20240104")]
    assert sync.run("downloaded_daily", ["a", "b", "c"], "20240101", "20240131", fetch) == 2 and calls[1:] == [(["c"], "20240101", "20240104")]
    row = store.read("downloaded_daily").orderBy("trade_date").first()
    assert (row.trade_date, row.open, row.high, row.volume, row.dr) == (D[0], 1.0, None, 7, None) and store.read("downloaded_daily").count() == 2
    assert sync.ranges("downloaded_daily", ["a"]).first().end_date == date(2024, 1, 4)
    minutes = download.intraday_rows(spark.sql("select 'a' code, i index, 1d open from values (20240102093000L), (1704159060000L) t(i)"), "1m", "none")
    assert sorted(r.event_time for r in minutes.collect()) == [1704159000000000, 1704159060000000] and {r.trading_date for r in minutes.collect()} == {D[0]}
    found = MarketReader(Catalog({"intraday": minutes})).at("2024-01-02 09:31:00").market.bars(["A1"], "1m", count=1)
    assert found.df.isEmpty()
    body = json.dumps({"m_timetag": "20231231", "m_anntime": 1704159000000, "x": 1})
    reports = spark.createDataFrame([("a", "Income", "20230930", body), ("b", "Income", "2023-09-30", "{}")], "code string, dataset string, index string, body string")
    got = {r.code: (r.report_date, r.disclosure_date) for r in download.financial_rows(reports).collect()}
    assert got == {"a": (date(2023, 12, 31), D[0]), "b": (date(2023, 9, 30), None)}
    factors = download.factor_rows(spark.sql("select 'a' code, '20240102' date, 1704124800000L time, 0d interest, 0d stockBonus, 0d stockGift, 0d allotNum, 0d allotPrice, 0d gugai, 2d dr"))
    assert factors.first().ex_date == D[0]
    for wrong in (lambda: download.daily_rows(bars, "back"), lambda: download.intraday_rows(bars, "2m", "none"), lambda: sync.run("downloaded_daily", [], "20240101", "20240102", fetch)):
        with pytest.raises(RequestError):
            wrong()
    with pytest.raises(DataError):
        download.daily_rows(bars.withColumn("index", F.lit("none")), "none")


def ring_of(n, capacity=10_000):
    ring = sq.Ring(capacity)
    for k in range(n):
        ring.append([(f"c{k % 3}", {"time": 1704159000000 + k, "lastPrice": float(k)})], "market", "SH", "tick", 1704159000000 + 10 * k)
    return ring


def test_a_ring_keeps_the_last_records():
    ring = ring_of(7, 5)
    assert ring.bounds() == (3, 7) and [r["seq"] for r in ring.read(4, 2)["data"]] == [4, 5] and ring.read(4, 2)["next_seq"] == 6
    assert ring.read(8)["data"] == [] and ring.read(8, wait_ms=1)["next_seq"] == 8
    for seq in (2, 9):
        with pytest.raises(sq.OutOfRange) as e:
            ring.read(seq)
        assert (e.value.oldest, e.value.newest) == (3, 7)
    import threading

    threading.Timer(0.2, ring.append, ([("x", {})], "stock", "x", "1m", 0)).start()
    began = time.monotonic()
    assert [r["code"] for r in ring.read(8, wait_ms=5_000)["data"]] == ["x"] and time.monotonic() - began < 4
    for wrong in (lambda: sq.Ring(0), lambda: ring.read(4, 0), lambda: ring.read(4, 1, -1)):
        with pytest.raises(RequestError):
            wrong()


def test_reading_on_after_a_gap():
    ring = ring_of(100, 10)
    assert sq.read_on(ring, 95, 3)[1:] == (98, 0) and sq.read_on(ring, 101)[0] == []
    records, following, lost = sq.read_on(ring, 5, 4)
    assert [r["seq"] for r in records] == [92, 93, 94, 95] and (following, lost) == (96, 87)

    class Moving:
        """Every question finds the ring twenty records further."""

        def read(self, seq, limit=1000, wait_ms=0):
            ring.append([("m", {})] * 20, "market", "SH", "tick", 0)
            return ring.read(seq, limit)

    with pytest.raises(sq.OutOfRange):
        Moving().read(5)
    assert sq.read_on(sq.Ring(), 3) == ([], 3, 0)


def test_subscriptions():
    ring = sq.Ring()
    subs = sq.Subscriptions(ring, most_stocks=2)
    assert subs.add_markets(["SH"]) == {"SH"} and subs.add_markets(["SH"]) == set() and subs.add_stocks(["a", "b"], "1m") == {"a", "b"}
    for wrong in ((["c"], "1m"), (["a"], "5m")):
        with pytest.raises(RequestError):
            subs.add_stocks(*wrong)
    subs.push_market("SH", {"a": {"p": 1}, "z": {"p": 2}}, 5)
    subs.push_stock("a", {"a": [{"p": 3}, {"p": 4}]}, 6)
    subs.push_market("SZ", {"y": {}}, 7)  # not subscribed
    assert subs.last() == {"a": {"p": 4}, "z": {"p": 2}} and ring.bounds() == (1, 4)
    assert subs.remove_stocks(["a"], "5m") == set() and subs.remove_stocks(["a"], "1m") == {"a"} and subs.last()["a"] == {"p": 1}
    assert subs.remove_markets() == {"SH"} and subs.last() == {}
    seen = []
    gate = sq.Gate(seen.append)
    gate(1)
    assert seen == []
    gate.activate()
    gate(2)
    gate.close()
    gate(3)
    gate.activate()
    assert seen == [1, 2]


def test_a_stream_of_quotes_reaches_the_store(spark, tmp_path):
    ring = ring_of(25)
    ring.append([("c9", {"time": 0, "open": 1.0, "close": 2.0})], "stock", "c9", "1m", 1704159000000)
    server = sq.serve(ring)
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        with pytest.raises(sq.OutOfRange):
            sq.SequenceClient(url).read(99)
        kind = lambda body: StructType.fromDDL(f"trading_date date, seq long, code string, received_at long, event_time long, quote struct<{', '.join(x.replace(' ', ':', 1) for x in body.split(', '))}>")
        store = Store(spark, str(tmp_path / "s"), {"ticks": TableConfig("ticks", kind(sq.TICK), ("trading_date",), ("event_time",), ("code", "event_time"), ("received_at",)), "bars": TableConfig("bars", kind(sq.BAR), ("trading_date",), (), ("code", "event_time"))})
        sq.register(spark)

        def run():
            stream = spark.readStream.format("quote_sequence").option("url", url).option("limit", 10).load()
            query = stream.writeStream.foreachBatch(sq.sink(store)).option("checkpointLocation", str(tmp_path / "c")).start()
            until = time.monotonic() + 60
            while time.monotonic() < until and store.read("ticks").count() + store.read("bars").count() < ring.next - 1:
                assert query.isActive, query.exception()
                time.sleep(0.2)
            query.stop()

        run()
        ticks = store.read("ticks")
        assert ticks.count() == 25 and ticks.agg(F.max("seq")).first()[0] == 25 and ticks.where("event_time = 1704159000000000 + 1000 * (seq - 1)").count() == 25
        bar = store.read("bars").first()
        assert (bar.code, bar.event_time, bar.trading_date, bar.quote.close) == ("c9", None, D[0], 2.0)
        ring.append([("c1", {"time": 1704159100000, "lastPrice": 9.0})], "market", "SH", "tick", 1704159100000)
        run()  # goes on where the checkpoint says
        assert store.read("ticks").count() == 26 and store.compact("ticks") == 1 and store.read("ticks").count() == 26
        last = {r.symbol: r["last"] for r in MarketReader(Catalog({"ticks": store.read("ticks").withColumn("quote", F.col("quote"))})).at("2024-01-02 23:00:00").market.ticks("*").df.collect()}
        assert last["c1"] == 9.0
    finally:
        server.shutdown()


def test_last_quotes(spark):
    rows = [(1, "a", "tick", "market", "SH", 1, "{}"), (2, "a", "1m", "stock", "a", 2, "{}"), (3, "a", "tick", "market", "SH", 3, "{}"), (4, "b", "tick", "market", "SH", 4, "{}"), (5, "b", "tick", "market", "SH", 5, "{}")]
    got = {r.code: r.seq for r in sq.last_quotes(spark.createDataFrame(rows, sq.SCHEMA)).collect()}
    assert got == {"a": 2, "b": 5}


def test_sources_refuse_what_they_cannot_do():
    for options in ({}, {"url": "http://x", "limit": "0"}, {"url": "http://x", "start": "0"}):
        with pytest.raises(RequestError):
            sq.QuoteSequence(options).simpleStreamReader(None)
    strict = sq._SequenceReader({"url": "http://x", "fail_on_loss": "true", "limit": "5"})
    strict.client = ring_of(100, 10)
    with pytest.raises(UnavailableError):
        strict.read({"seq": 1})
    strict.strict = False
    rows, end = strict.read({"seq": 1})
    assert end == {"seq": 97} and [r[0] for r in rows] == [92, 93, 94, 95, 96]
    assert [r[0] for r in strict.readBetweenOffsets({"seq": 91}, {"seq": 98})] == list(range(91, 98))
