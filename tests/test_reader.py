from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidegauge import fields
from tidegauge.errors import DataError, MappingError, RequestError, ResultTooLargeError, UnavailableError
from tidegauge.identity import CodeHistory
from tidegauge.reader import ALL_SYMBOLS, Adapter, Catalog, MarketReader

A, B = "600000.SH", "000001.SZ"


@pytest.fixture(scope="module")
def frames(spark):
    q = spark.sql
    day = "date'2024-01-0{}'"
    d2, d3, d4, d5, d8 = (day.format(k) for k in (2, 3, 4, 5, 8))
    return {
        "trade_cal": q(f"select 'SSE' exchange, cast(1 as byte) is_open, c cal_date, p pretrade_date from values ({d2}, date'2023-12-29'), ({d3}, {d2}), ({d4}, {d3}), ({d5}, {d4}), ({d8}, {d5}) t(c, p) union all select 'SSE', cast(0 as byte), c, {d5} from values (date'2024-01-06'), (date'2024-01-07') u(c)"),
        "daily": q(f"select ts_code, trade_date, p open, p + 1 high, p - 1 low, p + 0.5d close, p pre_close, 10d vol, 2d amount from values ('{A}', {d2}, 10d), ('{A}', {d3}, 11d), ('{A}', {d4}, 12d), ('{B}', {d2}, 20d), ('{B}', {d3}, 21d) t(ts_code, trade_date, p)"),
        "adj_factor": q(f"select * from values ('{A}', {d2}, 1d), ('{A}', {d3}, 2d), ('{A}', {d4}, 2d), ('{B}', {d2}, 1d), ('{B}', {d3}, 1d) t(ts_code, trade_date, adj_factor)"),
        "suspend_d": q(f"select * from values ('{A}', {d3}, 'S', '9:30-10:00') t(ts_code, trade_date, suspend_type, suspend_timing)"),
        "stk_limit": q(f"select * from values ('{A}', {d3}, 12d, 9d), ('{B}', {d3}, 1d, 2d) t(ts_code, trade_date, up_limit, down_limit)"),
        "stock_st": q(f"select * from values ('{B}', {d3}, 'ST', cast(null as string)) t(ts_code, trade_date, type, type_name)"),
        "income": q(f"select * from values ('{A}', date'2023-09-30', {d2}, {d2}, '1', '1', '0', 5d), ('{A}', date'2023-09-30', {d2}, {d3}, '1', '1', '1', 6d), ('{A}', date'2023-06-30', {d2}, {d2}, '1', '1', '0', 4d) t(ts_code, end_date, ann_date, f_ann_date, report_type, comp_type, update_flag, revenue)").selectExpr("*", *[f"0d {c}" for c in fields.INCOME.values() if c != "revenue"]),
        "dividend": q(f"select * from values ('{A}', date'2023-06-30', {d2}, '预案', cast(null as date), {d5}, 0.1d), ('{A}', date'2023-06-30', {d2}, '实施', {d3}, {d5}, 0.1d) t(ts_code, end_date, ann_date, div_proc, imp_ann_date, ex_date, cash_div)").selectExpr("*", "0d stk_div", "0d stk_bo_rate", "0d stk_co_rate", "cash_div cash_div_tax", "ex_date record_date", "ex_date pay_date", "cast(null as date) div_listdate", "end_date base_date", "1d base_share"),
        "stock_basic": q(f"select * from values ('{A}', 'SSE', 'main', 'CNY', date'2000-01-01', null), ('{B}', 'SZSE', 'main', 'CNY', {d4}, null), ('900001.SH', 'SSE', 'main', 'CNY', date'2000-01-01', {d3}) t(ts_code, exchange, market, curr_type, list_date, delist_date)"),
        "sw_industry": q(f"select * from values ('{A}', date'2010-01-01', {d3}, 'x', 'old'), ('{A}', {d3}, null, 'y', 'new') t(ts_code, in_date, out_date, l1_code, l1_name)"),
        "intraday": q(f"select '{A}' code, '1m' period, 'none' adjustment, {d3} trading_date, t event_time, 1d open, 1d high, 1d low, 1d close, 1d preClose, 3d volume, 1d amount from values (1704245400000000L), (1704245460000000L), (1704245520000000L) t(t)"),
        "ticks": q(f"select '{A}' code, {d3} trading_date, 1704245400000L event_time, t received_at, s seq, named_struct('open', 1d, 'high', 1d, 'low', 1d, 'lastPrice', p, 'lastClose', 1d, 'volume', 7L, 'pvolume', if(s = 2, 701L, null), 'amount', 1d) quote from values (1704245400000000L, 1L, 5d), (1704245400000000L, 2L, 6d), (1704249000000000L, 3L, 7d) t(t, s, p)"),
    }


@pytest.fixture(scope="module")
def reader(frames):
    return MarketReader(Catalog(frames, covered=(("suspend_d", "2024-01-01", "2024-01-31"),)), {"current": "daily"})


def test_daily_bars_hold_back_the_unfinished_day(reader):
    early, late = (reader.at(f"2024-01-03 16:0{m}:00").market.bars([A], "1d", count=5).sorted.collect() for m in (4, 5))
    assert [r.open for r in early] == [10] and [(r.open, r.volume, r.amount) for r in late] == [(10, 1000, 2000), (11, 1000, 2000)]
    got = reader.at("2024-01-05 00:00:00").market.bars(ALL_SYMBOLS, "1d", start="2024-01-03 09:30:00", end="2024-01-04 09:30:00", fields=["close"], order="desc").sorted
    assert got.columns == ["symbol", "interval_start", "interval_end", "close"] and [r.symbol for r in got.collect()] == [B, A]
    assert reader.at("2024-01-05 00:00:00").market.bars([], "1d", count=1).df.isEmpty()


def test_forward_adjustment_uses_the_visible_anchor(reader):
    rows = lambda t: [r.open for r in reader.at(t).market.bars([A], "1d", count=9, adjustment="forward").sorted.collect()]
    assert rows("2024-01-02 16:05:00") == [10] and rows("2024-01-03 09:25:00") == [5] and rows("2024-01-04 16:05:00") == [5, 11, 12]


def test_intraday_bars_and_ticks(reader):
    view = reader.at("2024-01-03 09:31:00")
    rows = view.market.bars([A], "1m", count=9).sorted.collect()
    assert [(r.interval_start, r.interval_end, r.volume) for r in rows] == [(datetime(2024, 1, 3, 9, 15), datetime(2024, 1, 3, 9, 30), 300), (datetime(2024, 1, 3, 9, 30), datetime(2024, 1, 3, 9, 31), 300)]
    assert [(r["last"], r.volume) for r in view.market.ticks([A]).df.collect()] == [(6, 701)]
    live = MarketReader(reader.catalog).at("2024-01-03 10:31:00").market.current([A])
    assert live.sources == ("ticks",) and [(r["last"], r.volume) for r in live.df.collect()] == [(7, 700)]


def test_current_masks_the_rest_of_the_day(reader):
    early, late = (reader.at(t).market.current([A]).df.first() for t in ("2024-01-03 09:30:00", "2024-01-03 16:05:00"))
    assert (early.open, early.high, early["last"]) == (11, None, None) and (late.high, late["last"]) == (12, 11.5)
    assert reader.at("2024-01-03 09:29:00").market.current([A]).df.isEmpty()


def test_status(reader):
    rows = {r.symbol: r for r in reader.at("2024-01-03 09:45:00").market.status([A, B]).df.collect()}
    assert (rows[A].suspended, rows[A].price_limit_status, rows[A].st_type) == (True, "limited", None)
    assert (rows[B].suspended, rows[B].price_limit_status, rows[B].st_type) == (False, "unknown", "ST")
    assert reader.at("2024-02-03 09:45:00").market.status([B], ["suspended"]).df.first().suspended is None
    with pytest.raises(RequestError):
        reader.at("2024-01-03 09:45:00").market.status(ALL_SYMBOLS)


def test_statements_are_visible_a_session_later(reader):
    get = lambda t, **k: [(r.period_end, r.operating_revenue) for r in reader.at(t).fundamentals.statements("income", [A], **k).sorted.collect()]
    q2, q3 = date(2023, 6, 30), date(2023, 9, 30)
    assert get("2024-01-03 09:24:00") == [] and get("2024-01-03 09:25:00") == [(q3, 5), (q2, 4)]
    assert get("2024-01-04 09:25:00", periods=1) == [(q3, 6)] and get("2024-01-04 09:25:00", company_type="bank") == []
    shown = reader.at("2024-01-04 09:25:00").fundamentals.statements("income", [A], fields=["operating_revenue"], company_type="industrial").df
    assert shown.columns == ["symbol", "period_end", "visible_at", "announcement_date", "actual_announcement_date", "company_type", "operating_revenue"] and shown.count() == 2
    whole = reader.at("2024-01-04 09:25:00").fundamentals.statements("income", [A]).df
    assert len(whole.columns) == 6 + 39


def test_a_calendar_that_ends_too_early_is_an_error(frames, reader):
    short = Catalog({**frames, "trade_cal": frames["trade_cal"].where("cal_date <= date'2024-01-03'")})
    with pytest.raises(DataError):
        MarketReader(short).at("2024-01-03 09:25:00").fundamentals.statements("income", [A])


def test_dividends(reader):
    rows = reader.at("2024-01-04 09:25:00").corporate_actions.dividends([A]).sorted.collect()
    assert [(r.div_proc, r.ex_date, r.visible_at, r.base_share) for r in rows] == [("预案", None, datetime(2024, 1, 3, 9, 25), None), ("实施", date(2024, 1, 5), datetime(2024, 1, 4, 9, 25), 10000)]
    assert reader.implemented_dividends().count() == 1 and reader.security_lifecycles().count() == 3


def test_validity_and_calendar(reader):
    names = lambda t: [r.symbol for r in reader.at(t).reference.stocks().sorted.collect()]
    assert names("2024-01-02 10:00:00") == [A, "900001.SH"] and names("2024-01-04 09:25:00") == [B, A]
    assert [reader.at(f"2024-01-0{d} 12:00:00").classification.industry([A]).df.first().industry_name for d in (2, 3)] == ["old", "new"]
    with pytest.raises(UnavailableError):
        reader.at("2021-08-02 09:24:00").classification.industry([A])
    assert reader.at("2024-01-08 00:00:00").calendar.previous_session() == date(2024, 1, 5)
    assert reader.at("2024-01-02 00:00:00").calendar.previous_session() is None
    assert reader.at("2024-01-04 00:00:00").calendar.sessions("2024-01-03").df.count() == 2


def test_requests_are_checked(frames, reader):
    view = reader.at("2024-01-04 16:05:00")
    for call in (lambda: view.market.bars(["x y"], "1d", count=1), lambda: view.market.bars([A, A], "1d", count=1), lambda: view.market.bars([A], "2m", count=1), lambda: view.market.bars([A], "1d"),
                 lambda: view.market.bars([A], "1d", count=1, fields=["nope"]), lambda: reader.at("today"), lambda: MarketReader(reader.catalog, {"nope": "x"}), lambda: view.market.bars([A], "1d", count=1, order="up")):
        with pytest.raises(RequestError):
            call()
    with pytest.raises(UnavailableError):
        MarketReader(Catalog(frames, frozenset({"daily"}))).at("2024-01-04 16:05:00").market.bars([A], "1d", count=1)
    small = MarketReader(reader.catalog, cap=2).at("2024-01-05 00:00:00").market
    with pytest.raises(ResultTooLargeError):
        small.bars([A], "1d", count=3).to_pandas()
    assert sum(b.num_rows for b in small.bars([A], "1d", count=2).iter_batches()) == 2


OLD = "600999.SH"


def test_renamed_codes_are_one_security(spark, frames):
    history = CodeHistory.of(spark, [(1, OLD, "2000-01-01", "2024-01-03"), (1, A, "2024-01-03", None), (2, B, "2000-01-01", None)])
    daily = frames["daily"].withColumn("ts_code", F.when((F.col("ts_code") == A) & (F.col("trade_date") < "2024-01-03"), OLD).otherwise(F.col("ts_code")))
    reader = MarketReader(Catalog({**frames, "daily": daily}), history=history)
    for asked in ([A], [OLD]):
        bars = reader.at("2024-01-04 16:05:00").market.bars(asked, "1d", count=9)
        assert [(r.symbol, r.open, r.sid) for r in bars.sorted.collect()] == [(A, 10, 1), (A, 11, 1), (A, 12, 1)] and bars.df.columns[-1] == "sid"
    before = reader.at("2024-01-02 16:05:00").market.bars([A], "1d", count=9).sorted.collect()
    assert [(r.symbol, r.open) for r in before] == [(OLD, 10)]
    both = MarketReader(Catalog({**frames, "daily": frames["daily"].union(frames["daily"].where(f"ts_code = '{A}'").withColumn("ts_code", F.lit(OLD)).withColumn("open", F.lit(1.0)))}), history=history)
    with pytest.raises(MappingError):
        both.at("2024-01-04 16:05:00").market.bars([A], "1d", count=9)
    same = MarketReader(Catalog({**frames, "daily": frames["daily"].union(frames["daily"].where(f"ts_code = '{A}'").withColumn("ts_code", F.lit(OLD)))}), history=history)
    assert same.at("2024-01-04 16:05:00").market.bars([A], "1d", count=9).df.count() == 3
    status = reader.at("2024-01-03 09:45:00").market.status([OLD, B])
    assert {r.symbol: r.suspended for r in status.df.collect()} == {A: True, B: None}
    with pytest.raises(MappingError):
        reader.at("2024-01-03 09:45:00").market.status(["000002.SZ"])


def test_code_histories(spark):
    history = CodeHistory.of(spark, [(1, OLD, "2000-01-01", "2024-01-03"), (1, A, "2024-01-03", None)])
    assert history.sid(OLD) == history.sid(A) == 1 and history.aliases(1) == (OLD, A) and history.canonical(A) == OLD
    assert history.code_at(1, date(2024, 1, 2)) == OLD and history.symbols_at([OLD, A], date(2024, 1, 3)) == (A,) and history.canonical_symbols([A, OLD]) == (OLD,)
    rows = spark.sql(f"select * from values ('{OLD}', date'2024-01-02'), ('{OLD}', date'2024-01-03'), ('{A}', date'2024-01-02'), (null, date'2024-01-02') t(c, d)")
    assert sorted(map(str, history.relabel_by_day(rows, "c", "d").select("c").toPandas().c)) == sorted(map(str, [OLD, A, OLD, None]))
    with pytest.raises(Exception, match="no code of the day"):
        history.relabel_by_day(rows.selectExpr("c", "date'1990-01-01' d"), "c", "d").collect()
    for call in (lambda: history.sid("x"), lambda: history.code_at(1, date(1999, 1, 1)), lambda: history.aliases(2)):
        with pytest.raises(MappingError):
            call()
    for rows in ([], [(0, A, "2000-01-01", None)], [(1, A, "2000-01-01", None), (2, A, "2000-01-01", None)], [(1, A, "2000-01-01", "2001-01-01"), (1, B, "2001-01-02", None)], [(1, A, "2000-01-01", None), (1, B, "2001-01-02", None)], [(1, " x", "2000-01-01", None)]):
        with pytest.raises(MappingError):
            CodeHistory.of(spark, rows)


def test_downloaded_bars_are_adjusted_by_events(spark, frames):
    daily = frames["daily"].selectExpr("ts_code code", "trade_date", "'none' adjustment", "open", "high", "low", "close", "pre_close preClose", "vol volume", "amount")
    events = spark.sql(f"select * from values ('{A}', date'2024-01-03', 2d), ('{A}', date'2024-01-05', 5d) t(code, ex_date, dr)")
    ranges = spark.sql(f"select 'dividend_factors' dataset, '{A}' code, cast(null as string) period, date'2024-01-01' start_date, date'2024-01-31' end_date")
    made = lambda **k: MarketReader(Catalog({**frames, "downloaded_daily": daily.unionByName(daily.withColumn("adjustment", F.lit("front"))), "dividend_factors": k.get("events", events)}, download_ranges=k.get("ranges", ranges)), {"daily_bars": "downloaded_daily"})
    rows = lambda r, t, **k: [x.open for x in r.at(t).market.bars([A], "1d", count=9, **k).sorted.collect()]
    assert rows(made(), "2024-01-04 16:05:00") == [10, 11, 12]
    assert rows(made(), "2024-01-04 16:05:00", adjustment="forward") == [5, 11, 12]
    assert rows(made(), "2024-01-05 09:24:00", adjustment="forward") == [5, 11, 12] and rows(made(), "2024-01-05 09:25:00", adjustment="forward") == [1, 2.2, 2.4]
    short = ranges.withColumn("end_date", F.lit("2024-01-03").cast("date"))
    for broken in (made(ranges=short), made(ranges=ranges.limit(0)), made(events=events.withColumn("dr", F.lit(0.0)))):
        with pytest.raises(UnavailableError):
            broken.at("2024-01-04 16:05:00").market.bars([A], "1d", count=9, adjustment="forward")
    minutes = made().at("2024-01-03 09:31:00").market.bars([A], "1m", count=9, adjustment="forward")
    assert minutes.df.count() == 2 and minutes.sources == ("intraday", "dividend_factors")


def test_reports_have_public_names_and_units(spark, frames):
    flat = lambda kind, **own: spark.range(1).selectExpr(f"'{A}' ts_code", "date'2023-09-30' end_date", "date'2024-01-02' ann_date", "'1' update_flag", *[f"{own.get(raw, '1d')} {raw}" for raw in dict.fromkeys(fields.PAYLOADS[kind].values())])
    more = {"fina_indicator": flat("indicators"), "forecast": flat("forecast", type="'up'", summary="'s'", change_reason="'r'", first_ann_date="date'2024-01-01'"), "express": flat("express", is_audit="1"), "fina_audit": flat("audit")}
    view = MarketReader(Catalog({**frames, **more})).at("2024-01-03 09:25:00").fundamentals
    r = view.indicators([A]).df.first()
    assert (r.basic_earnings_per_share, r.gross_profit, r.gross_margin, r.return_on_equity) == (1, 1, 0.01, 0.01)
    r = view.disclosures("forecast", [A]).df.first()
    assert (r.net_income_change_lower_bound, r.net_income_lower_bound, r.prior_period_net_income, r.forecast_type) == (0.01, 10_000, 10_000, "up")
    r = view.disclosures("express", [A]).df.first()
    assert (r.is_audited, r.prior_period_net_income, r.total_assets_growth) == (True, 1, 0.01)
    assert view.disclosures("audit", [A], fields=["audit_firm"]).df.columns == ["symbol", "visible_at", "period_end", "announcement_date", "audit_firm"]
    with pytest.raises(RequestError):
        view.indicators([A], fields=["eps"])


def test_adapters_answer_routes(frames):
    class Mine(Adapter):
        def table(self, route):
            return frames["daily"].withColumn("open", F.lit(7.0))

    own = MarketReader(Catalog(frames), {"daily_bars": "mine"}, adapters={"mine": Mine()})
    assert own.at("2024-01-04 16:05:00").market.bars([A], "1d", count=1).df.first().open == 7


def test_views_and_metadata(spark, frames, reader):
    assert "t_daily" in reader.catalog.register_views("t_") and spark.table("t_daily").count() == 5
    meta = reader.snapshot_metadata()
    assert meta["routes"]["current"] == "daily" and meta["code_history"] is None
    with pytest.raises(UnavailableError):
        reader.catalog.with_status({"snapshot_id": "other"}).table("daily")
    assert reader.catalog.with_status({"snapshot_id": reader.catalog.snapshot_id, "failed": ["income"]}).table("daily").count() == 5
