import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.errors import DataError, RequestError
from tidegauge.operators import actions as acts
from tidegauge.operators import backtest as bt
from tidegauge.operators import bars as price
from tidegauge.operators import clock, repair, trading
from tidegauge.sources.store import Store, TableConfig

A, B = "600000.SH", "000001.SZ"
D = [date(2024, 1, d) for d in (2, 3, 4, 5, 8)]
FREE = bt.Config(cash=10_000.0, commission=0.0)
HOURS = clock.Hours()


def bar(p, close=None, volume=1e6, **x):
    return {"open": p, "close": p if close is None else close, "up_limit": 1000.0, "down_limit": 0.01, "suspended": False, "previous_volume": volume} | x


def walk(bars, targets, config=FREE, actions=(), lives=None, strategy=None, symbols=None):
    """Rows of one run over daily bars {day: {symbol: bar}}; with a strategy, targets are not looked at."""
    names = [c.split()[0] for c in bt.SCHEMA.split(", ")]
    days = sorted(bars)
    start = lambda d: datetime.combine(d, datetime.min.time().replace(hour=9, minute=30))
    feed = [(datetime.combine(d, datetime.min.time().replace(hour=16, minute=5)), {s: x | {"start": start(d)} for s, x in bars[d].items()}) for d in days if bars[d]]
    walker = bt.Walk(strategy or bt.Targets(dict(targets)), config, list(actions), lives, days, symbols)
    return [dict(zip(names, r, strict=True)) for r in bt.walk("r", feed, walker, days, HOURS, days)]


def test_orders_trade_at_the_next_open_and_sell_first():
    bars = {d: {A: bar(10.0 + k), B: bar(20.0)} for k, d in enumerate(D)}
    rows = walk(bars, {D[0]: {A: 0.5}, D[2]: {B: 1.0}})
    fills = [r for r in rows if r["kind"] == "fill"]
    assert [(r["day"], r["symbol"], r["side"], r["quantity"], r["price"]) for r in fills] == [(D[1], A, "buy", 500, 11.0), (D[3], A, "sell", 500, 13.0), (D[3], B, "buy", 500, 20.0)]
    fee = lambda amount, sell: 5 + amount * 0.00001 + (amount * 0.0005 if sell else 0)
    cash = 10_000 - 5500 - fee(5500, False) + 6500 - fee(6500, True) - 10_000 - fee(10_000, False)
    assert rows[-1]["cash"] == pytest.approx(cash) and rows[-1]["equity"] == pytest.approx(cash + 500 * 20)


@pytest.mark.parametrize(("change", "reason"), [({"open": None}, "missing_open"), ({"suspended": True}, "suspended"), ({"suspended": None}, "unknown_status"), ({"up_limit": None}, "unknown_status"), ({"up_limit": 5.0}, "invalid_open"), ({"up_limit": 10.0}, "limit_up")])
def test_blocked_orders_say_why(change, reason):
    rows = walk({D[0]: {A: bar(10.0)}, D[1]: {A: bar(10.0) | change, B: bar(1.0)}}, {D[0]: {A: 0.5}})
    assert [(r["kind"], r["reason"]) for r in rows if r["kind"] != "equity"] == [("submitted", ""), ("blocked", reason)] and rows[-1]["equity"] == 10_000


def test_cash_volume_and_one_day_rule():
    rows = walk({D[0]: {A: bar(10.0)}, D[1]: {A: bar(11.0)}, D[2]: {A: bar(11.0)}}, {D[0]: {A: 1.0}, D[1]: {}})
    fills = [r for r in rows if r["kind"] == "fill"]
    assert [(r["side"], r["quantity"], r["reason"]) for r in fills] == [("buy", 908, "insufficient_cash"), ("sell", 908, "")]
    rows = walk({d: {A: bar(10.0, volume=1000.0)} for d in D[:2]}, {D[0]: {A: 0.9}}, bt.Config(cash=10_000.0, participation=0.1))
    assert [(r["quantity"], r["reason"]) for r in rows if r["kind"] == "fill"] == [(100, "volume_limit")]
    account = bt.Account(FREE, 0.0)
    account.held[A] = bt.Holding(quantity=100, sellable=0, price=10.0)
    assert bt.execute(account, A, True, 100, bar(10.0), D[0]) == (0, 10.0, "insufficient_sellable")
    account.held[A].sellable = 100
    assert bt.execute(account, A, True, 100, bar(0.01, down_limit=0.001), D[0]) == (0, None, "insufficient_cash")


def test_dividends_pay_those_who_held():
    action = {"symbol": A, "record_date": D[1], "ex_date": D[2], "pay_date": D[3], "list_date": D[4], "cash": 1.0, "shares": 0.1}
    rows = [r for r in walk({d: {A: bar(10.0)} for d in D}, {D[0]: {A: 0.5}}, FREE, [action]) if r["kind"] == "equity"]
    base = rows[1]
    assert [round(r["equity"] - base["equity"], 6) for r in rows[2:]] == [1000, 1000, 1000]
    assert [round(r["cash"] - base["cash"], 6) for r in rows[2:]] == [0, 500, 500]


BASE = {"symbol": A, "record_date": D[1], "ex_date": D[2], "pay_date": D[3], "list_date": D[4], "cash": 1.0, "shares": 0.1, "conflict": None}


@pytest.mark.parametrize(("change", "text"), [({"conflict": "record date"}, "versions"), ({"pay_date": None}, "pay date"), ({"list_date": None}, "listing date"), ({"record_date": D[3]}, "no holding"), ({"pay_date": D[1]}, "pay date"), ({"list_date": D[1]}, "listing date"), ({"cash": -1.0}, "amount"), ({"shares": float("nan")}, "ratio"), ({"ex_date": date(2024, 1, 6), "pay_date": D[4]}, "no session"), ({"pay_date": D[2], "ex_date": D[3]}, "before the ex date")])
def test_faulty_dividends_stop_those_who_hold(change, text):
    bars = {d: {A: bar(10.0)} for d in D}
    with pytest.raises(DataError, match=text):
        walk(bars, {D[0]: {A: 0.5}}, actions=[BASE | change])
    assert walk(bars, {}, actions=[BASE | change])[-1]["equity"] == 10_000  # those who do not hold are not concerned


def test_dividends_without_an_ex_date_and_canceled_orders():
    rows = walk({d: {A: bar(10.0)} for d in D}, {D[0]: {A: 0.5}, D[1]: {}}, actions=[BASE | {"ex_date": D[2]}])
    assert [(r["kind"], r["reason"]) for r in rows if r["day"] == D[2] and r["kind"] != "equity"] == [("canceled", "corporate_action")]
    rows = [r for r in walk({d: {A: bar(10.0)} for d in D}, {D[0]: {A: 0.5}}, actions=[BASE | {"ex_date": None}]) if r["kind"] == "equity"]
    assert [round(r["equity"] - rows[1]["equity"], 6) for r in rows[2:]] == [0, 500, 1000] and rows[2]["receivable"] == 0
    early = walk({d: {A: bar(10.0)} for d in D}, {D[0]: {A: 0.5}}, actions=[BASE | {"record_date": D[0], "ex_date": D[3], "pay_date": D[4]}])
    assert early[-1]["receivable"] == 0 and early[-1]["equity"] < 10_000  # bought after the record day


def test_weekend_record_dates_count_with_the_session_before():
    friday, monday = date(2024, 1, 5), date(2024, 1, 8)
    days = {d: {A: bar(10.0)} for d in (D[2], friday, monday, date(2024, 1, 9))}
    claims = acts.Claims([BASE | {"record_date": date(2024, 1, 6), "ex_date": monday, "pay_date": date(2024, 1, 9), "list_date": None, "shares": 0.0}], sorted(days))
    assert claims.by["record_date"] == {friday: [0]}
    assert acts.Claims([BASE | {"record_date": date(2024, 1, 1)}], D).entitled == {0: 0}


def test_delisted_holdings():
    bars = {d: {A: bar(10.0)} if d < D[3] else {} for d in D}
    lives = {A: (date(2000, 1, 1), D[3])}
    with pytest.raises(DataError, match="delisted"):
        walk(bars, {D[0]: {A: 0.5}}, lives=lives)
    rows = walk(bars, {D[0]: {A: 0.5}}, bt.Config(cash=10_000.0, commission=0.0, delisting="write_off"), lives=lives)
    assert rows[-1]["holdings"] == 0 and rows[-1]["equity"] == rows[-1]["cash"] == pytest.approx(10_000 - 5005.05)
    for wrong in ({}, {A: (date(2000, 1, 1), None), B: (None, None)}, {A: (date(2030, 1, 1), None)}):
        if A not in wrong or wrong[A][0] > D[0]:
            with pytest.raises(DataError):
                walk(bars, {D[0]: {A: 0.5}}, lives=wrong)
    stale = [r["stale"] for r in walk(bars, {D[0]: {A: 0.5}}) if r["kind"] == "equity"]
    assert stale == [0, 0, 0, 1, 1]


class Swing(bt.Strategy):
    """Buys after two closes, orders and takes back, and sees no bar that is not complete."""

    lookback = 2

    def __init__(self):
        self.seen, self.ids = [], []

    def on_event(self, c):
        self.seen.append((c.day, [p for _, p in c.closes(A)], c.account.quantity(A), len(c.pending)))
        if c.day == D[1]:
            self.ids = [c.order(A, "buy", 100), c.order(A, "buy", 200)]
            assert c.cancel(self.ids[0]) and not c.cancel(99)
        if c.day == D[3]:
            return {}
        if c.day == D[4]:
            c.order(A, "buy", 100)
        return None


def test_strategies_are_called_with_what_they_may_know():
    strategy = Swing()
    rows = walk({d: {A: bar(10.0 + k)} for k, d in enumerate(D)}, {}, strategy=strategy)
    assert strategy.seen == [(D[0], [10.0], 0, 0), (D[1], [10.0, 11.0], 0, 0), (D[2], [11.0, 12.0], 200, 0), (D[3], [12.0, 13.0], 200, 0), (D[4], [13.0, 14.0], 0, 0)]
    assert [(r["kind"], r["order_id"], r["quantity"], r["reason"]) for r in rows if r["kind"] not in ("equity",)] == [
        ("submitted", 1, 100, ""), ("submitted", 2, 200, ""), ("canceled", 1, 100, "strategy"), ("fill", 2, 200, ""), ("submitted", 3, 200, ""), ("fill", 3, 200, ""), ("submitted", 4, 100, ""), ("expired", 4, 100, "end_of_backtest")]
    for order in ((A, "buy", 50), (A, "buy", 2_000_000), ("1.X", "buy", 100), (A, "hold", 100), (A, "buy", 1.5), (B, "buy", 100)):
        class Wrong(bt.Strategy):
            def on_event(self, c):
                c.order(*order)  # noqa: B023

        with pytest.raises((RequestError, DataError)):
            walk({D[0]: {A: bar(10.0)}}, {}, strategy=Wrong(), symbols={A})


def test_events_of_a_session():
    daily = clock.timeline(D[:1])
    assert [(e.kind, e.at.hour, e.at.minute) for e in daily] == [("session_start", 9, 25), ("bar", 16, 5), ("strategy", 16, 5), ("session_end", 16, 5)]
    hourly = clock.timeline(D[:2], "60m", schedule=clock.Schedule("day", at="13:00"))
    assert [(e.kind, f"{e.at:%H:%M}", f"{e.start:%H:%M}") for e in hourly[:8]] == [("session_start", "09:25", "09:25"), ("auction", "09:30", "09:15"), ("bar", "10:30", "09:30"), ("bar", "11:30", "10:30"), ("strategy", "13:00", "13:00"), ("bar", "14:00", "13:00"), ("bar", "15:00", "14:00"), ("session_end", "16:05", "16:05")]
    assert len([e for e in clock.timeline(D[:1], "1m") if e.kind == "bar"]) == 240 and len([e for e in clock.timeline(D[:1], "1m", schedule=clock.Schedule("7m")) if e.kind == "strategy"]) == 34
    ends = [e.session for e in clock.timeline(D[:4], schedule=clock.Schedule("week"), calendar=D) if e.kind == "strategy"]
    assert ends == [D[3]]
    at = datetime(2024, 1, 3, 10, 30)
    assert [e.at for e in clock.timeline(D[:2], "60m", schedule=clock.Schedule(times=(at,))) if e.kind == "strategy"] == [at]
    for wrong in (lambda: clock.timeline(D, schedule=clock.Schedule("week")), lambda: clock.timeline(D, "60m", schedule=clock.Schedule("7m")), lambda: clock.timeline(D[:1], schedule=clock.Schedule(times=(at,))), lambda: clock.timeline(D, "1d", schedule=clock.Schedule("day", at="10:00"))):
        with pytest.raises(DataError):
            wrong()
    for wrong in (lambda: clock.Schedule("year"), lambda: clock.Schedule("bar", at="10:00"), lambda: clock.Schedule("day", times=(at,)), lambda: clock.Hours(end="14:00"), lambda: clock.Hours(segments=()), lambda: clock.timeline(D, "2m"), lambda: clock.timeline(D, "60m", clock.Hours(segments=(("09:30", "11:00"),)))):
        with pytest.raises(RequestError):
            wrong()


def test_intraday_runs_match_at_the_open_of_the_next_bar(spark):
    rows = [(datetime(2024, 1, 2, h + 1, m), datetime(2024, 1, 2, h, m), A, 10.0 + k, 10.5 + k) for k, (h, m) in enumerate([(9, 30), (10, 30), (13, 0), (14, 0)])]
    rows += [(datetime(2024, 1, 2, 9, 30), datetime(2024, 1, 2, 9, 15), A, 9.0, 9.5)]
    bars = spark.createDataFrame(rows, "at timestamp_ntz, start timestamp_ntz, symbol string, open double, close double").selectExpr("*", "100d up_limit", "1d down_limit", "false suspended", "1000d volume")
    runs = spark.sql("select explode(array('p', 'q')) run, date'2024-01-02' first, date'2024-01-02' last")

    def make(run):
        every = clock.Schedule("bar")

        class Once(bt.Strategy):
            schedule = every

            def on_event(self, c):
                return {A: 0.5 if run == "p" else 0.0} if c.event.at.hour == 10 else None

        return Once()

    out = bt.simulate(runs, bars, [date(2024, 1, 2)], make, config=bt.Config(cash=10_000.0, frequency="60m")).collect()
    fills = [(r.run, r.at, r.quantity, r.price) for r in out if r.kind == "fill"]
    assert fills == [("p", datetime(2024, 1, 2, 10, 30), 400, 11.0)]
    ends = {r.run: (r.bars, r.stale) for r in out if r.kind == "equity"}
    assert ends == {"p": (5, 0), "q": (5, 0)}


def test_dividend_facts(spark):
    columns = "symbol string, end_date date, ann_date date, div_proc string, record_date date, ex_date date, pay_date date, div_listdate date, cash_div double, cash_div_tax double, stk_div double, stk_bo_rate double, stk_co_rate double, base_date date, base_share double"
    row = lambda s, ann, cash, record=D[1], proc="实施", end=D[0], tax=0.5, whole=None: (s, end, ann, proc, record, D[2], D[3], D[4], cash, tax, whole, 0.1, 0.2, None, 1.0)
    rows = [row("a", D[0], 1.0), row("a", D[1], 1.0), row("b", D[0], 1.0), row("b", D[1], 2.0), row("c", D[0], 1.0), row("c", D[0], 2.0, record=D[2]), row("d", D[0], None), row("e", D[0], 1.0, proc="预案"), row("f", D[0], 1.0, record=None), row("g", D[0], 1.0, whole=0.5)]
    got = sorted((r.symbol, r.cash, round(r.shares, 6), r.conflict) for r in acts.effective(spark.createDataFrame(rows, columns)).collect())
    assert got == [("a", 1.0, 0.3, None), ("b", 1.0, 0.3, "record date"), ("b", 2.0, 0.3, "record date"), ("c", 1.0, 0.3, "period and announcement"), ("c", 2.0, 0.3, "period and announcement"), ("d", 0.5, 0.3, None), ("g", 1.0, 0.5, None)]


def test_metrics_of_many_runs(spark):
    bars = spark.createDataFrame([(d, s, 10.0 + k, 10.0 + k, 1000.0, 99.0, 1.0, False) for k, d in enumerate(D) for s in (A, B)], "day date, symbol string, open double, close double, volume double, up_limit double, down_limit double, suspended boolean")
    targets = spark.createDataFrame([("x", D[0], A, 0.5), ("y", D[0], B, 0.0), ("w", D[1], "600009.SH", 0.5)], "run string, day date, symbol string, weight double")
    out = bt.backtest(targets, bars, FREE)
    got = {r.run: r for r in trading.run_metrics(out, 10_000.0).collect()}
    x = got["x"]
    path = [r.equity for r in out.where("run = 'x' and kind = 'equity'").orderBy("seq").collect()]
    returns = [b / a - 1 for a, b in zip([10_000.0, *path], path, strict=False)]
    import statistics

    assert x.final_equity == path[-1] and x.volatility == pytest.approx(statistics.stdev(returns) * 252**0.5) and x.sharpe == pytest.approx(statistics.fmean(returns) / statistics.stdev(returns) * 252**0.5)
    assert x.turnover == pytest.approx(5500 / statistics.fmean([10_000.0, *path])) and (x.orders, x.fills, x.n) == (1, 1, 5)
    assert (got["y"].total_return, got["y"].sharpe, got["y"].max_drawdown) == (0, None, 0)
    with pytest.raises(DataError, match="w"):
        bt.require_bars(out)


def test_monthly_momentum(spark):
    days = [date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1), date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    rows = [(d, s, c) for s, closes in {"a": [1, 2, 2, 2, 4, 9], "b": [1, 3, 2, 2, 3, 9], "c": [1, 9, None, 2, 9, 9], "d": [1, 2, 2, 2, 4, 9]}.items() for d, c in zip(days, closes, strict=True) if c is not None]
    rows = [(d, s, float(c)) for d, s, c in rows]
    bars = spark.createDataFrame(rows, "day date, symbol string, close double")
    factors = bars.select("day", "symbol").withColumn("factor", F.when((F.col("symbol") == "d") & (F.col("day") >= days[4]), 2.0).otherwise(1.0))
    calendar = spark.createDataFrame([(d,) for d in days], "day date")
    got = {(str(r.day), r.symbol): (r.score, r.weight) for r in price.monthly_momentum(bars, factors, calendar, 2, 2).collect()}
    assert got == {("2024-02-29", "d"): (3.0, 0.5), ("2024-02-29", "a"): (1.0, 0.5)}
    allowed = spark.createDataFrame([(days[4], "b"), (days[1], "c")], "day date, symbol string")
    got = [(str(r.day), r.symbol, r.score, r.weight) for r in price.monthly_momentum(bars, factors, calendar, 1, 2, allowed).orderBy("day").collect()]
    assert got == [("2024-01-31", "c", 8.0, 1.0), ("2024-02-29", "b", 0.5, 1.0)]


def test_board_rules_and_targets():
    assert bt.board_rule("688001.SH", D[0]) == (200, 1, 50_000) and bt.board_rule("300001.SZ", date(2020, 8, 23)) == (100, 100, 1_000_000)
    for symbol, day in (("688001.SH", date(2019, 7, 21)), ("900001.SH", D[0]), ("60000.SH", D[0])):
        with pytest.raises(DataError):
            bt.board_rule(symbol, day)
    account = bt.Account(FREE, 3e6)
    assert bt.orders_for({"688001.SH": 1.0}, account, {"688001.SH": 25.0}, D[0]) == [("688001.SH", False, 50_000), ("688001.SH", False, 50_000), ("688001.SH", False, 20_000)]
    with pytest.raises(RequestError):
        bt.orders_for({A: 0.6, B: 0.6}, account, {}, D[0])


def test_runs_are_independent(spark):
    bars = spark.createDataFrame([(d, s, 10.0 + k, 10.0 + k, 1000.0, 99.0, 1.0, False) for k, d in enumerate(D) for s in (A, B)], "day date, symbol string, open double, close double, volume double, up_limit double, down_limit double, suspended boolean")
    targets = spark.createDataFrame([("x", D[0], A, 0.5), ("y", D[1], B, 0.5), ("y", D[2], None, 0.0), ("z", D[0], "600009.SH", 0.5)], "run string, day date, symbol string, weight double")
    out = bt.backtest(targets, bars, FREE)
    rows = out.orderBy("run", "seq").collect()
    one = {d: {A: bar(10.0 + k)} for k, d in enumerate(D)}
    assert [(r.kind, r.day, r.quantity, r.equity) for r in rows if r.run == "x"] == [(r["kind"], r["day"], r["quantity"], r["equity"]) for r in walk(one, {D[0]: {A: 0.5}})]
    assert [(r.side, r.quantity) for r in rows if r.run == "y" and r.kind == "fill"] == [("buy", 400), ("sell", 400)]
    assert [r.equity for r in rows if r.run == "z"] == [10_000] * 5
    assert {r.run: (r.fills, r.blocked, r.sessions_without_bars) for r in bt.coverage(out).collect()} == {"x": (1, 0, 0), "y": (2, 0, 0), "z": (0, 0, 5)}
    with pytest.raises(Exception, match="two bars"):
        bt.backtest(targets, bars.union(bars), FREE).collect()
    assert bt.backtest(targets.limit(0), bars, FREE).isEmpty()


def test_period_ends(spark):
    days = spark.createDataFrame([(d,) for d in (date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 2), date(2024, 2, 5))], "d date")
    get = lambda every: sorted(r.d for r in bt.period_ends(days, "d", every).collect())
    assert get("week") == [date(2024, 2, 2)] and get("month") == [date(2024, 1, 31)] and len(get("day")) == 4


@pytest.fixture
def store(spark, tmp_path):
    kind = spark.createDataFrame([], "day string, id long, value double, note string").schema
    out = Store(spark, str(tmp_path), {"t": TableConfig("t", kind, ("day",), ("id",), ("id",))})
    out.append("t", spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 2.0, "x"), ("b", 1, 3.0, None)], kind))
    return out


def content(store):
    return sorted((r.day, r.id, r.value) for r in store.read("t").collect())


def test_patch_and_rollback(spark, store):
    before = content(store)
    patches = spark.sql("select 'a' day, 1L id, 9d value, 1d old, false _delete union all select 'a', 2, null, 2d, true")
    done = repair.patch(store, "t", [("a",)], patches, {"value": "old"})
    assert content(store) == [("a", 1, 9.0), ("b", 1, 3.0)] and repair.read_journal(store, done)["status"] == "COMMITTED"
    repair.rollback(store, done)
    assert content(store) == before
    with pytest.raises(RequestError):
        repair.rollback(store, done)


@pytest.mark.parametrize("row", ["'a' day, 1L id, 9d value, 5d old, false _delete", "'a' day, 7L id, 9d value, 1d old, false _delete", "'b' day, 1L id, 9d value, 3d old, false _delete"])
def test_a_patch_that_does_not_fit_changes_nothing(spark, store, row):
    before = content(store)
    with pytest.raises(DataError):
        repair.patch(store, "t", [("a",)], spark.sql(f"select {row}"), {"value": "old"})
    assert content(store) == before


def test_rollback_refuses_later_changes(spark, store):
    done = repair.patch(store, "t", [("a",)], spark.sql("select 'a' day, 1L id, 9d value, false _delete"))
    store.append("t", spark.sql("select 'a' day, 3L id, 1d value, cast(null as string) note"))
    with pytest.raises(DataError):
        repair.rollback(store, done)
    with pytest.raises(RequestError):
        repair.read_journal(store, "../x")


def test_actions_and_ranges(spark):
    issues = spark.sql("select * from values ('daily', 'daily_ohlc_v1', date'2024-01-02'), ('daily', 'daily_range_v1', date'2024-01-03'), ('daily', 'daily_range_v1', date'2024-01-05'), ('daily', 'schema_v1', date'2024-01-04'), ('x', 'finite_float_v1', date'2024-01-04') t(dataset, rule, day)")
    assert sorted(r.action for r in repair.actions(issues).collect()) == ["MANUAL", "PATCH", "REFETCH", "REFETCH", "REFETCH"]
    assert sorted(json.dumps([str(x) for x in r]) for r in repair.refetch_ranges(issues).collect()) == ['["daily", "2024-01-02", "2024-01-03"]', '["daily", "2024-01-05", "2024-01-05"]']


def market(spark):
    """Three months of weekdays, three stocks, a dividend, an adjustment and a delisting."""
    day = "explode(sequence(date'2024-01-01', date'2024-04-10')) d"
    days = spark.range(1).selectExpr(day).where("weekday(d) < 5").withColumn("i", F.datediff("d", F.lit("2024-01-01").cast("date")))
    codes = spark.sql("select * from values ('600000.SH', 0.01d), ('000001.SZ', 0.02d), ('600001.SH', 0.03d) t(ts_code, g)")
    rows = days.crossJoin(codes).where("ts_code <> '600001.SH' or d < date'2024-03-15'").withColumn("p", F.round(10 * F.pow(1 + F.col("g") / 10, F.col("i")), 2))
    frames = {
        "trade_cal": spark.range(1).selectExpr(day).selectExpr("'SSE' exchange", "d cal_date", "weekday(d) < 5 is_open", "cast(null as date) pretrade_date"),
        "daily": rows.selectExpr("ts_code", "d trade_date", "p open", "p + 0.1 high", "p - 0.1 low", "p close", "p pre_close", "10000d vol", "p * 1000 amount"),
        "adj_factor": rows.selectExpr("ts_code", "d trade_date", "1d adj_factor"), "stk_limit": rows.selectExpr("ts_code", "d trade_date", "p * 1.1 up_limit", "p * 0.9 down_limit"),
        "suspend_d": spark.sql("select '000001.SZ' ts_code, date'2024-02-01' trade_date, 'S' suspend_type, cast(null as string) suspend_timing"),
        "stock_st": spark.sql("select '600000.SH' ts_code, date'2024-01-31' trade_date, 'ST' type, 'ST' type_name"),
        "stock_basic": spark.sql("select * from values ('600000.SH', 'SSE', 'main', 'CNY', date'2000-01-01', null), ('000001.SZ', 'SZSE', 'main', 'CNY', date'2000-01-01', null), ('600001.SH', 'SSE', 'main', 'CNY', date'2000-01-01', date'2024-03-15') t(ts_code, exchange, market, curr_type, list_date, delist_date)"),
        "dividend": spark.sql("select '600001.SH' ts_code, date'2023-12-31' end_date, date'2024-01-15' ann_date, '实施' div_proc, date'2024-02-10' imp_ann_date, date'2024-02-20' record_date, date'2024-02-21' ex_date, date'2024-02-22' pay_date, cast(null as date) div_listdate, 0.5d cash_div, 0.6d cash_div_tax, 0d stk_div, 0d stk_bo_rate, 0d stk_co_rate, date'2023-12-31' base_date, 1d base_share"),
    }
    return frames


def test_a_run_from_a_catalog(spark, tmp_path, capsys):
    from tidegauge.__main__ import main
    from tidegauge.operators import runner, universe
    from tidegauge.reader import Catalog, MarketReader
    from tidegauge.sources.ingest import Progress

    frames = market(spark)
    reader = MarketReader(Catalog(frames, covered=(("suspend_d", "2024-01-01", "2024-04-30"),)), {"current": "daily"})
    rule, config = runner.Momentum(5, 1, 0, True), bt.Config(cash=100_000.0, delisting="write_off")
    targets = {(str(r.day), r.symbol) for r in runner.momentum_targets(reader, rule, "2024-01-10", "2024-03-31").collect()}
    assert targets == {("2024-01-31", "600001.SH"), ("2024-02-29", "600001.SH"), ("2024-03-29", "000001.SZ")}
    rows = runner.run_momentum(reader, "2024-01-10", "2024-04-05", rule, config).collect()
    fills = [(r.symbol, str(r.day), r.side) for r in rows if r.kind == "fill"]
    assert [f for f in fills if f[1] < "2024-03-15"] == [("600001.SH", "2024-02-01", "buy"), ("600001.SH", "2024-03-01", "buy")]
    ends = {str(r.day): r.holdings for r in rows if r.kind == "equity"}
    assert ends["2024-03-14"] == 1 and ends["2024-03-15"] == 0  # written off
    paid = {str(r.day): r.receivable for r in rows if r.kind == "equity"}
    held = next(r.quantity for r in rows if r.kind == "fill")
    assert paid["2024-02-21"] == pytest.approx(0.5 * held) and paid["2024-02-22"] == 0
    with pytest.raises(Exception, match="delisted"):
        runner.run_momentum(reader, "2024-01-10", "2024-04-05", rule).collect()
    blocked = [r.reason for r in runner.run_momentum(reader, "2024-01-10", "2024-02-05", runner.Momentum(5, 2), config).collect() if r.kind == "blocked"]
    assert blocked == []  # nobody is listed for sixty sessions of this calendar
    blocked = [(r.symbol, r.reason) for r in runner.run_momentum(reader, "2024-01-10", "2024-02-05", runner.Momentum(5, 2, 0), config).collect() if r.kind == "blocked"]
    assert blocked == [("000001.SZ", "suspended")]
    at = reader.at("2024-01-31 16:05:00")
    assert {r.symbol for r in universe.stock_universe(at, exclude_st=True).collect()} == {"000001.SZ", "600001.SH"} and universe.stock_universe(at, 10, allowed=["600000.SH"]).count() == 1
    with pytest.raises(DataError):
        universe.stock_universe(at, 60)
    meta = runner.run_metadata(reader, rule)
    assert meta["strategy"]["parameters"]["top"] == 1 and meta["data"]["routes"]["current"] == "daily"

    store = Store(spark, str(tmp_path / "store"), {n: TableConfig(n, df.schema, ("cal_date",) if n == "trade_cal" else ("ts_code",)) for n, df in frames.items()})
    for n, df in frames.items():
        store.append(n, df)
    Progress(store).mark("suspend_d", date(2024, 1, 1), date(2024, 4, 30))
    out = str(tmp_path / "out")
    assert main(["backtest", "--store", store.root, "--start", "2024-01-10", "--end", "2024-04-05", "--output", out, "--lookback", "5", "--top", "1", "--minimum-sessions", "0", "--cash", "100000", "--delisting", "write_off"], spark) == 0
    printed = json.loads(capsys.readouterr().out)["momentum"]
    assert printed["fills"] == len(fills) and spark.read.parquet(f"{out}/equity.parquet").count() == printed["n"] and spark.read.parquet(f"{out}/order_updates.parquet").columns == runner.COLUMNS["order_updates"]
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{out}/config.json").collect()))["cash"] == 100_000
    assert main(["smoke", "--store", store.root, "--as-of", "2024-03-01 17:05:00", "--output", str(tmp_path / "smoke")], spark) == 1
    smoke = json.loads(capsys.readouterr().out)
    assert smoke["bars"] == {"rows": 15, "sources": ["daily"]} and "error" in smoke["income"] and smoke["stocks"]["rows"] == 3
    assert main(["export", "--store", store.root, "--table", "daily", "--output", str(tmp_path / "csv"), "--limit", "7"], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 7
    with pytest.raises(RequestError):
        main(["export", "--store", str(tmp_path / "none"), "--table", "x", "--output", "y"], spark)


def test_detect_repair_and_rollback_by_command(spark, tmp_path, capsys):
    from tidegauge.__main__ import main
    from tidegauge.operators import detect

    rows = spark.sql("select * from values ('a', date'2024-01-02', 'x', 1d, double('NaN')), ('b', date'2024-01-02', 'y', 0d, 2d), ('c', date'2024-01-03', 'z', 1d, double('inf')) t(ts_code, trade_date, note, adj_factor, other)")
    terms = spark.sql("select date'2023-12-31' end_date, 'a' ts_code, date'2024-01-02' ann_date, ' 实施 ' div_proc, cast(null as date) imp_ann_date, 0d stk_div, 0d stk_bo_rate, 0d stk_co_rate, 1d cash_div, 1d cash_div_tax, 1d base_share")
    store = Store(spark, str(tmp_path / "s"), {"adj_factor": TableConfig("adj_factor", rows.schema, ("trade_date",), (), ("ts_code",)), "dividend": TableConfig("dividend", terms.schema, ("end_date",), (), ("ts_code", "ann_date"))})
    store.append("adj_factor", rows)
    store.append("dividend", terms)
    report = str(tmp_path / "r")
    assert main(["detect", "--store", store.root, "--through", "2024-01-05", "--report", report], spark) == 1
    said = capsys.readouterr().out
    assert "FAIL adj_factor adj_factor_positive_v1 1" in said and "FAIL adj_factor finite_float_v1 2" in said and "FAIL dividend dividend_value_v1 1" in said
    assert main(["repair", "--store", store.root, "--report", report, "--apply"], spark) == 0
    said = capsys.readouterr().out
    assert "fetch adj_factor 2024-01-02 2024-01-02" in said
    ids = dict(line.removeprefix("patched ").split(": ") for line in said.splitlines() if line.startswith("patched"))
    assert {(r.ts_code, r.other) for r in store.read("adj_factor").collect()} == {("a", None), ("b", 2.0), ("c", None)} and store.read("dividend").first().div_proc == "实施"
    with pytest.raises(DataError):
        repair.apply_fixes(store, detect.read_report(spark, report).issues)  # rows are no longer as they were found
    assert main(["rollback", "--store", store.root, "--repair-id", ids["dividend"]], spark) == 0 and store.read("dividend").first().div_proc == " 实施 "
    issues = detect.read_report(spark, report).issues.where("rule = 'adj_factor_positive_v1'")
    chosen = issues.select("issue_id", F.col("observed").alias("expected"), F.lit('{"adj_factor": 3}').alias("values"))
    assert [d for d, _ in repair.apply_fixes(store, issues, chosen)] == ["adj_factor"] and store.read("adj_factor").where("ts_code = 'b'").first().adj_factor == 3


def test_export_flattens(spark, tmp_path):
    from tidegauge.operators import runner

    runner.export_csv(spark.sql("select date'2024-01-02' d, named_struct('a', 1, 'b', array(1, 2)) q, array('x') l"), str(tmp_path / "e"))
    got = spark.read.option("header", True).csv(str(tmp_path / "e")).first()
    assert got.asDict() == {"d": "2024-01-02", "q.a": "1", "q.b": "[1,2]", "l": '["x"]'}
    with pytest.raises(RequestError):
        runner.export_csv(spark.range(1), str(tmp_path / "f"), 0)
