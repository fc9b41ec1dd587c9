"""Backtests of independent runs: events in order, orders that trade at the next open, accounts in cash, shares and claims.

Runs are groups of one DataFrame and spread over the cluster, so a sweep of thousands of runs is one job. A run has to be walked in
order: its rows arrive sorted by instant and are read as a stream, so a task holds one instant's bars and the accounts, not a history.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, time
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.errors import DataError, RequestError
from tidegauge.operators import actions as acts
from tidegauge.operators.clock import Event, Hours, Schedule, chosen_sessions, session_events
from tidegauge.operators.trading import COMMISSION_MIN, STAMP_TAX, TRANSFER_FEE

SMALL = 1e-9
SCHEMA = "run string, seq long, kind string, day date, at timestamp_ntz, order_id long, symbol string, side string, quantity long, price double, notional double, fee double, slippage double, reason string, cash double, receivable double, market_value double, equity double, ret double, holdings int, stale int, bars int"
#: Columns of the rows that a walk reads, in order of run, instant and rank.
FEED = "run string, at timestamp_ntz, rank int, symbol string, start timestamp_ntz, open double, close double, up_limit double, down_limit double, suspended boolean, previous_volume double, weight double, d1 date, d2 date, d3 date, d4 date, x1 double, x2 double, text string"

# Boards by exchange and prefix, with the day from which a rule holds, the least order, its step and the most.
BOARDS = [
    ("SH", ("688", "689"), "2019-07-22", 200, 1, 50_000),
    ("BJ", ("",), "2021-11-15", 100, 1, 1_000_000),
    ("SZ", ("300", "301"), "2020-08-24", 100, 100, 150_000),
    ("SZ", ("300", "301"), "0001-01-01", 100, 100, 1_000_000),
    ("SH", ("60",), "0001-01-01", 100, 100, 1_000_000),
    ("SZ", ("00",), "0001-01-01", 100, 100, 1_000_000),
]


def board_rule(symbol: str, day: date) -> tuple[int, int, int]:
    """(least, step, most) shares of an order; DataError for codes and days without a rule."""
    code, _, exchange = symbol.partition(".")
    if len(code) == 6 and code.isdigit():
        for board, prefixes, since, *rule in BOARDS:
            if exchange == board and code.startswith(prefixes) and day.isoformat() >= since:
                return tuple(rule)
    raise DataError(f"no order rule for {symbol} on {day}")


def tradable(quantity: int, rule: tuple[int, int, int]) -> int:
    least, step, most = rule
    quantity = min(quantity, most)
    return quantity // step * step if quantity >= least else 0


@dataclass(frozen=True)
class Config:
    """cash to begin with, commission as a share of the amount, slippage in hundredths of a percent, and the share of the bar
    before's volume that one order may take (None: any). delisting: `error`, or `write_off` to value what is held at nothing."""

    cash: float = 1_000_000.0
    commission: float = 0.00025
    slippage_bps: float = 0.0
    participation: float | None = None
    frequency: str = "1d"
    delisting: str = "error"

    def __post_init__(self):
        if not (self.cash > 0 and math.isfinite(self.cash)) or self.commission < 0 or self.slippage_bps < 0 or not (self.participation is None or 0 < self.participation <= 1):
            raise RequestError("cash must be positive, rates not negative, participation up to 1")
        if self.delisting not in ("error", "write_off"):
            raise RequestError("delisting is error or write_off")


@dataclass
class Holding:
    quantity: int = 0
    sellable: int = 0
    price: float | None = None
    unlisted: int = 0
    stale: bool = False


@dataclass
class Account:
    """Cash and holdings of one run."""

    config: Config
    cash: float
    held: dict[str, Holding] = field(default_factory=lambda: defaultdict(Holding))
    claims: acts.Claims | None = None

    def fee(self, sell: bool, amount: float, day: date) -> float:
        rate = lambda r: r[1] if day.isoformat() < r[0] else r[2]
        return max(amount * self.config.commission, COMMISSION_MIN) + amount * rate(TRANSFER_FEE) + (amount * rate(STAMP_TAX) if sell else 0.0)

    def affordable(self, quantity: int, price: float, day: date) -> int:
        """The most shares, up to quantity, that cash and fees allow: cost grows with the quantity, so halving finds it."""
        low, high = 0, quantity
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if mid * price + self.fee(False, mid * price, day) <= self.cash + SMALL else (low, mid - 1)
        return low

    @property
    def receivable(self) -> float:
        return sum(self.claims.owed.values()) if self.claims else 0.0

    @property
    def market_value(self) -> float:
        return sum(h.quantity * h.price for h in self.held.values() if h.quantity and h.price is not None)

    def equity(self) -> float:
        return self.cash + self.receivable + self.market_value

    def quantity(self, symbol: str) -> int:
        return self.held[symbol].quantity if symbol in self.held else 0

    def check(self) -> None:
        """DataError if the account is impossible."""
        if not math.isfinite(self.cash) or self.cash < -SMALL or self.receivable < -SMALL:
            raise DataError("an account has less than nothing")
        for symbol, h in self.held.items():
            if min(h.quantity, h.sellable, h.unlisted) < 0 or h.sellable + h.unlisted > h.quantity:
                raise DataError(f"an account cannot hold {symbol} like this: {h}")


def _number(x) -> float | None:
    return float(x) if x is not None and math.isfinite(x) else None


def _positive(x) -> float | None:
    x = _number(x)
    return x if x is not None and x > 0 else None


#: Why an order gets nothing, in the order in which reasons are looked for. Each test sees whether it sells, the order's quantity,
#: the open, the limits, the state of suspension, what may be sold and the board's rule.
REFUSALS = [
    ("missing_open", lambda o: o["open"] is None),
    ("suspended", lambda o: o["suspended"] is True),
    ("unknown_status", lambda o: o["suspended"] is not False or o["up"] is None or o["down"] is None or o["down"] > o["up"]),
    ("invalid_open", lambda o: not o["down"] - SMALL <= o["open"] <= o["up"] + SMALL),
    ("limit_up", lambda o: not o["sell"] and o["open"] >= o["up"] - SMALL),
    ("limit_down", lambda o: o["sell"] and o["open"] <= o["down"] + SMALL),
    ("invalid_quantity", lambda o: not 0 < o["quantity"] <= o["rule"][2] or (o["quantity"] != tradable(o["quantity"], o["rule"]) and not (o["sell"] and o["quantity"] == o["sellable"]))),
]


def execute(account: Account, symbol: str, sell: bool, quantity: int, bar: dict | None, day: date) -> tuple[int, float | None, str]:
    """(quantity, price, reason): what an order gets at a bar's open. REFUSALS come first; then volume, what is sellable and
    cash cut the quantity, and the last that does is the reason."""
    c, bar = account.config, bar or {}
    sellable = account.held[symbol].sellable if symbol in account.held else 0
    known = {"sell": sell, "quantity": quantity, "open": _positive(bar.get("open")), "up": _positive(bar.get("up_limit")), "down": _positive(bar.get("down_limit")), "suspended": bar.get("suspended"), "sellable": sellable, "rule": board_rule(symbol, day)}
    refused = next((reason for reason, test in REFUSALS if test(known)), None)
    if refused:
        return 0, None, refused
    price = max(min(known["open"] * (1 + (-1 if sell else 1) * c.slippage_bps / 10_000), known["up"]), known["down"])
    limits = [] if c.participation is None else [("volume_limit", int((_number(bar.get("previous_volume")) or 0) * c.participation))]
    if sell:
        limits.append(("insufficient_sellable", sellable))
    reason = ""
    for name, most in limits:
        if most < quantity:
            quantity, reason = max(most, 0), name
    if not sell and (most := account.affordable(quantity, price, day)) < quantity:
        quantity, reason = most, "insufficient_cash"
    if sell and quantity and account.cash + quantity * price - account.fee(True, quantity * price, day) < -SMALL:
        return 0, None, "insufficient_cash"
    return quantity, price, reason


def check_weights(weights: Mapping[str, float]) -> dict[str, float]:
    if any(not s or isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or not 0 <= w <= 1 for s, w in weights.items()) or sum(weights.values()) > 1 + SMALL:
        raise RequestError("weights lie between 0 and 1 and sum to 1 at most")
    return dict(sorted(weights.items()))


def orders_for(weights: Mapping[str, float], account: Account, prices: Mapping[str, float | None], day: date) -> list[tuple[str, bool, int]]:
    """(symbol, sell, quantity) that take the account to a whole portfolio of weights. Held symbols without a weight are
    sold out; one without a price is left as it is; orders beyond a board's most are split."""
    weights, equity, out = check_weights(weights), account.equity(), []
    for symbol in sorted({*weights, *(s for s, h in account.held.items() if h.quantity)}):
        rule, have, weight, price = board_rule(symbol, day), account.quantity(symbol), weights.get(symbol, 0.0), _positive(prices.get(symbol))
        wanted = 0 if weight == 0 else have if price is None else math.floor(equity * weight / price)
        left = abs(wanted - have)
        while left > 0:
            part = min(left, rule[2]) if wanted == 0 else tradable(left, rule)
            if not part:
                break
            out.append((symbol, wanted < have, part))
            left -= part
    return out


@dataclass(frozen=True)
class Order:
    id: int
    symbol: str
    sell: bool
    quantity: int
    at: datetime


@dataclass
class Context:
    """What a strategy sees when it is called: the event, the account, closes of the bars complete by then, and its orders."""

    event: Event
    account: Account
    prices: Mapping[str, float]
    _walk: Walk

    @property
    def day(self) -> date:
        return self.event.session

    def closes(self, symbol: str) -> list[tuple[datetime, float]]:
        """The last closes of a symbol, as many as the strategy asked to be kept, the oldest first."""
        return list(self._walk.history[symbol]) if symbol in self._walk.history else []

    @property
    def pending(self) -> tuple[Order, ...]:
        return tuple(self._walk.pending)

    def order(self, symbol: str, side: str, quantity: int) -> int:
        """Submit an order for the next bar that opens from now on; its number."""
        if side not in ("buy", "sell"):
            raise RequestError("side is buy or sell")
        return self._walk.submit(symbol, side == "sell", quantity, self.event.at).id

    def cancel(self, order_id: int) -> bool:
        """Take back an order that waits; False if it does not."""
        return self._walk.cancel(lambda o: o.id == order_id, "strategy", self.event.at)


class Strategy(ABC):
    """Called on its schedule with a Context; returns weights of a whole portfolio ({} sells everything), or None if it trades by
    orders of its own or not at all. lookback: how many closes of each symbol to keep for it."""

    schedule: Schedule = Schedule("day")
    lookback: int = 0

    @abstractmethod
    def on_event(self, context: Context) -> Mapping[str, float] | None: ...

    def parameters(self) -> dict:
        """What the run's metadata says of the strategy."""
        return dict(vars(self))


@dataclass
class Targets(Strategy):
    """Weights that are known beforehand: the portfolio of a day, at that day's last bar."""

    by_day: dict[date, dict[str, float]] = field(default_factory=dict)

    def on_event(self, context: Context) -> Mapping[str, float] | None:
        return self.by_day.get(context.day)


class Walk:
    """One run. feed yields (instant, bars by symbol) in order; out collects rows of SCHEMA without run and seq."""

    def __init__(self, strategy: Strategy, config: Config, actions: list[dict] = (), lives: Mapping[str, tuple] | None = None, sessions: list[date] = (), symbols: set[str] | None = None):
        self.strategy, self.config, self.lives, self.symbols = strategy, config, lives, symbols
        self.account = Account(config, config.cash, claims=acts.Claims(list(actions), list(sessions)))
        self.pending: list[Order] = []
        self.history: dict[str, deque] = defaultdict(lambda: deque(maxlen=strategy.lookback or None))
        self.prices: dict[str, float] = {}
        self.last_start: dict[str, datetime] = {}
        self.rows: list[dict] = []
        self.next_id, self.before, self.bars = 1, config.cash, 0

    def add(self, kind: str, at: datetime, day: date, **values) -> None:
        self.rows.append({"kind": kind, "at": at, "day": day, **values})

    # orders

    def submit(self, symbol: str, sell: bool, quantity: int, at: datetime) -> Order:
        if self.symbols is not None and symbol not in self.symbols:
            raise RequestError(f"{symbol} is not one of the run's symbols")
        if isinstance(quantity, bool) or not isinstance(quantity, int) or quantity <= 0:
            raise RequestError("a quantity is a positive whole number")
        rule = board_rule(symbol, at.date())
        if quantity > rule[2] or (not sell and quantity != tradable(quantity, rule)):
            raise RequestError(f"{symbol} cannot be ordered in {quantity}")
        order = Order(self.next_id, symbol, sell, quantity, at)
        self.next_id += 1
        self.pending.append(order)
        self._say("submitted", order, at)
        return order

    def _say(self, kind: str, order: Order, at: datetime, reason: str = "", **values) -> None:
        self.add(kind, at, at.date(), **({"order_id": order.id, "symbol": order.symbol, "side": "sell" if order.sell else "buy", "quantity": order.quantity, "reason": reason, "cash": self.account.cash} | values))

    def cancel(self, which: Callable[[Order], bool], reason: str, at: datetime) -> bool:
        gone = [o for o in self.pending if which(o)]
        self.pending = [o for o in self.pending if not which(o)]
        for o in gone:
            self._say("canceled", o, at, reason)
        return bool(gone)

    def match(self, event: Event, bars: Mapping[str, dict]) -> None:
        """Orders that were there when the bar opened, sales first, each once."""
        due = [o for o in self.pending if o.at <= event.start]
        self.pending = [o for o in self.pending if o.at > event.start]
        for o in sorted(due, key=lambda o: (not o.sell, o.symbol, o.id)):
            got, price, reason = execute(self.account, o.symbol, o.sell, o.quantity, bars.get(o.symbol), event.session)
            if not got or price is None:
                self._say("blocked", o, event.at, reason)
                continue
            amount = got * price
            fee, h = self.account.fee(o.sell, amount, event.session), self.account.held[o.symbol]
            self.account.cash = max(0.0, self.account.cash + (amount - fee if o.sell else -amount - fee))
            h.quantity += -got if o.sell else got
            h.sellable -= got if o.sell else 0
            if not h.quantity:
                h.price, h.stale = None, False
            self._say("fill", o, event.start, reason, quantity=got, price=price, notional=amount, fee=fee, slippage=abs(price - bars[o.symbol]["open"]) * got, cash=self.account.cash)

    # events

    def start_session(self, event: Event) -> None:
        account, day = self.account, event.session
        for h in account.held.values():
            h.sellable = h.quantity - h.unlisted
        claims = account.claims
        for i, r in claims.due(day, "ex_date"):
            self.cancel(lambda o: o.symbol == r["symbol"], "corporate_action", event.at)  # noqa: B023
            n = claims._entitlement(i, account.quantity(r["symbol"]))
            claims.recognise_cash(i, n)
            self._give(i, n)
        for i, r in claims.due(day, "pay_date"):
            if r["ex_date"] is None:  # no day to recognise it on but this
                claims.recognise_cash(i, claims._entitlement(i, account.quantity(r["symbol"])))
            account.cash += claims.owed.pop(i, 0.0)
        for i, r in claims.due(day, "list_date"):
            if r["ex_date"] is None:
                self._give(i, claims._entitlement(i, account.quantity(r["symbol"])))
            symbol, shares = claims.unlisted.pop(i, (r["symbol"], 0))
            account.held[symbol].unlisted -= shares
            account.held[symbol].sellable += shares
        if self.lives is not None:
            self._delist(event)

    def _give(self, i: int, n: int) -> None:
        shares = self.account.claims.new_shares(i, n)
        if shares:
            h = self.account.held[self.account.claims.rows[i]["symbol"]]
            h.quantity += shares
            h.unlisted += shares

    def _delist(self, event: Event) -> None:
        """What is held or ordered must be listed, or known to be delisted by now."""
        for symbol in sorted({o.symbol for o in self.pending} | {s for s, h in self.account.held.items() if h.quantity}):
            life = self.lives.get(symbol)
            if life is None:
                raise DataError(f"{symbol} has no listing on record")
            listed, delisted = life
            if (delisted is None or event.session < delisted) and (listed is None or listed <= event.session):
                continue
            if delisted is None or event.session < delisted:
                raise DataError(f"{symbol} is not listed and not delisted on {event.session}")
            if self.account.quantity(symbol) and self.config.delisting == "error":
                raise DataError(f"{symbol} was delisted on {delisted}: what its holders get is not known")
            self.cancel(lambda o: o.symbol == symbol, "delisted", event.at)  # noqa: B023
            self.account.held[symbol] = Holding()
            self.account.claims.write_off(symbol)

    def bar(self, event: Event, bars: Mapping[str, dict]) -> None:
        new = {s: b for s, b in bars.items() if s not in self.last_start or b["start"] > self.last_start[s]}
        self.bars += len(new)
        self.last_start.update((s, b["start"]) for s, b in new.items())
        for s, b in bars.items():
            if b["close"] is None:
                continue
            if _positive(b["close"]) is None:
                raise DataError(f"{s} has the close {b['close']} at {event.at}")
            self.prices[s] = b["close"]
            if self.strategy.lookback and s in new:
                self.history[s].append((event.at, b["close"]))
        if event.kind == "bar" and self.pending:
            self.match(event, {s: b for s, b in bars.items() if b["start"] == event.start})
        for s, h in self.account.held.items():
            if not h.quantity:
                continue
            close = _positive(bars[s]["close"]) if s in bars else None
            if close is None and h.price is None:
                raise DataError(f"{s} is held and has no price")
            h.price, h.stale = (h.price, True) if close is None else (close, False)

    def call(self, event: Event) -> None:
        weights = self.strategy.on_event(Context(event, self.account, dict(self.prices), self))
        if weights is None:
            return
        wanted = check_weights(weights)
        if self.symbols is not None and set(wanted) - self.symbols:
            raise RequestError("weights of symbols that are not the run's")
        for symbol, sell, quantity in orders_for(wanted, self.account, self.prices, event.session):
            self.submit(symbol, sell, quantity, event.at)

    def end_session(self, event: Event) -> None:
        a = self.account
        a.claims.record(event.session, a.quantity)
        equity, held = a.equity(), [h for h in a.held.values() if h.quantity]
        self.add("equity", event.at, event.session, cash=a.cash, receivable=a.receivable, market_value=a.market_value, equity=equity, ret=equity / self.before - 1 if self.before > 0 else None, holdings=len(held), stale=sum(h.stale for h in held), bars=self.bars)
        self.before, self.bars = equity, 0

    def handle(self, event: Event, bars: Mapping[str, dict]) -> None:
        if event.kind == "session_start":
            self.start_session(event)
        elif event.kind in ("bar", "auction"):
            self.bar(event, bars)
        elif event.kind == "strategy":
            self.call(event)
        else:
            self.end_session(event)
        self.account.check()

    def finish(self, at: datetime | None) -> None:
        for o in self.pending:
            self._say("expired", o, at, "end_of_backtest")
        self.pending = []


def walk(run: str, feed: Iterable[tuple[datetime, dict[str, dict]]], walker: Walk, sessions: list[date], hours: Hours, calendar: list[date]) -> Iterator[tuple]:
    """Rows of SCHEMA of a run, event by event. feed: (instant, bars) in order; a bar belongs to the first event of bars that is
    not before it."""
    schedule, seq, feed = walker.strategy.schedule, 0, iter(feed)
    chosen = chosen_sessions(sessions, calendar, schedule.every)
    names = [c.split()[0] for c in SCHEMA.split(", ")][2:]
    coming, event = next(feed, None), None
    for session in sessions:
        for event in session_events(session, walker.config.frequency, hours, schedule, session in chosen):
            bars: dict[str, dict] = {}
            while event.kind in ("bar", "auction") and coming is not None and coming[0] <= event.at:
                bars |= coming[1]
                coming = next(feed, None)
            walker.handle(event, bars)
            for r in walker.rows:
                yield (run, seq, *(r.get(n) for n in names))
                seq += 1
            walker.rows.clear()
    walker.finish(event.at if event else None)
    for r in walker.rows:
        yield (run, seq, *(r.get(n) for n in names))
        seq += 1
    walker.rows.clear()


_BAR, _TARGET, _ACTION, _LIFE = 3, 0, 1, 2


def _feed(rows: Iterable[tuple]) -> Iterator[tuple[datetime, dict[str, dict]]]:
    """(instant, bars) of sorted rows of FEED; DataError if a symbol has two bars at one."""
    for at, group in groupby(rows, key=lambda r: r[1]):
        bars: dict[str, dict] = {}
        for r in group:
            if r[3] in bars:
                raise DataError(f"two bars of {r[3]} at {at}")
            bars[r[3]] = {"start": r[4], "open": r[5], "close": r[6], "up_limit": r[7], "down_limit": r[8], "suspended": r[9], "previous_volume": r[10]}
        yield at, bars


def simulate(runs: DataFrame, bars: DataFrame, sessions: list[date], strategy: Callable[[str], Strategy] | None = None, targets: DataFrame | None = None, config: Config | None = None, actions: DataFrame | None = None, lives: DataFrame | None = None, hours: Hours | None = None, calendar: list[date] | None = None, own_bars: bool = False, own_symbols: bool = False) -> DataFrame:
    """Rows of SCHEMA of every run.

    runs: run, first, last (dates, inclusive). bars: at, start, symbol, open, close, up_limit, down_limit, suspended, volume and
    for own_bars run; a bar's at is when it is complete. strategy makes a run's strategy in the worker; without one a run
    holds its targets (run, day, symbol, weight; a null symbol sells everything). own_symbols: targets name all the symbols
    that a run needs bars of. actions: rows of actions.SCHEMA; lives: symbol, listing_date, delisting_date, which make
    delistings known. sessions and calendar (open days) are bounded by the years covered and go to the tasks.
    """
    if (strategy is None) == (targets is None):
        raise RequestError("give a strategy or targets")
    config, hours = config or Config(), hours or Hours()
    settings, days, known = asdict(config), sorted(set(sessions)), sorted(set(calendar or sessions))
    if not days:
        raise DataError("no sessions")
    keys = ["run", "symbol"] if own_bars else ["symbol"]
    volume = F.lag("volume").over(Window.partitionBy(*keys).orderBy("at"))
    rows = bars.withColumn("previous_volume", volume) if config.participation is not None else bars.withColumn("previous_volume", F.lit(None).cast("double"))
    rows = rows.select(*keys, "at", "start", "open", "close", "up_limit", "down_limit", "suspended", F.col("previous_volume").cast("double").alias("previous_volume"))
    named = targets.where("symbol is not null").select("run", "symbol").distinct() if own_symbols else None
    if own_bars:
        rows = rows.join(named, keys, "left_semi") if named is not None else rows
    else:
        rows = named.join(rows, "symbol") if named is not None else rows.crossJoin(F.broadcast(runs.select("run")))  # every run walks every bar
    inside = rows.join(F.broadcast(runs.select("run", "first", "last")), "run").where(F.to_date("start").between(F.col("first"), F.col("last"))).drop("first", "last")
    feed = inside.withColumn("rank", F.lit(_BAR))
    spark = runs.sparkSession
    start = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    static = [runs.select("run", start.alias("at"), F.lit(-1).alias("rank"), F.col("first").alias("d1"), F.col("last").alias("d2"))]
    if targets is not None:
        static.append(targets.select("run", start.alias("at"), F.lit(_TARGET).alias("rank"), "symbol", F.col("day").alias("d1"), F.col("weight").cast("double").alias("weight")))
    whose = (lambda df: named.join(df, "symbol")) if named is not None else (lambda df: df.crossJoin(F.broadcast(runs.select("run"))))
    if actions is not None:
        static.append(whose(actions).select("run", start.alias("at"), F.lit(_ACTION).alias("rank"), "symbol", *[F.col(c).alias(d) for c, d in (("record_date", "d1"), ("ex_date", "d2"), ("pay_date", "d3"), ("list_date", "d4"), ("cash", "x1"), ("shares", "x2"))], *([F.col("conflict").alias("text")] if "conflict" in actions.columns else [])))
    if lives is not None:
        static.append(whose(lives).select("run", start.alias("at"), F.lit(_LIFE).alias("rank"), "symbol", F.col("listing_date").alias("d1"), F.col("delisting_date").alias("d2")))
    for x in static:
        feed = feed.unionByName(x, allowMissingColumns=True)
    columns = [c.split()[0] for c in FEED.split(", ")]
    for c in FEED.split(", "):
        name, kind = c.split()
        feed = feed.withColumn(name, F.col(name).cast(kind) if name in feed.columns else F.lit(None).cast(kind))
    # Dealt by a hash of the run: by the run itself, Spark leaves the shuffle out, as the parts of the union are dealt by it already,
    # and adaptive execution then merges the partitions of each part on its own, so that a run's rows meet no more.
    feed = feed.select(columns).repartition(F.xxhash64("run")).sortWithinPartitions("run", "at", "rank", "symbol")
    lived, schema = lives is not None, SCHEMA

    def play(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out: list[tuple] = []
        kinds = [_arrow(c.split()[1]) for c in schema.split(", ")]
        names = [c.split()[0] for c in schema.split(", ")]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
        for run, own in groupby(rows(), key=lambda r: r[0]):
            wanted, claims, life, span, first = defaultdict(dict), [], {}, None, None
            for r in own:
                if r[2] == -1:
                    span = (r[12], r[13])
                elif r[2] == _TARGET:
                    book = wanted[r[12]]
                    if r[3] is not None:
                        book[r[3]] = r[11]
                elif r[2] == _ACTION:
                    if r[12] is None or not span[0] <= r[12] <= span[1]:
                        continue
                    claims.append({"symbol": r[3], "record_date": r[12], "ex_date": r[13], "pay_date": r[14], "list_date": r[15], "cash": r[16], "shares": r[17], "conflict": r[18]})
                elif r[2] == _LIFE:
                    life[r[3]] = (r[12], r[13])
                else:
                    first = r
                    break
            if span is None or span[0] is None:
                raise DataError(f"bars of {run}, which is no run")
            its = [s for s in days if span[0] <= s <= span[1]]
            claims.sort(key=lambda a: (str(a["record_date"]), a["symbol"], str(a["ex_date"])))
            made = strategy(run) if strategy is not None else Targets(dict(wanted))
            walker = Walk(made, Config(**settings), claims, life if lived else None, its)
            feed_ = _feed(r for part in ([first] if first else [], own) for r in part)
            for row in walk(run, feed_, walker, its, hours, known):
                out.append(row)
                if len(out) >= 50_000:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    return feed.mapInArrow(play, SCHEMA)


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "date": pa.date32(), "timestamp_ntz": pa.timestamp("us")}[kind]


def backtest(targets: DataFrame, bars: DataFrame, config: Config | None = None, actions: DataFrame | None = None, own_bars: bool = False, lives: DataFrame | None = None) -> DataFrame:
    """Daily runs of targets (run, day, symbol, weight: a whole portfolio at the close of a day; symbol null sells everything).

    bars: day, symbol, open, close, volume, up_limit, down_limit, suspended; a repeated (day, symbol) is a DataError. Each run
    takes the bars of its own symbols, and all sessions of the bars' days from its first target on; a run without targets has
    no rows. own_bars: bars have a column run too, and a run takes only its own (prices of a scenario).
    """
    days = [r[0] for r in bars.select("day").distinct().collect()]  # a row a session
    spark = targets.sparkSession
    if not days:
        return spark.createDataFrame([], SCHEMA)
    runs = targets.groupBy("run").agg(F.min("day").alias("first")).withColumn("last", F.lit(max(days)).cast("date"))
    clock = lambda text: (F.col("day").cast("timestamp_ntz") + F.expr(f"INTERVAL '{text}' HOUR TO MINUTE"))
    timed = bars.withColumns({"at": clock(Hours().daily_at), "start": clock(Hours().segments[0][0])})
    return simulate(runs, timed, days, targets=targets, config=config, actions=actions, own_bars=own_bars, own_symbols=True, lives=lives)


def period_ends(sessions: DataFrame, day: str, every: str) -> DataFrame:
    """The last session of each day, week (ISO) or month of a list of sessions; the last session of all is left out, since only
    the one after it could tell. The list has a row a session, so its window is bounded by the calendar."""
    if every not in ("day", "week", "month"):
        raise RequestError("every is day, week or month")
    if every == "day":
        return sessions.select(day)
    following = sessions.select(day, F.lead(day).over(Window.orderBy(day)).alias("_next"))
    return following.where(F.col("_next").isNotNull() & (F.trunc(day, every) != F.trunc("_next", every))).select(day)


def coverage(rows: DataFrame) -> DataFrame:
    """Of each run: orders, fills, orders that got nothing, turnover, fees, bars seen, and sessions without a bar."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    days = F.count_if((F.col("kind") == "equity") & (F.coalesce("bars", F.lit(0)) == 0))
    return rows.groupBy("run").agg(kind("submitted").alias("orders"), kind("fill").alias("fills"), kind("blocked").alias("blocked"), F.coalesce(F.sum("notional"), F.lit(0.0)).alias("turnover"), F.coalesce(F.sum("fee"), F.lit(0.0)).alias("fees"), F.coalesce(F.sum("bars"), F.lit(0)).alias("bars"), days.alias("sessions_without_bars"))


def require_bars(rows: DataFrame) -> None:
    """DataError if a run saw no bar at all."""
    none = coverage(rows).where("bars = 0").select("run").first()
    if none is not None:
        raise DataError(f"run {none[0]} has not a single bar")


def blocked_reasons(rows: DataFrame) -> DataFrame:
    """(run, reason, n) of orders that ended without a fill."""
    return rows.where(F.col("kind").isin("blocked", "canceled", "expired")).groupBy("run", "reason").agg(F.count("*").alias("n"))
