"""Dividends as accounts see them: facts that were carried out, once each, with versions that contradict each other marked."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.errors import DataError

SCHEMA = "symbol string, record_date date, ex_date date, pay_date date, list_date date, cash double, shares double, conflict string"


def effective(dividends: DataFrame, done: str = "实施") -> DataFrame:
    """Rows of SCHEMA of raw dividends (symbol and the raw columns): one for each fact, whichever reports name it.

    A fact is its symbol, dates, amounts and base. Facts of one symbol that differ but share the record date, or the period
    and announcement, contradict each other: conflict says so, and accounts that are entitled refuse them.
    """
    rows = dividends.where(F.col("div_proc") == done)
    whole = F.coalesce(F.col("stk_div").cast("double"), F.coalesce("stk_bo_rate", F.lit(0.0)) + F.coalesce("stk_co_rate", F.lit(0.0)))
    key = F.struct("symbol", "record_date", "ex_date", "pay_date", F.col("div_listdate").alias("list_date"), F.col("cash_div").cast("double").alias("cash"), F.col("cash_div_tax").cast("double").alias("gross"), whole.alias("shares"), "base_date", F.col("base_share").cast("double").alias("base_share"))
    facts = rows.select(key.alias("k"), "end_date", "ann_date")
    same_day = facts.where("k.record_date is not null").select("k", F.col("k.record_date").alias("d")).distinct().groupBy("k.symbol", "d").agg(F.count("*").alias("n")).where("n > 1").select("symbol", "d", F.lit("record date").alias("c1"))
    same_plan = facts.where("end_date is not null and ann_date is not null").select("k", "end_date", "ann_date").distinct().groupBy("k.symbol", "end_date", "ann_date").agg(F.count("*").alias("n")).where("n > 1").select("symbol", "end_date", "ann_date", F.lit("period and announcement").alias("c2"))
    marked = facts.select("k", "k.symbol", F.col("k.record_date").alias("d"), "end_date", "ann_date").join(same_day, ["symbol", "d"], "left").join(same_plan, ["symbol", "end_date", "ann_date"], "left")
    per = marked.where("d is not null").groupBy("k").agg(F.coalesce(F.max("c1"), F.max("c2")).alias("conflict"))
    return per.select("k.symbol", "k.record_date", "k.ex_date", "k.pay_date", "k.list_date", F.coalesce("k.cash", "k.gross").alias("cash"), F.coalesce("k.shares", F.lit(0.0)).alias("shares"), "conflict")


def faults(a: dict, sessions: set[date] | None = None, first: date | None = None, last: date | None = None) -> str | None:
    """What is wrong with an action that an account is entitled to, the first of these; None if nothing is."""
    record, ex, pay, listing = a["record_date"], a["ex_date"], a["pay_date"], a["list_date"]
    cash, shares = a["cash"], a["shares"] or 0.0
    pays, gives = cash is not None and cash > 0, shares > 0
    dates = [("record", record), ("ex", ex), *([("pay", pay)] if pays else []), *([("listing", listing)] if gives else [])]
    checks = [
        (a.get("conflict"), f"versions differ by {a.get('conflict')}"),
        (cash is not None and (not math.isfinite(cash) or cash < 0), "cash is no amount"),
        (pays and pay is None, "no pay date"),
        (not math.isfinite(shares) or shares < 0, "shares are no ratio"),
        (gives and listing is None, "no listing date"),
        (record is None, "no record date"),
        (ex is not None and record is not None and ex <= record, "ex date is not after the record date"),
        (pays and pay is not None and record is not None and pay <= record, "pay date is not after the record date"),
        (pays and pay is not None and ex is not None and pay < ex, "pay date is before the ex date"),
        (gives and listing is not None and record is not None and listing <= record, "listing date is not after the record date"),
        (gives and listing is not None and ex is not None and listing < ex, "listing date is before the ex date"),
        *((d is not None and sessions is not None and first <= d <= last and d not in sessions, f"the {name} date {d} is no session") for name, d in dates),
    ]
    return next((message for broken, message in checks if broken), None)


@dataclass
class Claims:
    """The actions of one run by their days, and what the account is entitled to: shares held at the end of the record day."""

    rows: list[dict]
    sessions: list[date] = field(default_factory=list)
    entitled: dict[int, int] = field(default_factory=dict)
    owed: dict[int, float] = field(default_factory=dict)
    unlisted: dict[int, tuple[str, int]] = field(default_factory=dict)

    def __post_init__(self):
        self.by = {k: defaultdict(list) for k in ("record_date", "ex_date", "pay_date", "list_date")}
        known = set(self.sessions)
        for i, r in enumerate(self.rows):
            for k, days in self.by.items():
                if r[k] is not None:
                    days[r[k]].append(i)
        # a record day without trading counts with the session before it, since nothing changes hands in between
        for day in sorted(set(self.by["record_date"]) - known) if known else ():
            before = max((s for s in self.sessions if s < day), default=None)
            if before is None:  # nothing was held yet
                self.entitled |= dict.fromkeys(self.by["record_date"][day], 0)
            else:
                self.by["record_date"][before] += self.by["record_date"].pop(day)

    def _check(self, i: int) -> None:
        wrong = faults(self.rows[i], set(self.sessions) or None, self.sessions[0] if self.sessions else None, self.sessions[-1] if self.sessions else None)
        if wrong:
            raise DataError(f"dividend of {self.rows[i]['symbol']} recorded on {self.rows[i]['record_date']}: {wrong}")

    def _entitlement(self, i: int, held: int) -> int:
        """DataError if the account holds shares and has no entitlement on record."""
        if i not in self.entitled and held > 0:
            raise DataError(f"dividend of {self.rows[i]['symbol']}: no holding is on record")
        return self.entitled.get(i, 0)

    def record(self, day: date, held) -> None:
        """End of a session. held(symbol) is what the account has."""
        for i in self.by["record_date"].get(day, ()):
            self.entitled.setdefault(i, held(self.rows[i]["symbol"]))
            if self.entitled[i] > 0:
                self._check(i)

    def due(self, day: date, kind: str):
        return [(i, self.rows[i]) for i in self.by[kind].get(day, ())]

    def recognise_cash(self, i: int, n: int) -> None:
        if n > 0 and (self.rows[i]["cash"] or 0) > 0:
            self._check(i)
            self.owed[i] = n * self.rows[i]["cash"]

    def new_shares(self, i: int, n: int) -> int:
        if n <= 0 or not (self.rows[i]["shares"] or 0) > 0:
            return 0
        self._check(i)
        shares = math.floor(n * self.rows[i]["shares"] + 1e-9)
        self.unlisted[i] = (self.rows[i]["symbol"], shares)
        return shares

    def write_off(self, symbol: str) -> None:
        self.unlisted = {i: x for i, x in self.unlisted.items() if x[0] != symbol}
