"""Ingestion of a vendor's paged endpoints: requests are rows, executors fetch their pages, a store gets typed rows.

A client is anything with fetch(endpoint, params, limit, offset) -> list of dicts. It is made in each worker by a factory, and its
share of the vendor's rate is that of its partition: the requests of one job run in at most `concurrency` partitions.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.errors import DataError, RequestError, UnavailableError
from tidegauge.sources.store import Store

# Rows of a page, and days of a chunk that is written and marked as done at once.
PAGE, MEMBER_PAGE = 5_000, 2_000
MARKET_DAYS, ANNOUNCEMENT_DAYS, CALENDAR_DAYS = 31, 366, 3_650
# Exchanges of the calendar, and listing states of stocks.
EXCHANGES, STATES = ("SSE", "SZSE", "BSE"), ("L", "D", "P")
# Days, sessions or years that a daily refresh goes back, and the days of its longer refreshes.
STABLE_SESSIONS, FACTOR_SESSIONS, FINANCIAL_DAYS, FINANCIAL_YEARS, EVENT_DAYS, DIVIDEND_DAYS, DIVIDEND_YEARS = 5, 10, 10, 3, 180, 30, 2
CALENDAR_PAST, CALENDAR_FUTURE, WEEKLY_ON, MONTHLY_ON = 60, 366, 0, 1
# How fast and how often a vendor may be asked.
REQUESTS_A_MINUTE, CONCURRENCY, RETRIES, BACKOFF = 120, 3, 10, 1.0


@dataclass(frozen=True)
class Request:
    """One paged call. page: rows that a full page has."""

    endpoint: str
    params: tuple[tuple[str, str], ...]
    page: int = PAGE


def text(day: date) -> str:
    return day.strftime("%Y%m%d")


def parse_day(value: str | date) -> date:
    """YYYYMMDD, YYYY-MM-DD or a date."""
    if isinstance(value, date):
        return value
    try:
        digits = str(value).strip().replace("-", "")
        return date(int(digits[:4]), int(digits[4:6]), int(digits[6:8])) if len(digits) == 8 and digits.isdigit() else date.fromisoformat("x")
    except ValueError:
        raise RequestError(f"a day is YYYYMMDD or YYYY-MM-DD, not {value!r}") from None


def chunks(start: date, end: date, days: int | None) -> list[tuple[date, date]]:
    """[start, end] in parts of at most `days` days, or whole."""
    if days is None:
        return [(start, end)]
    out = []
    while start <= end:
        out.append((start, min(end, start + timedelta(days=days - 1))))
        start = out[-1][1] + timedelta(days=1)
    return out


def missing(start: date, end: date, done: list[tuple[date, date]]) -> list[tuple[date, date]]:
    """What merged ranges leave of [start, end]."""
    out = []
    for a, b in merged(done):
        if b < start:
            continue
        if a > end:
            break
        if a > start:
            out.append((start, a - timedelta(days=1)))
        start = b + timedelta(days=1)
    return [*out, (start, end)] if start <= end else out


def merged(ranges: Iterable[tuple[date, date]]) -> list[tuple[date, date]]:
    """Closed ranges, those that touch or overlap made one."""
    out: list[tuple[date, date]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + timedelta(days=1):
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def years_before(day: date, years: int) -> date:
    """The same day of an earlier year; 29 February falls back to the 28th."""
    try:
        return day.replace(year=day.year - years)
    except ValueError:
        return day.replace(year=day.year - years, day=28)


# requests of each kind of endpoint, for a range of days


def by_session(endpoint: str) -> Callable:
    return lambda start, end, context: [Request(endpoint, (("trade_date", text(d)),)) for d in context.open_days(start, end)]


def by_range(endpoint: str) -> Callable:
    return lambda start, end, context: [Request(endpoint, (("start_date", text(start)), ("end_date", text(end))))]


def by_two_dates(endpoint: str) -> Callable:
    """Every day as the day of the plan and as that of its implementation: rows may come twice."""
    days = lambda a, b: [a + timedelta(days=k) for k in range((b - a).days + 1)]
    return lambda start, end, context: [Request(endpoint, ((name, text(d)),)) for d in days(start, end) for name in ("ann_date", "imp_ann_date")]


def by_stock(endpoint: str) -> Callable:
    return lambda start, end, context: [Request(endpoint, (("ts_code", c), ("start_date", text(start)), ("end_date", text(end)))) for c in context.codes()]


def by_value(endpoint: str, name: str, values: Iterable[str], page: int = PAGE) -> Callable:
    """A whole snapshot, one call for each value."""
    return lambda start, end, context: [Request(endpoint, ((name, v),), page) for v in values]


def by_exchange(endpoint: str) -> Callable:
    return lambda start, end, context: [Request(endpoint, (("exchange", e), ("start_date", text(start)), ("end_date", text(end)))) for e in EXCHANGES]


@dataclass(frozen=True)
class Spec:
    """How a table is fetched: its requests, the days of a chunk (None: all at once), whether a fetch is the whole table."""

    requests: Callable
    days: int | None = MARKET_DAYS
    snapshot: bool = False


SPECS: dict[str, Spec] = {
    "trade_cal": Spec(by_exchange("trade_cal"), CALENDAR_DAYS),
    "stock_basic": Spec(by_value("stock_basic", "list_status", STATES), None, snapshot=True),
    **{n: Spec(by_session(n)) for n in ("bak_basic", "daily", "daily_basic", "stk_limit", "stock_st", "adj_factor", "suspend_d", "moneyflow")},
    "dividend": Spec(by_two_dates("dividend")),
    **{n: Spec(by_range(f"{n}_vip"), ANNOUNCEMENT_DAYS) for n in ("forecast", "express", "income", "balancesheet", "cashflow", "fina_indicator")},
    "sw_industry": Spec(by_value("index_member_all", "is_new", ("Y", "N"), MEMBER_PAGE), None, snapshot=True),
    "fina_audit": Spec(by_stock("fina_audit"), None),
}


# fetching


def pages(client, request: Request) -> Iterator[list[dict]]:
    """The pages of a request until one is not full. A full page that equals the one before means that the offset is ignored."""
    offset, before = 0, None
    while True:
        rows = client.fetch(request.endpoint, dict(request.params), request.page, offset)
        if not rows:
            return
        if rows == before:
            raise DataError(f"{request.endpoint} ignores the offset")
        yield rows
        if len(rows) < request.page:
            return
        offset, before = offset + len(rows), rows


class Patient:
    """A client that keeps to a rate and asks again after network errors, each time after twice as long."""

    def __init__(self, client, per_minute: float = REQUESTS_A_MINUTE, retries: int = RETRIES, backoff: float = BACKOFF, sleep=time.sleep, now=time.monotonic):
        if per_minute <= 0 or retries < 0:
            raise RequestError("a rate is positive, retries are not negative")
        self.client, self.gap, self.retries, self.backoff, self.sleep, self.now = client, 60 / per_minute, retries, backoff, sleep, now
        self.next = float("-inf")

    def fetch(self, endpoint: str, params: Mapping[str, str], limit: int, offset: int) -> list[dict]:
        for k in range(self.retries + 1):
            wait = self.next - self.now()
            if wait > 0:
                self.sleep(wait)
            self.next = self.now() + self.gap
            try:
                return self.client.fetch(endpoint, params, limit, offset)
            except (ConnectionError, TimeoutError, urllib.error.URLError) as e:
                if k == self.retries or isinstance(e, urllib.error.HTTPError):
                    raise
                self.sleep(self.backoff * 2**k)
        raise AssertionError


@dataclass(frozen=True)
class HttpClient:
    """The vendor's JSON protocol: a POST of api_name, token, params and fields; rows come as fields and items."""

    url: str
    token: str
    fields: Mapping[str, str] = field(default_factory=dict)
    timeout: float = 120.0

    def fetch(self, endpoint: str, params: Mapping[str, str], limit: int, offset: int) -> list[dict]:
        body = {"api_name": endpoint, "token": self.token, "params": {**params, "limit": limit, "offset": offset}, "fields": self.fields.get(endpoint, "")}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            found = json.load(answer)
        if found.get("code") not in (0, None):
            raise UnavailableError(f"{endpoint}: {found.get('msg')}")
        data = found.get("data") or {}
        return [dict(zip(data.get("fields", ()), row, strict=True)) for row in data.get("items", ())]


def fetched(spark: SparkSession, requests: list[Request], schema: StructType, factory: Callable[[], object], concurrency: int = CONCURRENCY, per_minute: float = REQUESTS_A_MINUTE) -> DataFrame:
    """The typed rows of all requests. A request is one row of a table that at most `concurrency` partitions share, and so is
    the rate; a page is a batch, so a worker holds one page. Rows must have all of the schema's columns, in any order."""
    names = schema.names
    rows = [(k, r.endpoint, json.dumps(dict(r.params)), r.page) for k, r in enumerate(requests)]
    parts = max(1, min(concurrency, len(rows)))
    tasks = spark.createDataFrame(rows, "k long, endpoint string, params string, page int").repartition(parts, "k")

    def run(batches):
        client = Patient(factory(), per_minute / parts)
        for batch in batches:
            for endpoint, params, page in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                for found in pages(client, Request(endpoint, tuple(json.loads(params).items()), page)):
                    lost = [n for n in names if n not in found[0]]
                    if lost:
                        raise DataError(f"{endpoint} gives no {lost}")
                    yield pa.RecordBatch.from_arrays([pa.array([_cell(r.get(n)) for r in found], pa.string()) for n in names], names)

    raw = tasks.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
    return raw.select(*[_typed(f.name, f.dataType.simpleString()).alias(f.name) for f in schema])


def _cell(value) -> str | None:
    """A cell as text; None and numbers that are no number are null."""
    return None if value is None or value != value else str(value)


def _typed(name: str, kind: str) -> Column:
    """A text cell in its column's type; text that does not fit fails the job."""
    c = F.col(name)
    if kind == "date":
        return F.to_date(F.replace(F.trim(c), F.lit("-"), F.lit("")), "yyyyMMdd")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("double").cast(kind)
    return c.cast(kind)


# what has been fetched


@dataclass
class Progress:
    """The ranges of days that were fetched whole, a versioned file for each table under the store's root."""

    store: Store

    def _folder(self, dataset: str) -> str:
        return f"_sync/{dataset}"

    def done(self, dataset: str) -> list[tuple[date, date]]:
        """The merged ranges; DataError if the file is none of ours."""
        names = self._versions(dataset)
        if not names:
            return []
        found = json.loads(self.store._text(self.store._path(f"{self._folder(dataset)}/{names[-1]}.json")))
        try:
            if found["version"] != 1 or found["dataset"] != dataset:
                raise ValueError
            out = [(date.fromisoformat(r["start_date"]), date.fromisoformat(r["end_date"])) for r in found["completed_ranges"]]
            if any(a > b for a, b in out):
                raise ValueError
        except (KeyError, TypeError, ValueError):
            raise DataError(f"the progress of {dataset} cannot be read") from None
        return merged(out)

    def _versions(self, dataset: str) -> list[int]:
        fs, path = self.store._fs(), self.store._path(self._folder(dataset))
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName()[:-5].isdigit()) if fs.exists(path) else []

    def mark(self, dataset: str, start: date, end: date) -> None:
        """Add a range; another writer's ranges are kept."""
        if start > end:
            raise RequestError("a range ends before it starts")
        while True:
            versions = self._versions(dataset)
            ranges = merged([*self.done(dataset), (start, end)])
            made = {"version": 1, "dataset": dataset, "completed_ranges": [{"start_date": a.isoformat(), "end_date": b.isoformat()} for a, b in ranges]}
            self.store._fs().mkdirs(self.store._path(self._folder(dataset)))
            if self.store._put(f"{self._folder(dataset)}/{(versions or [0])[-1] + 1}.json", json.dumps(made)):
                return

    def covered(self) -> tuple[tuple[str, str, str], ...]:
        """What Catalog.covered takes, of all tables of the store."""
        return tuple((n, a.isoformat(), b.isoformat()) for n in self.store.tables for a, b in self.done(n))


@dataclass
class Sync:
    """Fetches tables into a store, chunk by chunk; a chunk that is written is marked, so a run that stopped goes on there."""

    store: Store
    factory: Callable[[], object]
    specs: Mapping[str, Spec] = field(default_factory=lambda: SPECS)
    concurrency: int = CONCURRENCY
    per_minute: float = REQUESTS_A_MINUTE

    def __post_init__(self):
        self.progress = Progress(self.store)

    # what requests depend on

    def open_days(self, start: date, end: date) -> list[date]:
        """Days on which an exchange is open, by the store's calendar, which is fetched first where it has gaps."""
        days = [start + timedelta(days=k) for k in range((end - start).days + 1)]
        known = self.store.read("trade_cal", filters=[("cal_date", ">=", start), ("cal_date", "<=", end)])
        rows = known.groupBy("cal_date").agg(F.count_distinct("exchange").alias("n"), F.max(F.col("is_open").cast("int")).alias("o")).collect()
        full = {r["cal_date"]: r["o"] for r in rows if r["n"] >= len(EXCHANGES)}
        lost = [d for d in days if d not in full]
        if lost:
            for a, b in merged((d, d) for d in lost):
                self._write("trade_cal", a, b)
            rows = self.store.read("trade_cal", filters=[("cal_date", ">=", start), ("cal_date", "<=", end)]).groupBy("cal_date").agg(F.max(F.col("is_open").cast("int")).alias("o")).collect()
            full = {r["cal_date"]: r["o"] for r in rows}
        return [d for d in days if full.get(d) == 1]

    def codes(self) -> list[str]:
        """All codes that the vendor knows, delisted ones included."""
        client, found = Patient(self.factory(), self.per_minute), set()
        for state in STATES:
            for rows in pages(client, Request("stock_basic", (("list_status", state),))):
                found |= {r["ts_code"] for r in rows if r.get("ts_code")}
        return sorted(found)

    # writing

    def _write(self, dataset: str, start: date, end: date) -> int:
        """Fetch one chunk, drop equal rows, append, and make one row of each key in the partitions touched."""
        config = self.store._table(dataset)
        requests = self.specs[dataset].requests(start, end, self)
        if not requests:
            return 0
        rows = fetched(self.store.spark, requests, config.schema, self.factory, self.concurrency, self.per_minute).dropDuplicates()
        from tidegauge.scratch import cut

        made = cut(rows, f"fetch_{dataset}")
        if not made.where(" or ".join(f"{c} is null" for c in config.partition_by)).isEmpty():
            raise DataError(f"{dataset}: rows without {config.partition_by}")
        n = made.count()
        if n:
            self.store.append(dataset, made)
            touched = [tuple(r) for r in made.select(*config.partition_by).distinct().collect()]
            self.store.compact(dataset, touched)
        return n

    def one(self, dataset: str, start: str | date, end: str | date, force: bool = False) -> int:
        """Fetch what is missing of a range, or all of it; the number of rows."""
        a, b = parse_day(start), parse_day(end)
        if dataset not in self.specs or dataset not in self.store.tables or a > b:
            raise RequestError(f"unknown table {dataset}, or a range that ends before it starts")
        spec = self.specs[dataset]
        gaps = missing(a, b, [] if force else self.progress.done(dataset))
        total = 0
        if spec.snapshot and gaps:
            total = self._write(dataset, a, b)
            for x, y in gaps:
                self.progress.mark(dataset, x, y)
            return total
        for gap in gaps:
            for x, y in chunks(*gap, spec.days):
                total += self._write(dataset, x, y)
                self.progress.mark(dataset, x, y)
        return total

    def some(self, datasets: Iterable[str], start: str | date, end: str | date, force: bool = False) -> dict[str, int]:
        """one() for several tables, one after the other."""
        chosen = list(dict.fromkeys(datasets))
        if not chosen:
            raise RequestError("no tables")
        return {d: self.one(d, start, end, force) for d in chosen}

    def all(self, start: str | date, end: str | date, force: bool = False) -> dict[str, int]:
        """The calendar, which others depend on, and then all other tables side by side."""
        names = [d for d in self.specs if d in self.store.tables]
        out = {d: self.one(d, start, end, force) for d in names if d == "trade_cal"}
        rest = [d for d in names if d != "trade_cal"]
        with ThreadPoolExecutor(max(1, len(rest))) as pool:
            made = {d: pool.submit(self.one, d, start, end, force) for d in rest}
            return out | {d: f.result() for d, f in made.items()}

    def windows(self, today: str | date) -> dict[str, tuple[date, date] | None]:
        """The days that a daily refresh fetches anew of each table; None: not today."""
        day = parse_day(today)
        opened = self.open_days(day - timedelta(days=CALENDAR_PAST), day)
        back = lambda n: (opened[-min(n, len(opened))], day) if opened else None
        ago = lambda n: (day - timedelta(days=n - 1), day)
        monthly, weekly = day.day == MONTHLY_ON, day.weekday() == WEEKLY_ON
        out = {"trade_cal": (day - timedelta(days=CALENDAR_PAST), day + timedelta(days=CALENDAR_FUTURE)), "stock_basic": (day, day)}
        out |= dict.fromkeys(("bak_basic", "daily", "stk_limit", "suspend_d", "stock_st"), back(STABLE_SESSIONS))
        out |= dict.fromkeys(("daily_basic", "moneyflow", "adj_factor"), back(FACTOR_SESSIONS))
        out |= dict.fromkeys(("income", "balancesheet", "cashflow", "fina_indicator"), (years_before(day, FINANCIAL_YEARS), day) if monthly else ago(FINANCIAL_DAYS))
        out |= dict.fromkeys(("forecast", "express"), ago(EVENT_DAYS))
        out |= {"fina_audit": ago(EVENT_DAYS) if weekly else None, "sw_industry": (day, day) if weekly else None}
        out["dividend"] = (years_before(day, DIVIDEND_YEARS), day) if monthly else ago(DIVIDEND_DAYS)
        return out

    def refresh(self, today: str | date) -> dict[str, int]:
        """Fetch a daily refresh's windows, the calendar first; nothing is marked as done."""
        day = parse_day(today)
        out = {"trade_cal": self._write("trade_cal", day - timedelta(days=CALENDAR_PAST), day + timedelta(days=CALENDAR_FUTURE))}
        jobs = {d: w for d, w in self.windows(day).items() if d != "trade_cal" and d in self.store.tables and d in self.specs}
        run = lambda d, w: sum(self._write(d, a, b) for a, b in chunks(*w, self.specs[d].days)) if w else 0
        with ThreadPoolExecutor(max(1, len(jobs))) as pool:
            made = {d: pool.submit(run, d, w) for d, w in jobs.items()}
            return out | {d: f.result() for d, f in made.items()}
