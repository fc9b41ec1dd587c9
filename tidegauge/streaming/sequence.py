"""Quotes under one running number: a ring of the last ones, served over HTTP, and a streaming source that reads it on."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Iterable, Iterator, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidegauge.errors import RequestError, UnavailableError
from tidegauge.functions.values import epoch_micros, last_first
from tidegauge.operators.bars import latest
from tidegauge.sources.store import Store

# Records that a ring keeps, that one answer has at most, the longest wait, and stocks that may be subscribed.
CAPACITY, MOST, LONGEST_WAIT_MS, MOST_STOCKS = 10_000, 1_000, 30_000, 50
#: A quote as it comes: its number, code, period, where it was subscribed, when it came (epoch) and its body as JSON.
SCHEMA = "seq long, code string, period string, source string, subscription string, received_at long, quote string"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


class OutOfRange(UnavailableError):
    """A number that the ring does not have, and those that it has from and to (None: it is empty)."""

    def __init__(self, seq: int, oldest: int | None, newest: int | None):
        super().__init__(f"no quote {seq}: the ring has {oldest} to {newest}")
        self.seq, self.oldest, self.newest = seq, oldest, newest


class Ring:
    """The last records under numbers from 1 on without a gap. When it is full the oldest go."""

    def __init__(self, capacity: int = CAPACITY):
        if capacity < 1:
            raise RequestError("a ring has room for a record")
        self.records: deque[dict] = deque(maxlen=capacity)
        self.next, self.changed = 1, threading.Condition()

    def append(self, quotes: Iterable[tuple[str, Mapping]], source: str, subscription: str, period: str, received_at: int) -> None:
        with self.changed:
            for code, quote in quotes:
                self.records.append({"seq": self.next, "code": code, "period": period, "source": source, "subscription": subscription, "received_at": received_at, "quote": dict(quote)})
                self.next += 1
            self.changed.notify_all()

    def bounds(self) -> tuple[int | None, int | None]:
        return (self.next - len(self.records), self.next - 1) if self.records else (None, None)

    def read(self, seq: int, limit: int = MOST, wait_ms: int = 0) -> dict:
        """Up to `limit` records from seq on. The number that comes next may be waited for, and gives no records in vain; other
        numbers that the ring does not have are OutOfRange."""
        if not 1 <= limit or wait_ms < 0:
            raise RequestError("a limit is 1 or more, a wait is not negative")
        until = time.monotonic() + wait_ms / 1000
        with self.changed:
            while seq == self.next and (left := until - time.monotonic()) > 0:
                self.changed.wait(left)
            oldest, newest = self.bounds()
            if seq != self.next and (oldest is None or not oldest <= seq <= newest):
                raise OutOfRange(seq, oldest, newest)
            skip = 0 if seq == self.next else seq - oldest
            found = [] if seq == self.next else [self.records[i] for i in range(skip, min(skip + limit, len(self.records)))]
            return {"data": found, "next_seq": seq + len(found), "oldest_seq": oldest, "latest_seq": newest}


class Gate:
    """Lets a subscription's callbacks through only between activate() and close(); what came before waits for activate()."""

    def __init__(self, callback):
        self.callback, self.state, self.waiting, self.lock = callback, "pending", [], threading.Lock()

    def __call__(self, *args) -> None:
        with self.lock:
            if self.state == "pending":
                self.waiting.append(args)
            elif self.state == "active":
                self.callback(*args)

    def activate(self) -> None:
        with self.lock:
            if self.state == "closed":
                return
            self.state = "active"
            for args in self.waiting:
                self.callback(*args)
            self.waiting.clear()

    def close(self) -> None:
        with self.lock:
            self.state = "closed"
            self.waiting.clear()


class Subscriptions:
    """Whole markets by tick, and single stocks in one period each; pushes go to the ring and to the last value of each code."""

    def __init__(self, ring: Ring, most_stocks: int = MOST_STOCKS):
        self.ring, self.most = ring, most_stocks
        self.markets: dict[str, dict] = {}
        self.stocks: dict[str, tuple[str, dict]] = {}
        self.lock = threading.RLock()

    def add_markets(self, names: Iterable[str]) -> set[str]:
        with self.lock:
            new = set(names) - set(self.markets)
            self.markets |= {n: {} for n in new}
            return new

    def add_stocks(self, codes: Iterable[str], period: str) -> set[str]:
        """RequestError beyond the limit, or if a code is subscribed in another period."""
        with self.lock:
            wanted = set(codes)
            if len(wanted | set(self.stocks)) > self.most:
                raise RequestError(f"more than {self.most} stocks")
            other = {c for c in wanted & set(self.stocks) if self.stocks[c][0] != period}
            if other:
                raise RequestError(f"{sorted(other)} have another period")
            new = wanted - set(self.stocks)
            self.stocks |= {c: (period, {}) for c in new}
            return new

    def remove_markets(self, names: Iterable[str] | None = None) -> set[str]:
        with self.lock:
            gone = set(self.markets) if names is None else set(names) & set(self.markets)
            for n in gone:
                del self.markets[n]
            return gone

    def remove_stocks(self, codes: Iterable[str], period: str) -> set[str]:
        with self.lock:
            gone = {c for c in codes if c in self.stocks and self.stocks[c][0] == period}
            for c in gone:
                del self.stocks[c]
            return gone

    def push_market(self, market: str, quotes: Mapping[str, Mapping], received_at: int) -> None:
        with self.lock:
            if quotes and market in self.markets:
                self.ring.append(quotes.items(), "market", market, "tick", received_at)
                self.markets[market].update(quotes)

    def push_stock(self, stock: str, quotes: Mapping[str, list[Mapping]], received_at: int) -> None:
        with self.lock:
            each = [(c, q) for c, rows in quotes.items() for q in rows]
            if each and stock in self.stocks:
                self.ring.append(each, "stock", stock, self.stocks[stock][0], received_at)
                self.stocks[stock][1].update({c: rows[-1] for c, rows in quotes.items() if rows})

    def last(self) -> dict[str, Mapping]:
        """The last quote of each code; a stock's own subscription goes before its market's."""
        with self.lock:
            out: dict[str, Mapping] = {}
            for quotes in self.markets.values():
                out |= quotes
            for _, quotes in self.stocks.values():
                out |= quotes
            return out


def serve(ring: Ring, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """An HTTP server of a ring in a thread of its own: POST /sequence of {seq, limit, wait_ms}; 416 with the bounds if the ring
    does not have the number, 400 for other faults. Shut it down with shutdown()."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                strange = set(body) - {"seq", "limit", "wait_ms"}
                limit, wait = body.get("limit", MOST), body.get("wait_ms", 0)
                if self.path != "/sequence" or strange or not 1 <= limit <= MOST or not 0 <= wait <= LONGEST_WAIT_MS:
                    raise RequestError("seq, limit up to 1000 and wait_ms up to 30000")
                code, answer = 200, ring.read(body["seq"], limit, wait)
            except OutOfRange as e:
                code, answer = 416, {"oldest_seq": e.oldest, "latest_seq": e.newest}
            except (RequestError, KeyError, TypeError, ValueError) as e:
                code, answer = 400, {"detail": str(e)}
            data = json.dumps(answer).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class SequenceClient:
    def __init__(self, url: str, timeout: float = 60.0):
        self.url, self.timeout = url.rstrip("/"), timeout

    def read(self, seq: int, limit: int = MOST, wait_ms: int = 0) -> dict:
        request = urllib.request.Request(f"{self.url}/sequence", json.dumps({"seq": seq, "limit": limit, "wait_ms": wait_ms}).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code != 416:
                raise
            bounds = json.load(e)
            raise OutOfRange(seq, bounds["oldest_seq"], bounds["latest_seq"]) from None


def read_on(client, seq: int, limit: int = MOST, wait_ms: int = 0) -> tuple[list[dict], int, int]:
    """(records, number to go on from, records lost) at or after seq. If the ring has gone past seq, its oldest records move on
    while they are asked for, so tries start before them and reach 1, 2, 4... numbers further."""
    try:
        found = client.read(seq, limit, wait_ms)
        return found["data"], found["next_seq"], 0
    except OutOfRange as e:
        error = e
    if error.newest is None or seq == error.newest + 1:
        return [], seq, 0
    at, step = max(1, error.oldest - 1), 1
    while True:
        try:
            found = client.read(at, limit)
            records = found["data"]
            return records, found["next_seq"], max(0, (records[0]["seq"] if records else at) - seq)
        except OutOfRange as e:
            if e.oldest is None:
                return [], seq, 0
            at, step = min(e.newest, e.oldest + step), step * 2


class QuoteSequence(DataSource):
    """spark.readStream.format("quote_sequence"): options url, start (1), limit (1000), wait_ms (0) and fail_on_loss (false).
    The offset is the next number, so a query goes on after a restart where its checkpoint says."""

    @classmethod
    def name(cls) -> str:
        return "quote_sequence"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema):
        return _SequenceReader({k.lower(): v for k, v in self.options.items()})


class _SequenceReader(SimpleDataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        if "url" not in options:
            raise RequestError("a sequence has a url")
        self.client = SequenceClient(options["url"])
        self.start, self.limit, self.wait = int(options.get("start", 1)), int(options.get("limit", MOST)), int(options.get("wait_ms", 0))
        self.strict = options.get("fail_on_loss", "false").lower() == "true"
        if self.start < 1 or not 1 <= self.limit <= MOST or not 0 <= self.wait <= LONGEST_WAIT_MS:
            raise RequestError("start is 1 or more, limit up to 1000, wait_ms up to 30000")

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    @staticmethod
    def _rows(records: list[dict]) -> Iterator[tuple]:
        return iter([tuple(json.dumps(r[f]) if f == "quote" else r[f] for f in FIELDS) for r in records])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        records, following, lost = read_on(self.client, start["seq"], self.limit, self.wait)
        if lost and self.strict:
            raise UnavailableError(f"{lost} quotes from {start['seq']} on are gone")
        return self._rows(records), {"seq": following}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch again, after a failure: what the ring still has of it."""
        at, out = start["seq"], []
        while at < end["seq"]:
            records, following, lost = read_on(self.client, at, min(self.limit, end["seq"] - at))
            if lost and self.strict:
                raise UnavailableError(f"{lost} quotes from {at} on are gone")
            out += [r for r in records if r["seq"] < end["seq"]]
            if following == at:
                break
            at = following
        return self._rows(out)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QuoteSequence)


TICK = "time long, lastPrice double, open double, high double, low double, lastClose double, amount double, volume long, pvolume long"
BAR = "time long, open double, high double, low double, close double, volume long, amount double, preClose double, suspendFlag long"


def local_day(micros: Column) -> Column:
    """The day in Shanghai of an instant in microseconds."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.timestamp_micros(micros).cast("timestamp_ntz")))


def events(quotes: DataFrame, kind: str) -> DataFrame:
    """Rows of SCHEMA with the body parsed as `kind`, the event time that it names (null if none) and the trading day, by the
    event time if there is one, else by when the quote came."""
    parsed = quotes.withColumn("quote", F.from_json("quote", kind))
    event = epoch_micros(F.when(F.col("quote.time") > 0, F.col("quote.time")))
    day = local_day(F.coalesce("event_time", epoch_micros(F.col("received_at"))))
    return parsed.withColumn("event_time", event).withColumn("trading_date", day)


def sink(store: Store, ticks: str = "ticks", bars: str = "bars"):
    """A foreachBatch function that appends ticks and bars to their tables of a store. A batch that runs again appends again;
    compaction keeps the row of a key that came last, so that changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, kind, which in ((ticks, TICK, F.col("period") == "tick"), (bars, BAR, F.col("period") != "tick")):
                rows = kept.where(which)
                if name in store.tables and not rows.isEmpty():
                    store.append(name, events(rows, kind).select(store.tables[name].schema.names))
        finally:
            kept.unpersist()

    return write


def last_quotes(quotes: DataFrame) -> DataFrame:
    """The last quote of each code; one from a stock's own subscription goes before its market's."""
    return latest(quotes, ["code"], [(F.col("source") == "stock").desc_nulls_last(), *last_first("seq")])
