"""Queries of sources: paged requests, days and instants as sources write them, pruned and buffered stores, beside their SQL."""

from __future__ import annotations

from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.plans.market import _read, _shared, query
from tidegauge.sources import download, ingest
from tidegauge.sources.store import Buffered, Store, TableConfig


class _Vendor:
    """A day has as many rows as seven times its number in the month, in pages."""

    def fetch(self, endpoint: str, params: dict, limit: int, offset: int) -> list[dict]:
        day = ingest.parse_day(params["trade_date"])
        return [{"ts_code": f"S{k}", "trade_date": params["trade_date"], "close": f"{k / 4}", "vol": None if k % 5 else float("nan")} for k in range(offset, min(offset + limit, 7 * day.day))]


@query("""WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY)) AS DATE) AS trade_date)
SELECT 'S' || k AS ts_code, trade_date, k / 4 AS close, CAST(NULL AS DOUBLE) AS vol FROM (SELECT trade_date, unnest(range(7 * day(trade_date))) AS k FROM d)""")
def ingest_pages(spark, d) -> DataFrame:
    """One request a day, each read page by page by the executors."""
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(46)]
    requests = [ingest.Request("daily", (("trade_date", ingest.text(x)),), 50) for x in days]
    return ingest.fetched(spark, requests, StructType.fromDDL("ts_code string, trade_date date, close double, vol double"), _Vendor, per_minute=6e6)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def source_days(spark, d) -> DataFrame:
    """Days as text with and without dashes, with a clock behind, and as epochs of several units in Shanghai."""
    o = _read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("x"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 50_000).alias("s"))
    k = F.col("o_orderkey") % 5
    digits = F.date_format("x", "yyyyMMdd")
    written = F.when(k == 0, digits).when(k == 1, F.date_format("x", "yyyy-MM-dd")).when(k == 2, F.concat(F.lit(" "), digits, F.lit(" "))).when(k == 3, (F.col("s") * 1000).cast("string")).otherwise((F.col("s") * 1_000_000).cast("string"))
    return o.select("o_orderkey", download.day_of(written).alias("day"))


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) AS micros FROM events")
def source_instants(spark, d) -> DataFrame:
    """Instants as 14 digits of the clock in Shanghai, and as epochs in seconds, milliseconds and nanoseconds."""
    e = _read(spark, d, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("t"))
    local = F.date_format(F.col("t") + F.expr("INTERVAL '8' HOUR"), "yyyyMMddHHmmss").cast("long")
    seconds, k = F.unix_seconds(F.col("t").cast("timestamp")), F.col("event_id") % 4
    index = F.when(k == 0, local).when(k == 1, seconds).when(k == 2, seconds * 1000).otherwise(seconds * 1_000_000_000)
    return e.select("event_id", download.index_micros(index).alias("micros"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_totalprice >= 50000")
def store_pruned(spark, d) -> DataFrame:
    """Filters on the partition choose manifests, others reach the files."""
    orders = _read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    store = Store(spark, _shared(spark), {"orders": TableConfig("orders", orders.schema, ("o_orderpriority",), ("o_orderkey",), ("o_orderkey",))})
    store.append("orders", orders)
    return store.read("orders", filters=[("o_orderpriority", "in", ["1-URGENT", "3-MEDIUM"]), ("o_totalprice", ">=", 50000.0)])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def store_buffered(spark, d) -> DataFrame:
    """Rows that arrive a few at a time, written when the buffer is full and when it is closed."""
    nation = _read(spark, d, "nation")
    store = Store(spark, _shared(spark), {"nation": TableConfig("nation", nation.schema, ("n_regionkey",), (), ("n_nationkey",))})
    rows: pa.Table = nation.toArrow()  # the smallest table
    with Buffered(store, rows=10) as held:
        for k in range(0, rows.num_rows, 4):
            held.append("nation", rows.slice(k, 4))
    store.compact("nation")
    return store.read("nation")
