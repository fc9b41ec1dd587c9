"""Trading arithmetic and the metrics of an equity path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dates from which a rate holds, and the rates before and after.
STAMP_TAX = ("2023-08-28", 0.001, 0.0005)
TRANSFER_FEE = ("2022-04-29", 0.00002, 0.00001)
COMMISSION_MIN = 5.0


def fees(amount: Column, sell: Column, day: Column, commission: float = 0.00025) -> Column:
    """Commission with its minimum, transfer fee, and stamp tax on sales."""
    rate = lambda r: F.when(day < F.lit(r[0]).cast("date"), r[1]).otherwise(r[2])
    return F.greatest(amount * commission, F.lit(COMMISSION_MIN)) + amount * rate(TRANSFER_FEE) + F.when(sell, amount * rate(STAMP_TAX)).otherwise(0.0)


def round_lot(quantity: Column, least: Column, step: Column) -> Column:
    """The largest tradable quantity not above: zero below the least, else the least and whole steps."""
    return F.when(quantity < least, F.lit(0)).otherwise(least + F.floor((quantity - least) / step) * step).cast("long")


def split_orders(df: DataFrame, quantity: str, most: int) -> DataFrame:
    """A row for each order of at most `most`, with part (from 0) and the part's quantity; nothing to trade gives no row."""
    parts = F.sequence(F.lit(0), F.ceil(F.col(quantity) / most).cast("int") - 1)
    return df.where(F.col(quantity) > 0).withColumn("part", F.explode(parts)).withColumn(quantity, F.least(F.lit(most).cast("long"), F.col(quantity) - F.col("part") * most))


def equity_path(df: DataFrame, day: str, equity: str, initial: float, run: str | list[str] | None = None) -> DataFrame:
    """The path of each run (or of one) with ret (over the day before, the first over initial), peak and drawdown. A run has a row
    a session, so its window is bounded by the calendar."""
    order = (Window.partitionBy(run) if run else Window.partitionBy()).orderBy(day)
    peak = F.greatest(F.max(equity).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(initial))
    return df.withColumns({"ret": F.col(equity) / F.lag(equity, 1, initial).over(order) - 1, "peak": peak, "drawdown": F.col(equity) / peak - 1})


def metrics(path: DataFrame, equity: str, day: str, initial: float, sessions: int = 252, run: str | None = None, n: Column | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """One row (for each run): n, first_session, last_session, final_equity, total_return, annual_return (null if nothing is
    left), volatility and sharpe (null below two returns, sharpe without any spread), max_drawdown. n counts the sessions if not
    every row is one; more: other aggregates of the same rows, as further columns."""
    total = F.max_by(equity, day)
    one = path.groupBy(*([run] if run else [])).agg((F.count("*") if n is None else n).alias("n"), F.min(day).alias("first_session"), F.max(day).alias("last_session"), total.alias("final_equity"), (total / initial - 1).alias("total_return"), F.stddev_samp("ret").alias("sd"), F.avg("ret").alias("mean"), F.min("drawdown").alias("max_drawdown"), F.avg(equity).alias("_mean"), *more)
    annual = F.when(F.col("final_equity") > 0, F.pow(1 + F.col("total_return"), F.lit(float(sessions)) / F.col("n")) - 1)
    others = one.columns[-len(more) :] if more else []
    return one.select(*([run] if run else []), "n", "first_session", "last_session", "final_equity", "total_return", annual.alias("annual_return"), (F.col("sd") * sessions**0.5).alias("volatility"), (F.try_divide(F.col("mean"), F.col("sd")) * sessions**0.5).alias("sharpe"), "max_drawdown", "_mean", *others)


def run_metrics(rows: DataFrame, initial: float, sessions: int = 252) -> DataFrame:
    """Metrics of each run of a backtest's rows: those of its path, turnover over its mean equity, and what became of orders.
    Rows are read once, as a backtest walks its runs each time; those that are no sessions have neither day nor equity here."""
    rows = rows.select("run", "kind", *[F.when(F.col("kind") == "equity", F.col(c)).alias(c) for c in ("day", "equity")], "notional", "fee", "slippage")
    kinds = {"orders": "submitted", "fills": "fill", "blocked": "blocked", "canceled": "canceled", "expired": "expired"}
    trades = [*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()], *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in (("notional", "notional"), ("fees", "fee"), ("slippage", "slippage"))]]
    path = equity_path(rows, "day", "equity", initial, ["run", "kind"])
    both = metrics(path, "equity", "day", initial, sessions, "run", F.count_if(F.col("kind") == "equity"), tuple(trades)).where("n > 0")
    mean = (F.col("_mean") * F.col("n") + initial) / (F.col("n") + 1)
    return both.withColumn("turnover", F.try_divide(F.col("notional"), mean)).withColumn("max_drawdown", F.abs("max_drawdown")).drop("_mean")
