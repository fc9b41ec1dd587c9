"""Filters, de-duplication and date ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.errors import RequestError


def predicate(filters: list) -> Column:
    """A Column of a list of (column, op, value), all of which hold, or of a list of such lists, one of which holds."""
    if not filters:
        raise RequestError("an empty filter")
    groups = filters if isinstance(filters[0], list) else [filters]
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (_condition(*x) for x in g)) for g in groups))


def _condition(name: str, op: str, value) -> Column:
    c = F.col(name)
    if value is None and op in ("=", "==", "!="):
        return c.isNotNull() if op == "!=" else c.isNull()
    simple = {"=": c.__eq__, "==": c.__eq__, "!=": c.__ne__, "<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__}
    if op in simple:
        return simple[op](value)
    if op in ("in", "not in"):
        return c.isin(list(value)) if op == "in" else ~c.isin(list(value))
    raise RequestError(f"unknown operator {op!r}")


def last_wins(df: DataFrame, keys: list[str], prefer: list[str], position: list[str]) -> DataFrame:
    """One row a key (null keys are equal): the largest preference, nulls smallest, then the last position."""
    order = [F.col(c).desc_nulls_last() for c in [*prefer, *position]]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge_ranges(df: DataFrame, keys: list[str], start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Closed date ranges of each key, those that touch or overlap made one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col(start) > F.date_add(before, 1)), 1).otherwise(0))
    grouped = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def missing_ranges(df: DataFrame, keys: list[str], first: str, last: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """What the merged ranges of each key leave of [first, last]."""
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    merged = merge_ranges(df, keys, start, end).where((F.col(end) >= lo) & (F.col(start) <= hi))
    order = Window.partitionBy(*keys).orderBy(start)
    before = merged.select(*keys, F.coalesce(F.date_add(F.lag(end).over(order), 1), lo).alias("a"), F.date_sub(start, 1).alias("b"))
    after = merged.groupBy(*keys).agg(F.max(end).alias("e")).select(*keys, F.date_add("e", 1).alias("a"), hi.alias("b"))
    none = df.select(*keys).distinct().join(merged.select(*keys), keys, "left_anti").select(*keys, lo.alias("a"), hi.alias("b"))
    gaps = before.unionByName(after).unionByName(none)
    return gaps.where("a <= b").select(*keys, F.col("a").alias(start), F.col("b").alias(end))
