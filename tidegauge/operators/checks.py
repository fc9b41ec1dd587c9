"""Data-quality rules as DataFrames of issues, and tolerant comparison of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.values import is_close, is_finite
from tidegauge.operators.rules import samples


def issues(df: DataFrame, rule: str, broken: Column, keys: list[str], severity: str = "ERROR") -> DataFrame:
    """(rule, severity, key, sample) of rows that break a rule; a condition that is null is no breach."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return df.where(broken).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.alias("key"))


def duplicate_keys(df: DataFrame, keys: list[str], rule: str = "duplicate_key_v1") -> DataFrame:
    return issues(df.groupBy(*keys).count().where("count > 1"), rule, F.lit(True), keys)


def required(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    return issues(df, "required_value_v1", F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False)), keys)


def finite(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & ~is_finite(F.col(c)))
    return issues(df, "finite_float_v1", bad, keys)


def ohlc(df: DataFrame, keys: list[str]) -> DataFrame:
    """High is the largest and low the smallest price of a bar."""
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    return issues(df, "daily_ohlc_v1", bad, keys)


def arithmetic(df: DataFrame, close: str, pre_close: str, change: str, keys: list[str]) -> DataFrame:
    """Close is the previous close and the change, to half a cent and a little."""
    bad = (F.col(pre_close) > 0) & (F.abs(F.col(close) - F.round(F.col(pre_close) + F.col(change), 2)) > 0.0051)
    return issues(df, "daily_arithmetic_v1", bad, keys)


def uncovered(df: DataFrame, other: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys of df that other lacks."""
    return issues(df.select(*keys).distinct().join(other.select(*keys).distinct(), keys, "left_anti"), rule, F.lit(True), keys)


def summary(found: DataFrame) -> DataFrame:
    """(rule, severity, issues, sample): counts, and the ten smallest different keys of each rule, comma-joined."""
    out = samples(found, ["rule", "severity"], "key")
    return out.select("rule", "severity", F.col("count").alias("issues"), F.array_join("samples", ",").alias("sample"))


def outcome(found: DataFrame) -> str:
    severities = {r[0] for r in found.select("severity").distinct().collect()}
    return "FAIL" if "ERROR" in severities else "WARN" if severities else "PASS"


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], pairs: list[tuple[str, str]], rtol: float, atol: float, zero_null: bool = False) -> DataFrame:
    """(keys, field, left_value, right_value, verdict) of every pair that either side has; verdicts are equal, differs,
    left_missing and right_missing, and pairs null on both sides are left out. zero_null: null counts as 0."""
    left = a.select(*keys, *[F.col(x).alias(f"_a{i}") for i, (x, _) in enumerate(pairs)])
    right = b.select(*keys, *[F.col(y).alias(f"_b{i}") for i, (_, y) in enumerate(pairs)])
    both = left.join(right, keys, "full_outer")
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(f"_a{i}").cast("double").alias("l"), F.col(f"_b{i}").cast("double").alias("r")) for i, (x, _) in enumerate(pairs)])).alias("x")
    out = both.select(*keys, rows).select(*keys, "x.*")
    if zero_null:
        out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("l", "r")})
    verdict = F.when(F.col("l").isNull(), "left_missing").when(F.col("r").isNull(), "right_missing").when(is_close(F.col("l"), F.col("r"), rtol, atol), "equal").otherwise("differs")
    return out.where("l is not null or r is not null").select(*keys, "field", F.col("l").alias("left_value"), F.col("r").alias("right_value"), verdict.alias("verdict"))


def nearest(target: Column, choices: list[Column]) -> Column:
    """Of several columns, the value nearest to the target; the first of equals, and null if all are."""
    distance = [F.when(c.isNotNull(), F.abs(c - target)) for c in choices]
    best = F.least(*distance) if len(distance) > 1 else distance[0]
    return F.coalesce(*[F.when(d == best, c) for d, c in zip(distance, choices, strict=True)])
