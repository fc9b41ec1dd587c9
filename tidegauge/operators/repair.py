"""Repair of a store's rows from the issues that checks found: patches under a guard, ranges to fetch again, rollback."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.errors import DataError, RequestError
from tidegauge.operators.tables import merge_ranges
from tidegauge.sources.store import Store

# Rules that a human decides; every other known rule is fetched again, and finite_float_v1 is patched.
MANUAL = ("manifest_v1", "parquet_read_v1", "schema_v1", "duplicate_key_v1", "partition_value_v1")
PATCH = ("finite_float_v1",)


def actions(issues: DataFrame) -> DataFrame:
    """issues with action: PATCH, MANUAL or REFETCH. Issues that say themselves how they are fixed (rules.SCHEMA) are patched if
    they suggest a patch, fetched again if they know the day, and otherwise left to a human."""
    if {"fix", "day"} <= set(issues.columns):
        by_hand = F.col("rule").isin(*MANUAL) | F.col("day").isNull()
        return issues.withColumn("action", F.when(F.col("fix") == "AUTO_FIX", "PATCH").when(by_hand, "MANUAL").otherwise("REFETCH"))
    return issues.withColumn("action", F.when(F.col("rule").isin(*PATCH), "PATCH").when(F.col("rule").isin(*MANUAL), "MANUAL").otherwise("REFETCH"))


def refetch_ranges(issues: DataFrame) -> DataFrame:
    """(dataset, start_date, end_date): the days of issues to fetch again (columns dataset, rule, day), joined into ranges."""
    days = actions(issues).where("action = 'REFETCH' and day is not null").select("dataset", F.col("day").alias("start_date"), F.col("day").alias("end_date")).distinct()
    return merge_ranges(days, ["dataset"])


def apply_fixes(store: Store, issues: DataFrame, decisions: DataFrame | None = None) -> list[tuple[str, str]]:
    """Patch a store as issues suggest (rules.SCHEMA, issue_id): new values, nulls and deletions; (table, repair's id) of each table.

    decisions: (issue_id, expected, values) that a human made, JSON objects, which go before the issue's own suggestion. A patch
    holds only if the row still has what the issue observed, or the decision expects; else nothing of its table changes. Rules
    of one row are applied together.
    """
    todo = actions(issues)
    if decisions is None:
        chosen = todo.where("action = 'PATCH'").select("dataset", "key", F.col("observed").alias("expected"), "suggested")
    else:
        own = decisions.select("issue_id", F.col("expected").alias("_e"), F.concat(F.lit('{"values":'), F.col("values"), F.lit("}")).alias("_s"))
        marked = todo.join(own, "issue_id", "left").where("action = 'PATCH' or _s is not null")
        chosen = marked.select("dataset", "key", F.coalesce("_e", "observed").alias("expected"), F.coalesce("_s", "suggested").alias("suggested"))
    out = []
    for name in sorted(r[0] for r in chosen.select("dataset").distinct().collect()):
        table = store._table(name)
        keys = list(dict.fromkeys([*table.partition_by, *table.primary_key]))
        kind = lambda columns: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name in columns)  # noqa: E731, B023
        texts = "map<string,string>"
        parsed = chosen.where(F.col("dataset") == name).select(F.from_json("key", kind(keys)).alias("k"), F.from_json("expected", texts).alias("e"), F.from_json(F.get_json_object("suggested", "$.values"), texts).alias("v"), F.coalesce(F.get_json_object("suggested", "$.delete") == "true", F.lit(False)).alias("d"))
        merged = parsed.groupBy("k").agg(F.bool_or("d").alias("_delete"), F.map_from_entries(F.flatten(F.collect_list(F.map_entries("v")))).alias("v"), F.expr("first(e)").alias("e"))
        folders = [tuple(r) for r in merged.select(*[F.col(f"k.{c}") for c in table.partition_by]).distinct().collect()]
        rows = store.read(name, folders)
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"k.{c}")) for c in keys))
        plain = [c for c in table.schema.names if c not in keys]
        text = lambda c: F.get_json_object(F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}), f"$.{c}")
        holds = reduce(lambda a, b: a & b, (~F.map_contains_key("e", F.lit(c)) | text(c).eqNullSafe(F.element_at("e", c)) for c in plain), F.lit(True))
        met = merged.join(rows.withColumn("_row", F.lit(True)), same, "left").groupBy("k").agg(F.count_if(F.coalesce(F.col("_row") & holds, F.lit(False))).alias("good"), F.count("*").alias("n"))
        if not met.where("good <> 1 or n <> 1").isEmpty():
            raise DataError(f"{name}: a patch does not meet exactly one row as it was found")
        joined = rows.join(merged, same, "left").where(~F.coalesce("_delete", F.lit(False)))
        value = lambda c: F.when(F.coalesce(F.map_contains_key("v", F.lit(c)), F.lit(False)), F.element_at("v", c).cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c)  # noqa: E731, B023
        out.append((name, _swap(store, name, folders, rows, joined.select(*[value(c) for c in table.schema.names]))))
    return out


def _swap(store: Store, name: str, partitions: list[tuple], rows: DataFrame, fixed: DataFrame) -> str:
    """Replace partitions by their fixed rows under a journal; the repair's id."""
    table, repair, folders = store._table(name), uuid.uuid4().hex, store.select(name, partitions)
    seen = {f: store.manifest(f) for f in folders}
    rows.write.parquet(f"{store.root.rstrip('/')}/_repairs/{repair}/before")
    made = store._write(table, fixed)
    journal = {"id": repair, "status": "PREPARED", "table": name, "files": {f: made.get(f, []) for f in folders}}
    _write_journal(store, journal)
    for f in folders:
        store._commit(f, seen[f], made.get(f, []))
    _write_journal(store, journal | {"status": "COMMITTED"})
    return repair


def _file(store: Store, repair: str):
    return store._path(f"_repairs/{repair}/journal.json")


def _write_journal(store: Store, journal: dict) -> None:
    stream = store._fs().create(_file(store, journal["id"]), True)
    stream.write(bytearray(json.dumps(journal).encode()))
    stream.close()


def read_journal(store: Store, repair: str) -> dict:
    if not repair or "/" in repair or repair in (".", ".."):
        raise RequestError("a repair's id is one path segment")
    stream = store._fs().open(_file(store, repair))
    try:
        return json.loads(store.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def patch(store: Store, name: str, partitions: list[tuple], patches: DataFrame, expected: Mapping[str, str] | None = None) -> str:
    """Apply patches to some partitions and return the repair's id.

    patches: the partition columns, the primary key, `_delete` (boolean), new values under the names of table columns (null:
    keep), and the values expected before under the names that `expected` maps table columns to. Each patch must meet exactly
    one row, whose expected values still hold, or nothing is changed. The rows before are kept for rollback.
    """
    table = store._table(name)
    keys = list(dict.fromkeys([*table.partition_by, *table.primary_key]))
    values = [c for c in patches.columns if c in table.schema.names and c not in keys]
    unknown = set(patches.columns) - set(table.schema.names) - {"_delete"} - set((expected or {}).values())
    if unknown or not table.primary_key:
        raise RequestError(f"{name}: unknown columns {sorted(unknown)}, or no primary key")
    if not patches.groupBy(*keys).count().where("count > 1").isEmpty():
        raise DataError(f"{name}: two patches of one row")
    rows = store.read(name, partitions)
    renamed = patches.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_v_{c}") for c in values], F.col("_delete"), *[F.col(e).alias(f"_e_{c}") for c, e in (expected or {}).items()], F.lit(True).alias("_hit"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    holds = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in (expected or {})), F.lit(True))
    met = renamed.join(rows.withColumn("_row", F.lit(True)), same, "left").withColumn("_good", F.col("_row").isNotNull() & holds)
    if not met.groupBy(*[f"_k_{k}" for k in keys]).agg(F.count_if("_good").alias("good"), F.count("*").alias("n")).where("good <> 1 or n <> 1").isEmpty():
        raise DataError(f"{name}: a patch does not meet exactly one row with the expected values")
    joined = rows.join(renamed, same, "left")
    fixed = joined.where(~F.coalesce("_delete", F.lit(False))).select(*[F.coalesce(f"_v_{c}", c).alias(c) if c in values else F.col(c) for c in table.schema.names])
    return _swap(store, name, partitions, rows, fixed)


def rollback(store: Store, repair: str) -> None:
    """Undo a committed repair; DataError if its partitions changed since. One that stopped half-way (PREPARED) is undone for
    the partitions that it had replaced."""
    journal = read_journal(store, repair)
    if journal["status"] not in ("COMMITTED", "PREPARED"):
        raise RequestError(f"repair {repair} is {journal['status']}")
    table = store._table(journal["table"])
    now = {f: store.manifest(f) for f in journal["files"]}
    done = [f for f, files in journal["files"].items() if now[f]["files"] == files]
    if journal["status"] == "COMMITTED" and len(done) < len(now):
        raise DataError(f"repair {repair}: rows changed since")
    before = store.spark.read.schema(table.schema).parquet(f"{store.root.rstrip('/')}/_repairs/{repair}/before")
    folder = F.concat_ws("/", F.lit(table.name), *[F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("value:"), F.col(c).cast("string")), F.lit("null"))) for c in table.partition_by])
    store.replace_all(journal["table"], done, before.where(folder.isin([unquote(f) for f in done])), {f: now[f] for f in done})
    _write_journal(store, journal | {"status": "ROLLED_BACK"})
