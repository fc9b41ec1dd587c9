"""Detection: the rules of rules.py over the tables of a catalog or a store, as one report."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.errors import RequestError
from tidegauge.operators import rules
from tidegauge.scratch import cut
from tidegauge.sources.store import Store

CHECK = "dataset string, rule string, status string, issues long"


@dataclass(frozen=True)
class Report:
    """issues is a written table (rules.SCHEMA and issue_id), checks has a row for each rule of each table."""

    issues: DataFrame
    checks: tuple[tuple[str, str, str, int], ...]
    row_counts: Mapping[str, int]
    through: str
    start: str | None
    snapshot_id: str | None

    @property
    def passed(self) -> bool:
        """No rule has an error; warnings do not stand in the way."""
        return not any(status == "FAIL" for _, _, status, _ in self.checks)

    def checks_df(self) -> DataFrame:
        return self.issues.sparkSession.createDataFrame(list(self.checks), CHECK)

    def status(self) -> dict:
        """What Catalog.with_status reads: the tables with errors, of a full check."""
        return {"snapshot_id": self.snapshot_id, "through": self.through, "failed": sorted({d for d, _, s, _ in self.checks if s == "FAIL"})}

    def lines(self) -> DataFrame:
        """(line): JSON records of kind report, check and issue."""
        spark = self.issues.sparkSession
        head = [json.dumps({"kind": "report", "version": 3, "through": self.through, "start": self.start, "snapshot_id": self.snapshot_id, "row_counts": dict(self.row_counts)}, ensure_ascii=False)]
        head += [json.dumps({"kind": "check", "dataset": d, "rule": r, "status": s, "issues": n}, ensure_ascii=False) for d, r, s, n in self.checks]
        each = self.issues.select(F.to_json(F.struct(F.lit("issue").alias("kind"), *self.issues.columns), {"ignoreNullFields": "false"}).alias("line"))
        return spark.createDataFrame([(x,) for x in head], "line string").coalesce(1).unionByName(each)

    def write(self, path: str) -> None:
        """The report as text files of JSON lines."""
        self.lines().write.text(path)


def read_report(spark: SparkSession, path: str) -> Report:
    """A report that write() left; RequestError if the files are none."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.get_json_object("value", "$.kind").alias("kind"))
    heads = [json.loads(r["line"]) for r in rows.where("kind = 'report'").collect()]
    if len(heads) != 1 or heads[0].get("version") != 3:
        raise RequestError(f"no report in {path}")
    checks = tuple((c["dataset"], c["rule"], c["status"], c["issues"]) for c in (json.loads(r["line"]) for r in rows.where("kind = 'check'").collect()))
    issues = rows.where("kind = 'issue'").select(F.from_json("line", rules.SCHEMA + ", issue_id string").alias("i")).select("i.*")
    return Report(issues, checks, heads[0]["row_counts"], heads[0]["through"], heads[0]["start"], heads[0]["snapshot_id"])


def _within(df: DataFrame, column: str, through: str, start: str | None) -> DataFrame:
    """Rows of partitions in the range, and those without a partition."""
    day = F.col(column)
    good = day <= F.lit(through).cast("date")
    good = good if start is None else good & (day >= F.lit(start).cast("date"))
    return df.where(day.isNull() | good)


def detect(frames: Mapping[str, DataFrame], through: str, start: str | None = None, datasets: Iterable[str] | None = None, store: Store | None = None, snapshot_id: str | None = None) -> Report:
    """Check tables (all of frames that have rules, or those named) up to the day `through`, from `start` on if given.

    An empty table without other issues is an issue of a check without start. Rules between tables run when both are chosen;
    the calendar serves the dense tables whether it is chosen or not. A store adds the checks of its files. Issues are written
    once to the shared folder; counts come from there.
    """
    chosen = [d for d in rules.DATASETS if d in frames] if datasets is None else list(dict.fromkeys(datasets))
    unknown = [d for d in chosen if d not in rules.DATASETS or d not in frames]
    if not chosen or unknown or (start is not None and start > through):
        raise RequestError(f"nothing to check, unknown tables {unknown}, or a range that ends before it starts")
    spark = next(iter(frames.values())).sparkSession
    found, counts = [], {}
    for d in chosen:
        df = _within(frames[d], rules.spec(d).partition, through, start)
        counts[d] = df.count()
        found.append(rules.table_issues(df, d))
        if store is not None and d in store.tables:
            found.append(file_issues(store, d))
        if d == "trade_cal":
            found += [rules.calendar_exchanges(df), rules.calendar_days(frames[d], through, start), rules.calendar_pretrade(frames[d], through, start)]
        if d in rules.DENSE and "trade_cal" in frames:
            found.append(rules.market_days(frames[d], frames["trade_cal"], d, through, start))
    if {"daily", "adj_factor"} <= set(chosen):
        found.append(rules.factor_coverage(*(_within(frames[d], "trade_date", through, start) for d in ("daily", "adj_factor"))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    issues = cut(rules.issue_id(out), "issues")
    per = {(r["dataset"], r["rule"]): (r["n"], r["errors"]) for r in issues.groupBy("dataset", "rule").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "ERROR").alias("errors")).collect()}  # tables x rules
    with_issues = {d for d, _ in per}
    empty = [d for d in chosen if start is None and counts[d] == 0 and d not in with_issues]
    if empty:
        rows = [(d, None, json.dumps({"dataset": d}), "dataset_empty_v1", "ERROR", "MANUAL", '{"row_count":0}', None, None) for d in empty]
        issues = issues.unionByName(rules.issue_id(spark.createDataFrame(rows, rules.SCHEMA)))
        per |= {(d, "dataset_empty_v1"): (1, 1) for d in empty}
    checks = []
    for d in chosen:
        names = [r for r in rules.COMMON if start is None or r != "dataset_empty_v1"]
        names += list(rules.DENSE_CHECKS) if d in rules.DENSE else []
        for r in [*names, *rules.spec(d).checks]:
            n, errors = per.get((d, r), (0, 0))
            checks.append((d, r, "FAIL" if errors else "WARN" if n else "PASS", n))
    return Report(issues, tuple(checks), counts, through, start, snapshot_id)


def file_issues(store: Store, name: str) -> DataFrame:
    """Issues of a table's files: manifests that cannot be read, files that they name and that are missing, cannot be read or
    have another schema, and rows under another partition's path. Footers are read by the executors."""
    spark, table, made = store.spark, store.tables[name], []
    issue = lambda partition, rule, observed: (name, partition, json.dumps({"partition": partition}), rule, "ERROR", "MANUAL", json.dumps(observed), None, None)
    files, good = [], []
    for folder in store.folders(name):
        try:
            manifest = store.manifest(folder)
        except ValueError as e:
            made.append(issue(folder, "manifest_v1", {"error": str(e)[:200]}))
            continue
        good.append(folder)
        for f in manifest["files"]:
            if store.exists(f"{folder}/{f}"):
                files.append((folder, f"{store.root.rstrip('/')}/{folder}/{f}"))
            else:
                made.append(issue(folder, "manifest_file_missing_v1", {"file": f}))
    out = spark.createDataFrame(made, rules.SCHEMA)
    if not files:
        return out
    want = [(f.name, f.dataType.simpleString()) for f in table.schema]

    def footers(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import from_arrow_schema

        for batch in batches:
            rows = []
            for folder, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    files_, inner = fs.FileSystem.from_uri(path.replace("%", "%25")) if ":/" in path else (fs.LocalFileSystem(), path)
                    with files_.open_input_file(inner) as stream:
                        got = [(f.name, f.dataType.simpleString()) for f in from_arrow_schema(pq.read_schema(stream))]
                except Exception as e:  # any failure is what the rule reports
                    rows.append(issue(folder, "parquet_read_v1", {"file": path, "error": str(e)[:200]}))
                    continue
                if [(n, t.replace("timestamp_ntz", "timestamp")) for n, t in got] != [(n, t.replace("timestamp_ntz", "timestamp")) for n, t in want]:
                    rows.append(issue(folder, "schema_v1", {"file": path, "schema": [f"{n} {t}" for n, t in got]}))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.date32() if k == 8 else pa.string()) for k in range(9)], names)

    names = ["dataset", "partition", "key", "rule", "severity", "fix", "observed", "suggested", "day"]
    listed = spark.createDataFrame(files, "folder string, path string")
    return out.unionByName(listed.mapInArrow(footers, rules.SCHEMA)).unionByName(misplaced(store, name, good))


def misplaced(store: Store, name: str, folders: list[str] | None = None) -> DataFrame:
    """partition_value_v1: an issue for each partition that has rows whose partition values are null or not those of its path."""
    spark, table = store.spark, store.tables[name]
    files = [f for f, good in store.active_files(name, folders) if good]
    if not files:
        return spark.createDataFrame([], rules.SCHEMA)
    rows = spark.read.schema(table.schema).parquet(*files).select(*table.partition_by, F.url_decode(F.regexp_extract("_metadata.file_path", f"/({name}(?:/[^/=]+=[^/]*){{{len(table.partition_by)}}})/", 1)).alias("_folder"))
    path = rows
    for c in table.partition_by:
        path = path.withColumn(f"_p_{c}", F.regexp_replace(F.url_decode(F.regexp_extract("_folder", f"(?:^|/){c}=([^/]*)", 1)), "^value:", ""))
    wrong = F.lit(False)
    for c in table.partition_by:
        wrong = wrong | F.col(c).isNull() | (F.col(c).cast("string") != F.col(f"_p_{c}"))
    per = path.where(wrong).groupBy("_folder").agg(F.count("*").alias("rows"))
    day = F.lit(None).cast("date")
    made = rules._issue(name, F.col("_folder"), rules._json(F.col("_folder").alias("partition")), "partition_value_v1", "ERROR", "MANUAL", rules._json(F.col("rows")), F.lit(None).cast("string"), day)
    return per.select(made.alias("i")).select("i.*")
