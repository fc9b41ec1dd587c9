"""A partitioned table of immutable Parquet files; versioned manifests in each partition are its commit points."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegauge.errors import DataError, RequestError, UnavailableError
from tidegauge.operators.tables import last_wins, predicate

#: Seconds for which files that a newer version dropped are kept for readers of older ones.
GRACE = 3600.0
#: File-system calls of the driver at once, and how often an append tries again when another writer was first.
CALLS, TRIES = 16, 20
#: Bytes of data that a task of a compaction writes, about.
FILE_BYTES = 128 << 20
#: Manifests that stay however old they are.
KEPT = 16
PARTITION_TYPES = ("string", "date", "tinyint", "smallint", "int", "bigint")


class Conflict(DataError):
    """Another writer has changed a partition since it was read."""


@dataclass(frozen=True)
class TableConfig:
    """Name, schema and layout of a table. The primary key holds within a partition; among equal keys the largest prefer_by
    wins, then the row committed last."""

    name: str
    schema: StructType
    partition_by: tuple[str, ...]
    sort_by: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    prefer_by: tuple[str, ...] = ()
    rows_per_file: int = 1_000_000

    def __post_init__(self):
        kinds = {f.name: f.dataType.simpleString() for f in self.schema}
        if not self.partition_by or not {*self.partition_by, *self.sort_by, *self.primary_key, *self.prefer_by} <= set(kinds):
            raise RequestError(f"{self.name}: partitions and keys must be columns")
        if any(kinds[c] not in PARTITION_TYPES for c in self.partition_by) or self.rows_per_file < 1:
            raise RequestError(f"{self.name}: partitions are strings, dates or integers, and files have rows")

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "schema": json.loads(self.schema.json()), "rows_per_file": self.rows_per_file, **{k: list(getattr(self, k)) for k in ("partition_by", "sort_by", "primary_key", "prefer_by")}})

    @classmethod
    def from_json(cls, text: str) -> TableConfig:
        d = json.loads(text)
        return cls(d["name"], StructType.fromJson(d["schema"]), *(tuple(d[k]) for k in ("partition_by", "sort_by", "primary_key", "prefer_by")), d["rows_per_file"])


@dataclass
class Store:
    """Tables under a root. Each partition is a folder with its files and its manifests; version n is `_manifest.<n>.json`, made
    by a rename that fails if it exists, so of two writers one commits and the other tries again (append) or gets Conflict."""

    spark: SparkSession
    root: str
    tables: dict[str, TableConfig] = field(default_factory=dict)
    grace: float = GRACE

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> Store:
        """A store by the table descriptions that its writers left in it."""
        store = cls(spark, root, **options)
        fs = store._fs()
        for s in fs.globStatus(store._path("*/_table.json")) or []:
            table = TableConfig.from_json(store._text(s.getPath()))
            store.tables[table.name] = table
        return store

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, path) -> str:
        stream = self._fs().open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def _put(self, name: str, text: str) -> bool:
        """Write a file whole, unless there is one: False then."""
        fs, jvm = self._fs(), self.spark._jvm
        aside, final = self._path(f"{name}.{uuid.uuid4().hex}.tmp"), self._path(name)
        stream = fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, none)
        except Exception:
            fs.delete(aside, False)
            if not fs.exists(final):
                raise
            return False
        return True

    # partitions

    def _table(self, name: str) -> TableConfig:
        if name not in self.tables:
            raise RequestError(f"no table {name}")
        return self.tables[name]

    @staticmethod
    def _folder(table: TableConfig, values: Iterable) -> str:
        """null has a mark of its own, so that it differs from any string."""
        parts = ("null" if v is None else f"value:{v}" for v in values)
        return "/".join([table.name, *(f"{c}={quote(p, safe='')}" for c, p in zip(table.partition_by, parts, strict=True))])

    @staticmethod
    def values_of(table: TableConfig, folder: str) -> tuple:
        """The partition values that a folder's name stands for."""
        out = []
        for c, part in zip(table.partition_by, folder.split("/")[1:], strict=True):
            text, kind = unquote(part.split("=", 1)[1]), table.schema[c].dataType.simpleString()
            raw = None if text == "null" else text.removeprefix("value:")
            out.append(raw if raw is None or kind == "string" else date.fromisoformat(raw) if kind == "date" else int(raw))
        return tuple(out)

    def folders(self, name: str) -> list[str]:
        """The folders of all partitions of a table that have a manifest."""
        table = self._table(name)
        found = self._fs().globStatus(self._path("/".join([table.name, *["*=*"] * len(table.partition_by), "_manifest*.json"]))) or []
        depth = len(table.partition_by) + 2
        return sorted({"/".join(s.getPath().toString().split("/")[-depth:-1]) for s in found})

    def select(self, name: str, partitions) -> list[str]:
        """The folders of a selector: None for all, a mapping or tuple of all partition values, a single value of a table with
        one partition column, or a list of these."""
        table = self._table(name)
        if partitions is None:
            return self.folders(name)
        each = partitions if isinstance(partitions, list) else [partitions]
        out = []
        for p in each:
            if isinstance(p, Mapping):
                if set(p) != set(table.partition_by):
                    raise RequestError(f"{name}: a partition is named by {table.partition_by}")
                values = tuple(p[c] for c in table.partition_by)
            else:
                values = p if isinstance(p, tuple) else (p,)
            if len(values) != len(table.partition_by):
                raise RequestError(f"{name}: a partition has {len(table.partition_by)} values")
            kinds = [table.schema[c].dataType.simpleString() for c in table.partition_by]
            out.append(self._folder(table, [v.isoformat() if isinstance(v, date) and k == "date" else v for v, k in zip(values, kinds, strict=True)]))
        return out

    # manifests

    def _versions(self, folder: str) -> list[tuple[int, str]]:
        fs, path = self._fs(), self._path(folder)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        numbered = [(int(n[10:-5]), n) for n in names if n.startswith("_manifest.") and n.endswith(".json") and n[10:-5].isdigit()]
        return sorted(numbered) or ([(0, "_manifest.json")] if "_manifest.json" in names else [])

    def manifest(self, folder: str) -> dict:
        """The current manifest of a partition's folder. One without commit times, of an older layout, has its files' order
        instead; ValueError if it is malformed."""
        versions = self._versions(folder)
        if not versions:
            return {"version": 0, "files": [], "file_committed_at": {}, "compacted": None, "dropped": {}}
        found = json.loads(self._text(self._path(f"{folder}/{versions[-1][1]}")))
        files = found.get("files") if isinstance(found, dict) else None
        if not isinstance(files, list) or not all(isinstance(f, str) and f and not f.startswith("/") and ".." not in f.split("/") for f in files) or len(set(files)) < len(files):
            raise ValueError(f"{folder}: a malformed manifest")
        at = found.get("file_committed_at") or {f: k for k, f in enumerate(files)}
        return {"version": versions[-1][0], "files": files, "file_committed_at": at, "compacted": found.get("compacted"), "dropped": found.get("dropped") or {}}

    def _commit(self, folder: str, before: dict, files: list[str], compacted: bool = False) -> None:
        """Make files the version after `before`; Conflict if there is one. Files that no version of the last `grace` seconds
        names are removed."""
        now = max([time.time_ns() // 1000, *(t + 1 for t in before["file_committed_at"].values())])
        dropped = {f: t for f, t in before["dropped"].items() if f not in files} | {f: now for f in before["files"] if f not in files}
        old = [f for f, t in dropped.items() if t <= now - self.grace * 1e6]
        made = {"version": before["version"] + 1, "files": files, "file_committed_at": {f: before["file_committed_at"].get(f, now) for f in files}, "compacted": sorted(files) if compacted else None, "dropped": {f: t for f, t in dropped.items() if f not in old}}
        if not self._put(f"{folder}/_manifest.{made['version']}.json", json.dumps(made)):
            raise Conflict(f"{folder}: version {made['version']} is taken")
        fs, versions = self._fs(), self._versions(folder)
        if before["version"] and all(v != before["version"] for v, _ in versions):  # so long ago that its manifest is gone
            fs.delete(self._path(f"{folder}/_manifest.{made['version']}.json"), False)
            raise Conflict(f"{folder}: version {made['version']} is past")
        for f in old:
            fs.delete(self._path(f"{folder}/{f}"), False)
        for _, n in versions[:-KEPT]:
            path = self._path(f"{folder}/{n}")
            if fs.getFileStatus(path).getModificationTime() < (time.time() - self.grace) * 1000:
                fs.delete(path, False)

    # writing

    def _conform(self, table: TableConfig, df: DataFrame) -> DataFrame:
        """Rows in the table's columns and types; other names are a DataError, values that do not fit their type fail the job."""
        if sorted(df.columns) != sorted(table.schema.names):
            raise DataError(f"{table.name}: rows have other columns")
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema])

    def _describe(self, table: TableConfig) -> None:
        if not self.exists(f"{table.name}/_table.json"):
            self._put(f"{table.name}/_table.json", table.to_json())

    def _write(self, table: TableConfig, df: DataFrame, sorted_by_key: bool = False) -> dict[str, list[str]]:
        """Write df once, a folder for each partition, and move the files to the partitions' folders: {folder: names}."""
        self._describe(table)
        staging, fs = f"{table.name}/.staging-{uuid.uuid4().hex}", self._fs()
        mark = F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in table.partition_by]))
        rows = df.withColumn("_part", mark)
        if table.sort_by or sorted_by_key:
            rows = rows.sortWithinPartitions("_part", *(table.sort_by or table.primary_key))
        rows.write.option("maxRecordsPerFile", table.rows_per_file).partitionBy("_part").parquet(f"{self.root.rstrip('/')}/{staging}")
        out: dict[str, list[str]] = {}
        moves = []
        for s in fs.globStatus(self._path(f"{staging}/_part=*/*.parquet")) or []:
            values = [None if x == "" else x[1:] for x in json.loads(unquote(s.getPath().getParent().getName().removeprefix("_part=")))]
            folder, name = self._folder(table, values), f"part-{uuid.uuid4().hex}.parquet"
            if folder not in out:
                fs.mkdirs(self._path(folder))
            out.setdefault(folder, []).append(name)
            moves.append((s.getPath(), self._path(f"{folder}/{name}")))

        def move(pair) -> None:
            if not fs.rename(*pair):
                raise UnavailableError(f"could not move {pair[0]}")

        with ThreadPoolExecutor(CALLS) as pool:
            list(pool.map(move, moves))
        fs.delete(self._path(staging), True)
        return out

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows in one pass over df, one commit for each partition that has some."""
        table = self._table(name)
        for folder, files in sorted(self._write(table, self._conform(table, df)).items()):
            for left in reversed(range(TRIES)):
                before = self.manifest(folder)
                try:
                    self._commit(folder, before, before["files"] + files)
                    break
                except Conflict:
                    if not left:
                        raise

    def replace(self, name: str, values, df: DataFrame) -> None:
        """Make df's rows all that a partition has; none clear it. Rows of another partition are refused."""
        table = self._table(name)
        (folder,) = self.select(name, values if not isinstance(values, list) else tuple(values))
        self.replace_all(name, [folder], df)

    def replace_all(self, name: str, folders: list[str], df: DataFrame, before: Mapping[str, dict] | None = None) -> None:
        """replace() for several partitions in one pass over df. before: manifests that must still be current."""
        table = self._table(name)
        seen = {f: self.manifest(f) for f in folders} if before is None else dict(before)
        made = self._write(table, self._conform(table, df))
        strange = sorted(set(made) - set(folders))
        if strange:
            for folder in strange + list(set(made) & set(folders)):
                for f in made[folder]:
                    self._fs().delete(self._path(f"{folder}/{f}"), False)
            raise DataError(f"{name}: rows of another partition, {strange[0]}")
        for folder in folders:
            self._fs().mkdirs(self._path(folder))
            self._commit(folder, seen[folder], made.get(folder, []))

    # reading

    def active_files(self, name: str, folders: list[str] | None = None) -> list[tuple[str, bool]]:
        """(path, whether it exists) of the files that manifests name, the oldest commit first."""
        out = []
        for folder in self.folders(name) if folders is None else folders:
            m = self.manifest(folder)
            there = {s.getPath().getName() for s in self._fs().listStatus(self._path(folder))} if m["files"] else set()
            out += [(m["file_committed_at"].get(f, 0), f"{self.root.rstrip('/')}/{folder}/{f}", f in there or ("/" in f and self.exists(f"{folder}/{f}"))) for f in m["files"]]
        return [(path, good) for _, path, good in sorted(out)]

    def read(self, name: str, partitions=None, columns: list[str] | None = None, filters: list | None = None) -> DataFrame:
        """The committed rows of some or all partitions. Partitions are chosen by the selector and by what filters say of
        partition columns; filters and columns reach the scan, and older files read columns that came later as null. A file
        that a manifest names and that is missing is an UnavailableError."""
        table = self._table(name)
        folders = self.select(name, partitions)
        if filters:
            condition = predicate(filters)
            folders = [f for f in folders if _may_hold(filters, dict(zip(table.partition_by, self.values_of(table, f), strict=True)))]
        files = self.active_files(name, folders)
        lost = [path for path, good in files if not good]
        if lost:
            raise UnavailableError(f"{name}: {len(lost)} files are missing, {lost[0]} among them")
        out = self.spark.read.schema(table.schema).parquet(*[path for path, _ in files]) if files else self.spark.createDataFrame([], table.schema)
        out = out.where(condition) if filters else out
        return out.select(*columns) if columns else out

    # compaction

    def compact(self, name: str, partitions=None) -> int:
        """One row for each key, in sorted files, in all partitions chosen that have something new to do; how many had. All
        are one job, whose files are ranges of the partitions and keys, so no task has a whole partition."""
        table = self._table(name)
        todo = {}
        for folder in self.select(name, partitions):
            m = self.manifest(folder)
            if m["files"] and m["compacted"] != sorted(m["files"]) and (len(m["files"]) > 1 or table.primary_key):
                todo[folder] = m
        if not todo:
            return 0
        root = self.root.rstrip("/")
        listed = [(f, k, at) for folder, m in todo.items() for k, f in enumerate(m["files"]) for at in [m["file_committed_at"].get(f, 0)]]
        paths = [f"{root}/{folder}/{f}" for folder, m in todo.items() for f in m["files"]]
        meta = self.spark.createDataFrame([(f.rsplit("/", 1)[-1], k, at) for f, k, at in listed], "_file string, _f long, _t long")
        rows = self.spark.read.schema(table.schema).parquet(*paths)
        rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_r")).join(meta, "_file")
        size = sum(self._fs().getFileStatus(self._path(f"{folder}/{f}")).getLen() for folder, m in todo.items() for f in m["files"])
        if table.primary_key:
            rows = last_wins(rows, [*table.partition_by, *table.primary_key], list(table.prefer_by), ["_t", "_f", "_r"])
        keys = [*table.partition_by, *(table.sort_by or table.primary_key)]
        parts = max(1, -(-size // FILE_BYTES))
        made = self._write(table, rows.select(*table.schema.names).repartitionByRange(parts, *keys), sorted_by_key=True)
        for folder, before in todo.items():
            self._commit(folder, before, made.get(folder, []), compacted=True)
        return len(todo)


def _may_hold(filters: list, values: Mapping) -> bool:
    """Whether rows of a partition can pass a filter, by what it says of partition columns."""

    def holds(name: str, op: str, want) -> bool:
        have = values[name]
        if want is None and op in ("=", "==", "!="):
            return (have is None) == (op != "!=")
        if have is None:
            return False
        want = [_like(have, x) for x in want] if op in ("in", "not in") else _like(have, want)
        return {"=": lambda: have == want, "==": lambda: have == want, "!=": lambda: have != want, "<": lambda: have < want, "<=": lambda: have <= want, ">": lambda: have > want, ">=": lambda: have >= want, "in": lambda: have in want, "not in": lambda: have not in want}[op]()

    groups = filters if isinstance(filters[0], list) else [filters]
    return any(all(holds(*x) for x in g if x[0] in values) for g in groups)


def _like(have, want):
    return date.fromisoformat(want) if isinstance(have, date) and isinstance(want, str) else want


@dataclass
class Buffered:
    """Rows that arrive in small Arrow tables, held until a table has `rows` of them or `size` bytes, and then appended. Held
    rows cannot be read; close() writes what is left, and may be called again."""

    store: Store
    rows: int = 100_000
    size: int = 64 << 20
    held: dict[str, list[pa.Table]] = field(default_factory=dict)
    closed: bool = False

    def append(self, name: str, table: pa.Table) -> None:
        if self.closed:
            raise RequestError("the buffer is closed")
        config = self.store._table(name)
        if sorted(table.column_names) != sorted(config.schema.names):
            raise DataError(f"{name}: rows have other columns")
        if not table.num_rows:
            return
        held = self.held.setdefault(name, [])
        held.append(table.select(config.schema.names))
        if sum(t.num_rows for t in held) >= self.rows or sum(t.nbytes for t in held) >= self.size:
            self.flush(name)

    def flush(self, name: str | None = None) -> None:
        for n in [name] if name is not None else list(self.held):
            held = self.held.get(n)
            if held:
                self.store.append(n, self.store.spark.createDataFrame(pa.concat_tables(held, promote_options="permissive")))
                del self.held[n]

    def drop(self, name: str) -> None:
        """Forget the held rows of a table, as a replacement of its partitions does."""
        self.held.pop(name, None)

    def close(self) -> None:
        if not self.closed:
            self.flush()
            self.closed = True

    def __enter__(self) -> Buffered:
        return self

    def __exit__(self, *_) -> None:
        self.close()
