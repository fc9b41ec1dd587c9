"""Sharding: small immutable shards, merged by size tiers, under versioned manifests that are committed atomically."""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a finished shard, and how many similar shards make a merge.
TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Merges in one Spark job, and jobs at once.
MERGES_IN_A_JOB, JOBS = 64, 4
#: Shards that a segment of a manifest lists, and segments of less than half as many that may lie beside each other.
SEGMENT, SMALL_SEGMENTS = 5_000, 16
#: Seconds for which files that no manifest has named yet may belong to a writer that has not committed.
GRACE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed the version that this one wanted."""


class ShardStore:
    """A table of immutable Parquet shards in a shared folder.

    Version n is the file manifests/n.json, which names segments, immutable lists of shards; the highest is current. It is
    written aside and renamed, and a rename onto an existing version fails, so readers see whole versions and of two writers
    one commits. A commit writes segments for what is new and names again those that did not change. Shards are never changed: a merge writes new ones and a new manifest. vacuum removes what superseded versions named and no kept
    one does; files that no manifest has named may be a writer's that is about to commit, and go only after `grace` seconds.
    """

    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, grace: float = GRACE):
        self.spark, self.folder, self.target_bytes, self.fan_in, self.grace = spark, folder.rstrip("/"), target_bytes, fan_in, grace
        self._jvm = spark._jvm

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, int]]:
        fs, path = self._fs(), self._path(folder)
        return [(f.getPath().getName(), f.getLen()) for f in fs.listStatus(path)] if fs.exists(path) else []

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        return max((int(n[:-5]) for n, _ in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _json(self, name: str):
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value) -> None:
        stream = self._fs().create(self._path(name), False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """A version's schema, its segments with their shards, and all shards."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "segments": {}, "shards": []}
        found = self._json(f"manifests/{version}.json")
        with ThreadPoolExecutor(JOBS) as pool:
            lists = list(pool.map(lambda n: self._json(f"segments/{n}"), found["segments"]))
        return {"version": version, "schema": found["schema"], "segments": dict(zip(found["segments"], lists, strict=True)), "shards": [s for x in lists for s in x]}

    def _segments(self, before: dict, shards: list[dict]) -> list[str]:
        """Names of segments that list exactly shards: those of before that did not change, and new ones for the rest. Many
        small segments are listed anew together."""
        wanted = {s["file"]: s for s in shards}
        kept = [n for n, own in before["segments"].items() if own and all(s["file"] in wanted for s in own)]
        small = [n for n in kept if 2 * len(before["segments"][n]) < SEGMENT]
        if len(small) > SMALL_SEGMENTS:
            kept = [n for n in kept if n not in set(small)]
        listed = {s["file"] for n in kept for s in before["segments"][n]}
        rest, made = [s for f, s in wanted.items() if f not in listed], []
        for i in range(0, len(rest), SEGMENT):
            made.append(f"{uuid.uuid4().hex}.json")
            self._put(f"segments/{made[-1]}", rest[i : i + SEGMENT])
        return kept + made

    def commit(self, before: dict, shards: list[dict], schema: str | None) -> int:
        """Make shards the version after `before`; Conflict if there is one already."""
        version, fs = before["version"] + 1, self._fs()
        aside, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version}.json")
        fs.mkdirs(self._path("manifests"))
        fs.mkdirs(self._path("segments"))
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps({"version": version, "schema": schema, "segments": self._segments(before, shards)}).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, final, none)  # without OVERWRITE: fails if the version exists
        except Exception as e:
            fs.delete(aside, False)
            raise Conflict(f"version {version} is taken") from e
        if self.version() > version:  # the version was taken, and vacuum has removed its manifest
            fs.delete(final, False)
            raise Conflict(f"version {version} is past")
        return version

    def _written(self, folder: str, level: int) -> list[dict]:
        return [{"file": f"{folder}/{n}", "bytes": size, "level": level} for n, size in sorted(self._names(folder)) if n.endswith(".parquet")]

    def _write(self, df: DataFrame, folder: str) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{folder}")

    def append(self, df: DataFrame) -> int:
        """Add df's rows as one small shard for each of its partitions, without a shuffle. An empty df adds a version without new rows."""
        before = self.manifest()
        schema = before["schema"] or df.schema.json()
        if before["schema"] and [(f["name"], f["type"]) for f in json.loads(schema)["fields"]] != [(f["name"], f["type"]) for f in json.loads(df.schema.json())["fields"]]:
            raise ValueError("the arrivals' columns differ from the store's")
        folder = f"shards/{uuid.uuid4().hex}"
        self._write(df, folder)
        return self.commit(before, before["shards"] + self._written(folder, 0), schema)

    def tier(self, size: int) -> int:
        """Shards of one tier differ in size by less than fan_in times."""
        return int(math.log(max(size, 1), self.fan_in))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups to merge: runs of shards of one tier that make up the target, or at least fan_in of them."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target_bytes * 3 // 4:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        groups = []
        for tier in sorted(tiers):
            run: list[dict] = []
            for s in sorted(tiers[tier], key=lambda x: x["file"]):
                if run and sum(x["bytes"] for x in run) + s["bytes"] > self.target_bytes * 5 // 4:
                    groups.append(run)
                    run = []
                run.append(s)
            if len(run) >= self.fan_in or len(run) > 1 and sum(x["bytes"] for x in run) >= self.target_bytes * 3 // 4:
                groups.append(run)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merge until no tier has a group to merge; each pass is one commit. Every merge reads its shards in one task and
        writes one: no row is shuffled. Jobs of many merges run side by side, so the driver's plans stay small."""
        while groups := self.plan((before := self.manifest())["shards"]):
            jobs = [groups[i : i + MERGES_IN_A_JOB] for i in range(0, len(groups), MERGES_IN_A_JOB)]

            def merge(job: list[list[dict]]) -> list[dict]:
                folder, out = f"shards/{uuid.uuid4().hex}", None
                for group in job:
                    one = self._read(group, before["schema"]).coalesce(1)  # noqa: B023
                    out = one if out is None else out.union(one)
                self._write(out, folder)
                return self._written(folder, 1 + max(s["level"] for g in job for s in g))

            with ThreadPoolExecutor(JOBS) as pool:
                made = [s for new in pool.map(merge, jobs) for s in new]
            gone = {s["file"] for g in groups for s in g}
            self.commit(before, [s for s in before["shards"] if s["file"] not in gone] + made, before["schema"])
        return self.version()

    def vacuum(self, keep: int = 1) -> int:
        """Remove the shards that only versions before the last `keep` named, and those that no version names and that are
        older than the grace; then the old manifests. The number of files removed."""
        now, fs = self.version(), self._fs()
        there = sorted(int(n[:-5]) for n, _ in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())
        of = lambda versions: {s["file"] for v in versions for s in self.manifest(v)["shards"]}
        old = [v for v in there if v <= now - keep]
        kept = of(v for v in there if v > now - keep)
        gone = of(old) - kept
        removed = sum(bool(fs.delete(self._path(f), False)) for f in gone)
        before = (time.time() - self.grace) * 1000
        for folder, _ in self._names("shards"):
            for found in fs.listStatus(self._path(f"shards/{folder}")):
                name = f"shards/{folder}/{found.getPath().getName()}"
                if name.endswith(".parquet") and name not in kept and name not in gone and found.getModificationTime() < before:
                    removed += bool(fs.delete(found.getPath(), False))
        lists = lambda versions: {n for v in versions for n in self._json(f"manifests/{v}.json")["segments"]}
        named = lists(v for v in there if v > now - keep)
        for n in lists(old) - named:
            fs.delete(self._path(f"segments/{n}"), False)
        for found in fs.listStatus(self._path("segments")) if fs.exists(self._path("segments")) else ():
            if found.getPath().getName() not in named and found.getModificationTime() < before:
                fs.delete(found.getPath(), False)
        for v in old:
            fs.delete(self._path(f"manifests/{v}.json"), False)
        return removed

    def _read(self, shards: list[dict], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/{s['file']}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the current one by default. Before the first commit there is nothing to read: ValueError."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError("the store has no version")
        return self._read(found["shards"], found["schema"])


def shard_table(df: DataFrame, folder: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> ShardStore:
    """Append df as arrivals, compact them and drop what was superseded; the store's current version has exactly df's rows,
    nulls, repeated rows and all columns included. An arrival is what one scan task reads."""
    store = ShardStore(df.sparkSession, folder, target_bytes, fan_in)
    store.append(df)
    store.compact()
    store.vacuum()
    return store
