"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of UTF-8 text, A-Z lower-cased, all others kept.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine serves a
    local master, as in tests; on a cluster it would be the driver's alone, so that is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidegauge/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor never makes its lineage run again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table is broadcast up to this many bytes, by its counted rows and the bytes that one takes.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, of `rows` counted rows, marked for broadcast if it stays within limit; else as it is, for a join by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def lean(batches, rows: int = 1_000):
    """Arrow batches in slices of at most `rows` rows; after each batch, memory that Arrow holds for later ones is given back."""
    import pyarrow as pa

    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        del batch
        pa.default_memory_pool().release_unused()


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row. (A projection may be inlined into a lambda and run once per element.)"""
    return F.transform(F.array(value), body)[0]


def free_name(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as make it none of columns (in any case, as Spark compares them)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and no other letter. (lower() maps other letters too, and is slow where there are any: such texts are
    split before their capitals.)"""
    small = lambda p: F.when(p.rlike("^[A-Z]"), F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)
    mixed = F.array_join(F.transform(F.split(text, "(?=[A-Z])"), small), "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mixed)


def numbers(values: list, kind: str) -> Column:
    """A constant array: folded once into the plan, not built for each row."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def words_of(text: Column, separators: str) -> Column:
    """The non-empty parts of text between runs of the separator class (a regex class body); null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{separators}]+")
    return F.filter(parts, lambda w: w != "")


#: Separators of `[^\x20\x09-\x0D]+` words.
SPACES = r"\x20\x09-\x0D"
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words, in texts whose A-Z are lower-cased.
NON_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
