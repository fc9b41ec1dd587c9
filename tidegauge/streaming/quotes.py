"""Quote streams: the latest row of each symbol and the last version of each event, kept batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.functions.values import last_first
from tidegauge.operators.bars import latest

#: Batches after which what they left is made one table.
EVERY = 16


def replay(spark: SparkSession, path: str, checkpoint: str, out: str, keys: list[str], order: list[str], files: int = 1, every: int = EVERY) -> DataFrame:
    """Read the Parquet files at path as a stream and give the last row of each key over all batches.

    Every micro-batch is reduced to the last row of each key and written under its number, so that a batch that runs again
    after a failure replaces itself. After each `every` batches these and the table before them become one table, whose size
    is that of the keys, and the result reads the last such table and the batches since. A restart goes on at the checkpoint.
    """
    schema = spark.read.parquet(path).schema
    read = lambda names: spark.read.schema(schema).parquet(*names)

    def parts(number: int) -> list[str]:
        """What has all rows up to a batch: the last table of several batches, and the batches since."""
        since = (number + 1) // every * every
        return ([f"{out}/upto={since - 1}"] if since else []) + [f"{out}/batch={k}" for k in range(since, number + 1)]

    def sink(batch: DataFrame, number: int) -> None:
        latest(batch, keys, last_first(*order)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if (number + 1) % every == 0:
            before = parts(number - every) + [f"{out}/batch={k}" for k in range(number - every + 1, number + 1)]
            latest(read(before), keys, last_first(*order)).write.mode("overwrite").parquet(f"{out}/upto={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(path)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = _last_batch(spark, out)
    return latest(read(parts(done)), keys, last_first(*order)) if done >= 0 else spark.createDataFrame([], schema)


def _last_batch(spark: SparkSession, out: str) -> int:
    """The number of the last batch that was written whole; -1 if there is none."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*/_SUCCESS")) or []
    return max((int(s.getPath().getParent().getName().removeprefix("batch=")) for s in found), default=-1)
