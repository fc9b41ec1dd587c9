"""Token counts: lengths only, from Arrow batches, in runs of about equal bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.chunk_cache import Lengths, by_bytes, spaced_chunks, worker

#: Texts are encoded in runs of about this many bytes; longer ones are cut into parts of about this size.
RUN_BYTES = 1 << 22


def parts_of(text: str, most: int = RUN_BYTES) -> Iterator[str]:
    """A text cut before white space, where no token crosses, into parts of about most characters. (A longer stretch without white space stays whole.)"""
    if len(text) <= most:
        yield text
        return
    for run in by_bytes(spaced_chunks(text), most):
        yield "".join(run)


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 1024,
    run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row, in one pass without a shuffle.

    vocabulary is a file of a byte-level tokenizer, by name among the public ones or by path. Null and empty texts have no
    bytes and no tokens. Rows repeat as they come in, a null id stays null, an empty table gives an empty result, and
    other columns are ignored. A special token's string inside a text counts as the library's default has it. A worker
    holds one run and a bounded memory of chunks at a time; very long texts are cut where no token crosses.
    """

    def lengths(batches):
        count = worker(Lengths, vocabulary).count
        for batch in batches:
            totals = [0] * batch.num_rows
            parts = ((i, p) for i, t in enumerate(batch.column(1)) for p in parts_of(t.as_py() or "", run_bytes))
            for run in by_bytes(parts, run_bytes, lambda x: len(x[1]) + 64):
                for (i, _), n in zip(run, count([p for _, p in run]), strict=True):
                    totals[i] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), batch.column(2)], ["_id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["_id"].dataType.simpleString()
    counted = rows.mapInArrow(lengths, f"_id {kind}, n_tokens long, n_bytes long")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
