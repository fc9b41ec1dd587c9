"""Best-fit packing of token sequences, certified by lower bounds on the number of bins."""

from __future__ import annotations

import logging
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.chunk_cache import Ids, by_bytes, worker
from tidegauge.llm.common import cut, lean

LOG = logging.getLogger(__name__)
#: Tokens of a sequence.
CAPACITY = 4096
#: Tokens that one partition packs, about 2,000 sequences, and the most rows that it holds on the average.
PARTITION_TOKENS, PARTITION_ROWS = 8_000_000, 1_000_000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", end: int = 1, capacity: int = CAPACITY, run_bytes: int = 1 << 20) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row's ids and the end id, cut only beyond capacity."""

    def run(batches):
        encode = worker(Ids, vocabulary).encode
        for batch in lean(batches):
            out: list[list] = [[], [], [], [], []]
            rows = ((i, t.as_py() or "") for i, t in enumerate(batch.column(1)))
            for part in by_bytes(rows, run_bytes, lambda x: len(x[1]) + 64):
                for (i, _), ids in zip(part, encode([t for _, t in part]), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        for column, x in zip(out, (i, k, start, len(own), zlib.crc32(own.tobytes())), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound on bins that these dual-feasible functions give: the identity, the rounding functions u_k and the
    threshold functions U_e, each summed over all lengths."""
    return lower_bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def lower_bound_of_counts(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """lower_bound() where counts[x] items have length x, for x from 0 to capacity."""
    n = np.asarray(counts).astype(object if int(counts.sum()) > 1 << 40 else np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((n * x).sum()) // capacity)
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # u_k, times k * capacity
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    upto = np.cumsum(n * x)
    over = np.cumsum(n[::-1])[::-1]
    e = np.arange(1, capacity // 2 + 1)
    large = np.where(capacity - e + 1 <= capacity, over[capacity - e + 1], 0)
    middle = upto[capacity - e] - upto[e - 1]
    return max(best, int((large - (-middle // capacity)).max(initial=0)))


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit over lengths in falling order: (bin, offset) of each, and each bin's fill. Each length takes the fullest open
    bin that has room; a bitmap of free space makes that one step."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0
    for i, n in enumerate(lengths.tolist()):
        above = present >> n
        if above:
            free = n + ((above & -above).bit_length() - 1)
            b = stacks[free].pop()
            if not stacks[free]:
                present &= ~(1 << free)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        free -= n
        if free:
            stacks[free].append(b)
            present |= 1 << free
    return bins, offsets, np.array(fill, np.int64)


def _packed(capacity: int, round_: int):
    """Packs a partition best-fit decreasing. full: the row's sequence has no room; certified: the partition has as many
    sequences as the bound of its lengths, so no packing of it has fewer."""

    def run(batches):
        from pyspark import TaskContext

        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        lengths = np.asarray(rows["length"])
        order = np.lexsort([np.asarray(rows["piece"]), np.asarray(rows["u"]), -lengths])
        bins, offsets, fill = best_fit(lengths[order], capacity)
        place = (round_ << 52) | (TaskContext.get().partitionId() << 28)
        out = rows.take(pa.array(order)).select(["_id", "piece", "start", "length", "ids_crc32", "u"])
        certified = np.full(len(order), len(fill) == lower_bound(lengths, capacity))
        for name, x in (("sequence_id", bins + place), ("offset", offsets), ("full", (fill == capacity)[bins]), ("certified", certified)):
            out = out.append_column(name, pa.array(x))
        yield from out.to_batches(max_chunksize=50_000)

    return run


def bound_of(items: DataFrame, capacity: int = CAPACITY) -> int:
    """The lower bound on the sequences of all items together: their lengths are counted, capacity rows at most."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return lower_bound_of_counts(counts, capacity)


def gap(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, bound) of a packed table. Equal numbers certify that no packing has fewer sequences."""
    return packed.where("offset = 0").count(), bound_of(packed, capacity)


def pack(items: DataFrame, capacity: int = CAPACITY, partition_tokens: int = PARTITION_TOKENS, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """items with sequence_id and offset, and with total_sequences and sequences_bound, the count reached and the lower bound
    that certifies it if they are equal. Lengths are from 1 to capacity.

    A piece of full length is a sequence of its own. The others are dealt to partitions of about partition_tokens, each packed
    best-fit decreasing and held against the dual-feasible bound of its lengths. Sequences without room are final. A certified
    partition (as many sequences as its bound) waits; pieces in sequences with room of partitions with a gap are exchanged:
    dealt anew, to as few partitions as the sizes allow, and packed again, until no partition has a gap or an exchange saves
    no sequence. Each certified partition may still have up to one sequence by rounding, so then the sequences with room of
    all partitions are exchanged in the same way, until the bound of all lengths together is met or an exchange saves none.
    Every exchange but the last saves a sequence; the number of rounds is not limited otherwise. The round with the fewest
    sequences is returned. No rows give no rows; repeated rows are packed each.
    """
    kind = items.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long, u long, sequence_id long, offset long, full boolean, certified boolean"
    columns = ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    own = ["_id", "piece", "start", "length", "ids_crc32", "u"]
    numbered = cut(items.withColumn("u", F.monotonically_increasing_id()), "pieces")
    whole = numbered.where(F.col("length") == capacity).withColumn("sequence_id", F.col("u").bitwiseOR(F.lit(1 << 62))).withColumn("offset", F.lit(0).cast("long")).select(columns)
    pool = numbered.where(F.col("length") < capacity)
    bound, wholes = bound_of(pool, capacity), whole.count()
    final, waiting, gaps = [], [], []  # tables of sequences without room, and of others in partitions certified or not
    n_final, n_waiting, n_gaps, before, together, k = 0, 0, 0, None, False, 0
    while True:
        tokens, rows = pool.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
        n = max(1, -(-tokens // partition_tokens), -(-rows // partition_rows))
        packed = cut(pool.select(own).repartition(n, F.xxhash64("u", F.lit(k))).mapInArrow(_packed(capacity, k), schema), f"packed{k}")
        # each sequence has one piece at offset 0
        made, full, certified = packed.where("offset = 0").select(F.count("*"), F.count_if("full"), F.expr("count_if(certified and not full)")).first()
        saved = before is None or made < before
        if saved:
            if together:
                waiting, n_waiting = [], 0
            final, n_final = [*final, packed.where("full")], n_final + full
            waiting, n_waiting = [*waiting, packed.where("certified and not full")], n_waiting + certified
            gaps, n_gaps = [packed.where("not certified and not full")], made - full - certified
        total = n_final + n_waiting + n_gaps
        LOG.info("packing round %d: %d sequences beside those of full length, bound %d, gap %d", k, total, bound, total - bound)
        if total == bound or (together and not saved):
            break
        if saved and n_gaps and not together:
            pool, before = gaps[0], n_gaps
        else:
            pool, before, together = _union([x.select(own) for x in [*waiting, *gaps]]), n_waiting + n_gaps, True
        k += 1
    out = _union([whole, *(x.select(columns) for x in [*final, *waiting, *gaps])])
    return out.withColumns({"total_sequences": F.lit(wholes + total).cast("long"), "sequences_bound": F.lit(wholes + bound).cast("long")})


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", end: int = 1, capacity: int = CAPACITY, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset, total_sequences, sequences_bound.

    Every row of docs is tokenized and ended by the id `end`; a null or empty text is that id alone. Only rows of more than
    capacity ids are cut. Repeated rows are packed each; a null id stays null; an empty table gives an empty result; other
    columns are ignored.
    """
    found = pack(pieces(docs, id_col, text_col, vocabulary, end, capacity), capacity, partition_tokens)
    return found.withColumnRenamed("_id", id_col)
