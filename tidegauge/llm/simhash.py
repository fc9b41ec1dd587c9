"""SimHash near-dedup on a Gray-order hierarchical index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import LOWER_BYTES, cut, free_name, lean
from tidegauge.llm.components import connected_components

#: Words in a shingle, and the most bits that linked fingerprints differ in.
SHINGLE, BITS = 3, 2
#: A run of fingerprints that one index is built over has at most this many, and about AIM on the average; longer ones are dealt
#: out again by longer patterns.
RUN, AIM = 20_000, 8_192
#: Shingles whose bits are added up at once.
STEP = 1 << 16
FAN = 8


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = 42) -> int:
    """The majority of each bit of the XXH64 of a text's shingles, as an unsigned number; no words give zero."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not parts:
        return 0
    spaced = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(spaced, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = (ends[: len(parts) - words + 1] - np.fromiter(map(len, parts[: len(parts) - words + 1]), np.int64, len(parts) - words + 1) - 1).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), STEP):
        hashes = np.array([digest(spaced[a:b], seed) for a, b in zip(starts[i : i + STEP], stops[i : i + STEP], strict=True)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in lean(batches):
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["_id", "fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_x"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, fp long")


def block_masks(bits: int = BITS, levels: int = 3) -> list[list[tuple[int, int]]]:
    """For each level, (parent's place in the level above, mask). Fingerprints that differ in at most `bits` bits agree
    wholly in one of bits + 1 blocks; within a block, the free bits are dealt into as many blocks again."""
    out, above = [], [(0, 0)]
    for _ in range(levels):
        level = []
        for parent, (_, mask) in enumerate(above):
            free = [i for i in range(64) if not mask >> i & 1]
            for part in np.array_split(free, bits + 1):
                level.append((parent, mask | sum(1 << int(i) for i in part)))
        out.append(level)
        above = level
    return out


def dealing(count: int, run: int = RUN, bits: int = BITS) -> list[list[tuple[int, int]]]:
    """How `count` distinct fingerprints are dealt to runs, in levels like those of block_masks.

    A run of the first level is a range of the Gray order of fingerprints rotated so that a block leads: that order keeps
    equal leading bits together, and a range is named by the block's first bits, as few as give AIM a run. Up to `run`
    fingerprints are one run. What is too many for an index goes on to the whole blocks, and from there to blocks within.
    """
    blocks = block_masks(bits)
    if count <= run:
        return [[(0, 0)], *blocks]  # one run has every pair; nothing is dealt again
    lead = max(1, math.ceil(math.log2(count / min(AIM, run))))
    first = []
    for _, mask in blocks[0]:
        own = [i for i in range(64) if mask >> i & 1]
        first.append((0, sum(1 << i for i in own[-lead:])))
    return [first, [(k, mask) for k, (_, mask) in enumerate(blocks[0])], *blocks[1:]]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """A fingerprint's place in Gray order: neighbours in this order share long patterns."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; label[i] is the smallest place of i's class."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def gray_classes(fps: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The class (place of its first member in Gray order) of each fingerprint, fps distinct: links join at most `bits` differing bits.

    Fingerprints are sorted by Gray rank, and FAN neighbours make a node, FAN nodes a node above. A node holds the pattern
    that all below it share, as mask and value. Pairs of nodes are walked from the root down: what each level newly fixes
    adds its differences, and a pair of groups is pruned as soon as the sum exceeds `bits`, or once all members of both are
    in one class. Nodes with themselves come first, so that dense groups are in one class before groups are compared.
    Work is done in slices, so memory is a multiple of the run's size.
    """
    order = np.argsort(gray_rank(fps), kind="stable")
    x = fps[order].astype(np.uint64)
    label = np.arange(len(x))
    alls, anys = [x], [x]
    while len(alls[-1]) > FAN:
        cuts = np.arange(0, len(alls[-1]), FAN)
        alls.append(np.bitwise_and.reduceat(alls[-1], cuts))
        anys.append(np.bitwise_or.reduceat(anys[-1], cuts))
    masks = [~(a ^ o) for a, o in zip(alls, anys, strict=True)]

    def spread() -> tuple[list[np.ndarray], list[np.ndarray]]:
        low, high = [label], [label]
        for _ in alls[1:]:
            cuts = np.arange(0, len(low[-1]), FAN)
            low, high = [*low, np.minimum.reduceat(low[-1], cuts)], [*high, np.maximum.reduceat(high[-1], cuts)]
        return low, high

    low, high = spread()
    stale = False
    top = len(alls) - 1
    i, j = np.triu_indices(len(alls[top]))
    far = np.argsort(i != j, kind="stable")[::-1]  # the last slice is walked first
    i, j = i[far], j[far]
    todo = [(top, i, j, np.zeros(len(i), np.uint64), np.zeros(len(i), np.int64))]
    while todo:
        level, i, j, fixed, sums = todo.pop()
        if len(i) > 4096:
            todo += [(level, i[k : k + 4096], j[k : k + 4096], fixed[k : k + 4096], sums[k : k + 4096]) for k in range(0, len(i), 4096)]
            continue
        both = masks[level][i] & masks[level][j]
        sums = sums + np.bitwise_count((alls[level][i] ^ alls[level][j]) & both & ~fixed)
        stay = sums <= bits
        if level == 0:
            i, j = i[stay], j[stay]
            apart = (i < j) & (label[i] != label[j])
            if apart.any():
                _unite(label, i[apart], j[apart])
                stale = True
            continue
        if stale:
            (low, high), stale = spread(), False
        stay &= (low[level][i] != high[level][i]) | (low[level][j] != high[level][j]) | (low[level][i] != low[level][j])
        i, j, both, sums = i[stay], j[stay], both[stay], sums[stay]
        if not len(i):
            continue
        n = len(alls[level - 1])
        ci = np.repeat(i[:, None] * FAN + np.arange(FAN), FAN, axis=1)
        cj = np.tile(j[:, None] * FAN + np.arange(FAN), FAN)
        real = (ci < n) & (cj < n) & (ci <= cj)
        rows = np.broadcast_to(np.arange(len(i))[:, None], ci.shape)[real]
        ci, cj = ci[real], cj[real]
        far = np.argsort(ci != cj, kind="stable")[::-1]
        todo.append((level - 1, ci[far], cj[far], both[rows][far], sums[rows][far]))
    out = np.empty(len(x), np.int64)
    out[order] = order[label]
    return out


def run_links(path: np.ndarray, block: np.ndarray, fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links from members to the first of their class in each run (equal path and block; sorted by them), by the run's index."""
    n = len(fps)
    same = (path[1:] == path[:-1]) & (block[1:] == block[:-1])
    starts = np.flatnonzero(np.concatenate([[True], ~same])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    a, b = [fps[:0]], [fps[:0]]
    for k in np.flatnonzero(sizes > 1):
        own = fps[starts[k] : starts[k] + sizes[k]]
        root = gray_classes(own.view(np.uint64), bits)
        i = np.flatnonzero(root != np.arange(len(own)))
        a.append(own[i])
        b.append(own[root[i]])
    return np.concatenate(a), np.concatenate(b)


def fingerprint_links(distinct: DataFrame, bits: int = BITS, run: int = RUN) -> DataFrame:
    """(a, b): links among the distinct fingerprints in column fp whose components are those of all links of at most `bits` bits.

    Fingerprints are dealt to runs (dealing), each a task's to index in Gray order: two that differ in at most `bits` bits
    agree wholly in a block, and so lie in one range of the order that the block leads. Ranges of more than `run` are dealt
    out again, so that no task gathers more until 64 bits are nearly used up, where a block can have no more than its few
    free bits allow. Links to the classes' first members are returned, not pairs.
    """
    spark, found = distinct.sparkSession, None
    rows = distinct.select("fp")
    levels = dealing(rows.count(), run, bits)
    signed = lambda m: m - (1 << 64) if m >> 63 else m

    def links(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            now = [np.asarray(batch.column(k)) for k in range(3)]
            now = [np.concatenate(z) for z in zip(held, now, strict=True)] if held else now
            path, block, fp = now
            if not len(fp):
                continue
            last = int(np.flatnonzero((path != path[-1]) | (block != block[-1])).max(initial=-1)) + 1
            if last:
                yield _pairs(run_links(path[:last], block[:last], fp[:last], bits))
            held = [z[last:] for z in now]
        if held and len(held[0]):
            yield _pairs(run_links(*held, bits))

    for depth, level in enumerate(levels):
        if depth == 0:
            choices = F.array(*[F.struct(F.lit(k).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("block")) for k, (_, m) in enumerate(level)])
            keyed = rows.select("fp", F.explode(choices).alias("k"))
        else:
            choices = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(k).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("block")) for k, (p, m) in enumerate(level)])
            keyed = rows.select("fp", F.explode(F.filter(choices, lambda c: c["parent"] == F.col("path"))).alias("k"))
        keyed = keyed.select("k.path", "k.block", "fp")
        deepest = depth == len(levels) - 1
        if depth == 0 and len(level) == 1:  # one run
            return keyed.repartition(1).mapInArrow(links, "a long, b long")
        counts = cut(keyed.groupBy("path", "block").count().where("count > 1"), "blocks")
        ready = keyed.join(counts if deepest else counts.where(F.col("count") <= run), ["path", "block"], "left_semi")
        ready = ready.repartition("path", "block").sortWithinPartitions("path", "block").select("path", "block", "fp")
        made = ready.mapInArrow(links, "a long, b long")
        found = made if found is None else found.union(made)
        if deepest or counts.where(F.col("count") > run).isEmpty():
            return found
        rows = cut(keyed.join(counts.where(F.col("count") > run), ["path", "block"], "left_semi"), "hot_blocks")
    return found


def _pairs(ab: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ab[0], pa.int64()), pa.array(ab[1], pa.int64())], ["a", "b"])


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, bits: int = BITS, run: int = RUN) -> DataFrame:
    """id, fingerprint (16 lower-case hex digits) and component_id of every row of docs.

    Rows with one fingerprint, and rows whose fingerprints differ in at most `bits` bits, are linked; component_id is the
    smallest id that links reach, the row's own included. Null and empty texts have fingerprint zero and are linked like
    others. Rows with a null id keep their place and get the smallest id of their component, null if it has none; repeated
    rows stay repeated; an empty table gives an empty result; other columns are ignored. Copies count once in the search:
    it runs on distinct fingerprints, so a group of copies of any size is one row.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    label = _labelled(rows, F.min("_id"), bits, run)
    smallest = label.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = label.select("fp", "label").join(smallest, "label").select("fp", "component_id")
    out = rows.join(classes, "fp")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(rows: DataFrame, least, bits: int, run: int) -> DataFrame:
    """(fp, least, label) of each fingerprint of rows; `least` is an aggregate of its rows, label names its component."""
    distinct = cut(rows.groupBy("fp").agg(least.alias("least")), "distinct")
    roots = connected_components(fingerprint_links(distinct, bits, run))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("label"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, bits: int = BITS, run: int = RUN) -> DataFrame:
    """The columns of docs for one row of each component: that with the smallest id, and one of equal rows.

    Rows are known by id, MD5 of the text and XXH64 of the other columns (but maps), not by the id alone: rows of one id in
    different components are judged apart, and of several rows with the smallest id in a component that with the smallest
    such key stays, however they arrive. A component without any id keeps the row of the smallest key.
    """
    key = free_name("_key", docs.columns)
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind]
    text = F.md5(F.col(text_col).cast("string").cast("binary"))
    # rows with one key have one text, so they are in one component
    keyed = docs.withColumn(key, F.concat_ws("|", F.coalesce(text, F.lit("-")), F.xxhash64(*others) if others else F.lit(0), F.col(id_col).cast("string")))
    named = keyed.select(F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.col(key).alias("key")).alias("_r"), F.col(text_col).alias("_t"))
    rows = cut(fingerprints(named, "_r", "_t", words), "fingerprints")
    firsts = cut(_labelled(rows, F.min("_id"), bits, run).groupBy("label").agg(F.min("least").alias("r")).select(F.col("r.key").alias(key)), "firsts")
    return keyed.join(firsts, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
