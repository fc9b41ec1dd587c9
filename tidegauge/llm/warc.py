"""WARC archives: one gzip member a record, written by partitions and read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, scratch, small_side

#: Bytes of a reading task's range: the most, and the least where there are few archives.
RANGE_BYTES, LEAST_RANGE = 128 << 20, 4 << 20
#: Payloads with more copies than this are hot; bytes of a row of first copies when broadcast.
HOT_COPIES, FIRST_BYTES = 10_000, 128
#: Bytes read at once while a task scans or decodes.
BLOCK = 1 << 18
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _fs(path: str):
    """The file system of a path that executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def base32_sha1(payload: Column) -> Column:
    """The bare base32 SHA-1 of a string or binary column: 40 bits of hex make 8 digits."""
    hexed = F.sha1(payload.cast("binary"))
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(page_id, url: str | None, payload: bytes | None, digest: str, refers_to, size: int | None = None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the payload's HTTP head only, which needs its size alone."""
    size = len(payload) if size is None else size
    line = re.sub(r"[\x00-\x20\x7f]+", " ", url or "").strip()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{line}')}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {line}"] if line else []),
        *([f"WARC-Page-ID: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]),
        "Content-Type: application/http; msgtype=response",
    ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def _marked(rows: DataFrame, least_bytes: int) -> DataFrame:
    """rows (_id, _url, _payload, _digest, _n) with _refers, the response's id where a row revisits it.

    The first copies of repeated payloads, by digest and size, are broadcast if their bytes allow. Else those of hot payloads
    are (there are at most rows / HOT_COPIES), which also leaves no payload of a hot revisit to move, and the others, of few
    copies each, are joined by a shuffle.
    """
    lean = rows.where(F.col("_n") >= least_bytes).groupBy("_digest", "_n").agg(F.max("_id").alias("_first"), F.count("*").alias("_copies"))
    first = cut(lean.where("_copies > 1"), "first_copies")
    key = ["_digest", "_n"]
    refers = F.when(F.col("_id").isNull() | (F.col("_id") != F.col("_first")), F.col("_first")).alias("_refers")
    out = ["_id", "_url", "_payload", "_digest", "_n"]
    once = small_side(first, first.count(), FIRST_BYTES)
    if once is not first:
        return rows.join(once, key, "left").select(*out, refers)
    hot = F.broadcast(first.where(F.col("_copies") > HOT_COPIES).withColumn("_hot", F.lit(True)))
    split = rows.join(hot, key, "left").select(*out, refers, "_hot")
    rest = split.where("_hot is null").drop("_refers", "_hot").join(first.where(F.col("_copies") <= HOT_COPIES), key, "left").select(*out, refers)
    return split.where("_hot").select(*out, "_refers").unionByName(rest)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record for every row, and return the archives as a written table (path, bytes): one for each partition with rows.

    Of rows with equal payloads of at least least_bytes bytes, that with the largest id is a response and others revisit it;
    rows that share that id are all responses, and so are rows whose group has no id. A null payload is empty. Rows repeat as
    they come in, other columns are ignored, and an empty table gives no archives. Only ids and digests are aggregated. An
    archive is written under a name of its attempt's own and counts only if its task's result names it, so attempts that are
    lost or repeated leave no record twice.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url") if url_col in pages.columns else F.lit(None).cast("string").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumns({"_digest": base32_sha1(F.col("_payload")), "_n": F.octet_length("_payload")})
    marked = _marked(rows, least_bytes).select("_id", "_url", F.when(F.col("_refers").isNull(), F.col("_payload")).alias("_payload"), "_digest", "_n", "_refers")

    def write(batches):
        from pyspark import TaskContext

        task, out, total = TaskContext.get(), None, 0
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            for i, url, body, digest, n, refers in zip(*(batch.column(k) for k in range(6)), strict=True):
                if out is None:
                    files, path = _fs(name)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                made = record(i.as_py(), url.as_py(), body.as_py(), digest.as_py(), refers.as_py(), n.as_py())
                out.write(made)
                total += len(made)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.int64())], ["path", "bytes"])

    return cut(marked.mapInArrow(write, "path string, bytes long"), "archives")


class Reader:
    """A file's bytes by position, a block at a time."""

    def __init__(self, path: str):
        files, inner = _fs(path)
        self.file = files.open_input_file(inner)
        self.size = self.file.size()
        self.at, self.block = 0, b""

    def bytes(self, start: int, n: int = BLOCK) -> bytes:
        """Up to n bytes from start: what is at hand if that is at least a few, else a block that is read."""
        if not self.at <= start < self.at + len(self.block) - 64:
            self.at, self.block = start, self.file.read_at(min(BLOCK, max(0, self.size - start)), start)
        return self.block[start - self.at : start - self.at + n]

    def magic(self, start: int, stop: int) -> int:
        """The first place in [start, stop) where gzip's magic begins, else -1."""
        while start < stop:
            block = self.bytes(start, BLOCK)
            found = block.find(MAGIC, 0, min(len(block), stop - start + 2))
            if found >= 0:
                return start + found
            start += max(1, len(block) - 2)
        return -1

    def member(self, start: int, head: bool = False) -> tuple[bytes, int] | None:
        """The member at start and the place after it, None if there is none. head: only as far as its first bytes."""
        unpack, out, at = zlib.decompressobj(31), [], start
        try:
            while not unpack.eof:
                block = self.bytes(at, 4096 if head else BLOCK)
                if not block:
                    return None
                out.append(unpack.decompress(block, 16 if head else 0))
                if head and out[-1]:
                    return out[-1], at
                at += len(block)
        except zlib.error:
            return None
        return b"".join(out), at - len(unpack.unused_data)


def members(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The decoded WARC members that begin in [start, stop) of a file.

    gzip's magic may also occur inside a member: a candidate counts once its first bytes decode to a WARC version line and
    the whole of it to its checksum. From a member found, the next one begins where it ends.
    """
    reader, at, chained = Reader(path), start, start == 0
    while at < stop:
        if not chained:
            at = reader.magic(at, stop)
            if at < 0:
                return
        head = reader.member(at, head=True)
        found = reader.member(at) if head and head[0].startswith(b"WARC/"[: len(head[0])]) else None
        if found is None or not found[0].startswith(b"WARC/"):
            at, chained = at + 1, False
            continue
        yield found[0]
        at, chained = found[1], True


def parse(member: bytes) -> dict:
    """A record's named fields (lower case) and its block."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    n = int(fields.get("content-length", len(rest)))
    if len(rest) < n:
        raise ValueError(f"a record of {n} bytes has {len(rest)}")
    return fields | {"": rest[:n]}


def read_warc(archives: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """A row for each response and revisit record: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    archives are (path, bytes). Files are split into byte ranges by the executors, a task a range; a task owns the records
    that begin in its range, wherever they end. Ranges have range_bytes, by default a share of all bytes between LEAST_RANGE
    and RANGE_BYTES. A response's size and digest are those of the payload read, which must be those that its head names; a
    revisit's are those its head names. A record without WARC-Page-ID has a null page_id; no archives give no rows.
    """
    spark = archives.sparkSession
    total = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    step = range_bytes or max(LEAST_RANGE, min(RANGE_BYTES, total // (4 * spark.sparkContext.defaultParallelism)))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(step).cast("long"))
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start")).select("path", "start", F.least(F.col("start") + step, F.col("bytes")).alias("stop"))

    def read(batches):
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: list[tuple] = []
                for raw in members(path, start, stop):
                    r = parse(raw)
                    if r.get("warc-type") not in ("response", "revisit"):
                        continue
                    head, _, payload = r[""].partition(b"\r\n\r\n")
                    digest, n = r["warc-payload-digest"].removeprefix("sha1:"), int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)[1])
                    if r["warc-type"] == "response":
                        if (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)) != (digest, n):
                            raise ValueError(f"{path}: a payload differs from its digest")
                    number = lambda k: int(r[k]) if k in r else None  # noqa: B023, E731
                    out.append((number("warc-page-id"), n, digest, r["warc-type"], number("warc-refers-to-page-id"), r.get("warc-target-uri")))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return ranges.repartition(max(1, -(-total // step))).mapInArrow(read, RECORD)


def warc_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, range_bytes: int | None = None) -> DataFrame:
    """Write pages as archives in a shared folder and read them back by byte ranges: a row for each row of pages, as
    write_warc and read_warc say; null, empty and repeated payloads, null and repeated ids and empty tables included."""
    archives = write_warc(pages, folder or scratch(pages.sparkSession, "warc"), id_col, url_col, payload_col, least_bytes)
    return read_warc(archives, range_bytes)


#: The same from the table, in DuckDB SQL: base32 by five bits at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(b)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j:
    (((strpos('0123456789abcdef', substr(sha1(b), CAST((5 * i + j) // 4 + 1 AS BIGINT), 1)) - 1) >> CAST(3 - (5 * i + j) % 4 AS INTEGER)) & 1) * (16 >> CAST(j AS INTEGER)))) AS BIGINT), 1)), '') AS payload_digest FROM p),
f AS (SELECT payload_digest, payload_bytes, max(page_id) AS first_id FROM d GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f USING (payload_digest, payload_bytes)
"""
