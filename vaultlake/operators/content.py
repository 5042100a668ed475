"""File contents as streams of extents: digests, whole files, byte ranges. A worker holds one file's chunk, or one whole
file where that is asked for, and never all chunks of a task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import small_batches

_ZEROS = bytes(1 << 16)
_BATCH_BYTES = 2 << 20


class _Digest:
    """SHA-256 of a file's bytes and, after a bar, its size in digits."""

    def __init__(self) -> None:
        self.hash = hashlib.sha256()

    def feed(self, data: bytes) -> None:
        self.hash.update(data)

    def result(self, size: int) -> str:
        self.hash.update(b"|%d" % size)
        return self.hash.hexdigest()


class _Whole:
    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def feed(self, data: bytes) -> None:
        self.parts.append(data)

    def result(self, size: int) -> bytes:
        return b"".join(self.parts)


def _streams(make: Callable, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (inode, size, offset, data) in order -> (inode, value, status) of each file. Holes are zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, sink, at, status, out, held = None, 0, None, 0, "ok", [], 0

        def close() -> None:
            nonlocal held
            if sink is None:
                return
            zeros(size)
            value = sink.result(size) if status == "ok" else None
            out.append((now, value, status))
            held += len(value or b"") + 100

        def zeros(to: int) -> None:
            nonlocal at
            while at < to:
                n = min(len(_ZEROS), to - at)
                sink.feed(_ZEROS[:n])
                at += n

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), kind, pa.string()), strict=True)], ["inode", "value", "status"])
            out.clear()
            return done

        for batch in batches:
            data = batch.column("data")
            for i, (inode, n, offset, known) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("inode", "size", "offset", "known")], strict=True)):
                if sink is None or inode != now:
                    close()
                    if held > _BATCH_BYTES:
                        yield flush()
                        held = 0
                    now, size, sink, at, status = inode, n, make(), 0, "ok"
                if offset is None or status != "ok":
                    continue
                if not known:
                    status = "missing object"
                elif offset < at:
                    status = "overlap"
                else:
                    piece = data[i].as_py()
                    if offset + len(piece) > size:
                        status = "past the end"
                    else:
                        zeros(offset)
                        sink.feed(piece)
                        at += len(piece)
        close()
        if out:
            yield flush()

    return run


def _ordered(extents: DataFrame, objects: DataFrame, sizes: DataFrame) -> DataFrame:
    small_batches(sizes.sparkSession)
    held = objects.select("object_id", "data", F.lit(True).alias("known"))
    rows = sizes.select("inode", "size").join(extents.select("inode", "offset", "object_id").join(held, "object_id", "left"), "inode", "left")
    return rows.select("inode", "size", "offset", "data", "known").repartition("inode").sortWithinPartitions("inode", "offset")


def digests(extents: DataFrame, objects: DataFrame, sizes: DataFrame) -> DataFrame:
    """(inode, digest, status) of files (inode, size) from extents (inode, offset, object_id) and objects (object_id,
    data). Holes count as zeros; status is ok, missing object, overlap or past the end, and the digest null unless ok."""
    return _ordered(extents, objects, sizes).mapInArrow(_streams(_Digest, pa.string()), "inode long, value string, status string").withColumnRenamed("value", "digest")


def inline_digest(data: object) -> object:
    """The digest of bytes that are held in one column, as `digests` forms it."""
    size = F.octet_length(data)
    return F.sha2(F.concat(data.cast("binary"), F.concat(F.lit("|"), size.cast("string")).cast("binary")), 256)


def verify(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(inode, outcome) of digests found (inode, digest, status) against those stored (inode, file_digest): verified,
    missing_digest, changed, or failed where the content could not be read."""
    both = found.join(stored.select("inode", "file_digest"), "inode", "left")
    outcome = F.when(F.col("status") != "ok", "failed").when(F.col("file_digest").isNull(), "missing_digest").when(F.col("file_digest") == F.col("digest"), "verified").otherwise("changed")
    return both.select("inode", outcome.alias("outcome"))


def stable(before: DataFrame, after: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes (inode, outcome) of `verify` where size and mtime were the same before and after the read; else
    changed_during_read, which is neither a pass nor a damage. A file that went away in between is such a change."""
    a, b = (t.select("inode", F.struct("size", "mtime").alias(n)) for t, n in ((before, "a"), (after, "b")))
    both = outcomes.join(a, "inode", "left").join(b, "inode", "left")
    return both.select("inode", F.when(F.coalesce(F.col("a") == F.col("b"), F.lit(False)), F.col("outcome")).otherwise("changed_during_read").alias("outcome"))


def tally(outcomes: DataFrame) -> DataFrame:
    """One row: files by outcome of `verify` or `stable`."""
    kinds = ("verified", "missing_digest", "changed", "failed", "changed_during_read")
    return outcomes.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def whole(extents: DataFrame, objects: DataFrame, sizes: DataFrame) -> DataFrame:
    """(inode, content binary, status) of files, read like `digests`; one row has to hold a file."""
    return _ordered(extents, objects, sizes).mapInArrow(_streams(_Whole, pa.binary()), "inode long, value binary, status string").withColumnRenamed("value", "content")


def read(extents: DataFrame, objects: DataFrame, sizes: DataFrame, requests: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(inode, start, content) of requests (inode, start, length): bytes from start on, up to the file's end and `most`.

    Only extents that meet the range are joined, and only the bytes inside it are kept, so that a request's parts are
    bounded by `most`. Bytes without an extent are zero.
    """
    end = F.least(F.col("start") + F.least(F.col("length"), F.lit(most)), F.col("size"))
    asked = requests.join(sizes.select("inode", "size"), "inode").withColumn("end", F.greatest(end, F.col("start")))
    finish = F.col("offset") + F.col("plain_len")
    met = asked.join(extents, "inode").where((F.col("offset") < F.col("end")) & (finish > F.col("start"))).join(objects.select("object_id", "data"), "object_id")
    lead = F.greatest(F.col("start") - F.col("offset"), F.lit(0))
    piece = F.substring("data", (lead + 1).cast("int"), (F.least(finish, "end") - F.col("offset") - lead).cast("int"))
    parts = met.select("inode", "start", (F.greatest("offset", "start") - F.col("start")).alias("at"), piece.alias("piece")).groupBy("inode", "start").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    zeros = lambda n: F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))
    none = F.unhex(F.lit(""))
    body = F.aggregate("parts", none, lambda a, x: F.concat(a, zeros(x["at"] - F.octet_length(a)), x["piece"]))
    out = asked.join(parts, ["inode", "start"], "left").withColumn("b", F.coalesce(F.when(F.col("parts").isNotNull(), body), none))
    return out.select("inode", "start", F.concat("b", zeros(F.col("end") - F.col("start") - F.octet_length("b"))).alias("content"))
