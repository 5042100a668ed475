"""Content-defined chunking with a gear hash and normalised masks (Xia et al., USENIX ATC 2016), and batch dedup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import small_batches
from .content import whole

SIZES = (16 << 10, 64 << 10, 256 << 10)
BATCH_BYTES = 2 << 20


@cache
def gear() -> np.ndarray:
    """256 fixed 64-bit values by rule: digests of the byte's number."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear%d" % i).digest()[:8], "little") for i in range(256)], np.uint64)


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of chunks. A chunk has `least` to `most` bytes, but for the last; before the average a stricter mask holds.

    The gear hash at a byte depends on the 64 bytes up to it alone, so it is formed for all bytes at once.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    g, h = gear()[np.frombuffer(data, np.uint8)], np.zeros(n, np.uint64)
    for k in range(min(64, n)):
        h[k:] += g[: n - k] << np.uint64(k)
    bits = max(1, average.bit_length() - 1)
    strict, loose = (np.uint64(((1 << min(60, b)) - 1) << (63 - min(60, b))) for b in (bits + 2, max(1, bits - 2)))
    a, b = np.flatnonzero(h & strict == 0), np.flatnonzero(h & loose == 0)
    out, at = [], 0
    while n - at > least:
        x = int(np.searchsorted(a, at + least))
        end = int(a[x]) + 1 if x < len(a) and a[x] < at + average else 0
        if not end:
            y = int(np.searchsorted(b, at + max(least, average)))
            end = min(int(b[y]) + 1 if y < len(b) else n, at + most)
        at = min(end, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunk(found: DataFrame, sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """(inode, offset, plain_len, plaintext_hash, data binary) of files (inode, content); empty files have no chunks."""
    small_batches(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["inode", "offset", "plain_len", "plaintext_hash", "data"])
        for batch in batches:
            for inode, content in zip(batch.column("inode").to_pylist(), batch.column("content"), strict=True):
                data, at = (content.as_py() or b""), 0
                for end in cut_points(data, *sizes):
                    rows.append((inode, at, end - at, hashlib.sha256(data[at:end]).hexdigest(), data[at:end]))
                    held, at = held + end - at, end
                    if held > BATCH_BYTES:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    rows = found.select("inode", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "inode long, offset long, plain_len long, plaintext_hash string, data binary")


def ingest(chunks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(extents, new index rows): a batch is deduplicated whole, against what is known and within itself."""
    extents = chunks.select("inode", "offset", F.col("plaintext_hash").alias("object_id"), "plain_len")
    fresh = extents.groupBy("object_id").agg(F.min("plain_len").alias("size"), F.count("*").alias("n"))
    return extents, fresh.join(known.select("object_id"), "object_id", "left_anti")


def assemble(extents: DataFrame, objects: DataFrame, sizes: DataFrame) -> DataFrame:
    """(inode, content binary): objects (object_id, data) placed at their offsets; bytes without an extent are zero."""
    return whole(extents, objects, sizes).select("inode", "content")
