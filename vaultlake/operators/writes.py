"""Write algebra: ordered writes, truncations and punched holes of a file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import small_batches


def apply_local(content: bytes, ops: list[dict]) -> bytes:
    """content after ops (op, offset, data, size), in order."""
    buf = bytearray(content)
    for o in ops:
        at, data, size = o.get("offset") or 0, o.get("data") or b"", o.get("size") or 0
        if o["op"] == "write" and data:
            buf.extend(bytes(max(0, at + len(data) - len(buf))))
            buf[at : at + len(data)] = data
        elif o["op"] == "truncate":
            del buf[size:]
            buf.extend(bytes(size - len(buf)))
        elif o["op"] == "punch":
            end = min(len(buf), at + size)
            buf[at:end] = bytes(max(0, end - at))
        elif o["op"] == "grow":
            buf.extend(bytes(max(0, at + size - len(buf))))
    return bytes(buf)


def apply(found: DataFrame, ops: DataFrame) -> DataFrame:
    """(inode, content) of files (inode, content) after ops (inode, seq, op, offset, data, size), ordered by seq.

    One file's operations meet in one row; they are bounded by a file's own history.
    """
    small_batches(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [apply_local(c or b"", o or []) for c, o in zip(batch.column("content").to_pylist(), batch.column("ops").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("inode"), pa.array(out, pa.binary())], ["inode", "content"])

    grouped = ops.groupBy("inode").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "offset", "data", "size"))).alias("ops"))
    rows = found.select("inode", F.col("content").cast("binary").alias("content")).join(grouped, "inode", "full_outer")
    return rows.select("inode", "content", "ops").mapInArrow(run, "inode long, content binary")
