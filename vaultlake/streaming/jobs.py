"""Structured Streaming: upload drain with its barrier and rate limit, periodic jobs, buffered writes, operation log."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut


def drain(queue: DataFrame, upload: Callable[[DataFrame], None], checkpoint: str, interval: str | None = None):
    """Start uploading a stream of queued objects (object_id, added_at), each once a batch, in the order they came.

    The checkpoint is the durable queue: a batch that fails is run again, and uploads are idempotent by object id.
    Without an interval the queue is drained and the query ends.
    """

    def batch(df: DataFrame, _: int) -> None:
        upload(df.groupBy("object_id").agg(F.min("added_at").alias("added_at")).orderBy("added_at", "object_id"))

    writer = queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def uploader(store: str) -> Callable[[DataFrame], None]:
    """Appends what the store at this path lacks. The anti-join makes a repeated batch a no-op."""

    def upload(df: DataFrame) -> None:
        spark = df.sparkSession
        try:
            known = spark.read.parquet(store)
        except Exception as e:  # the store is made by the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = df.limit(0)
        df.join(known.select("object_id"), "object_id", "left_anti").write.mode("append").parquet(store)

    return upload


def queue_stream(spark: SparkSession, path: str, schema: str, files: int | None = None, size: str | None = None) -> DataFrame:
    """The upload queue as a stream, at most so many files or bytes ("64m") a trigger: with the trigger's interval that
    is the rate limit."""
    if files is not None and size is not None:
        raise ValueError("a limit is on files or on bytes")
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if size is not None:
        reader = reader.option("maxBytesPerTrigger", size)
    return reader.parquet(path)


def barrier(upload: Callable[[DataFrame], list], publish: Callable[[], object]) -> Callable[[DataFrame], None]:
    """An upload for `drain` that publishes the index only after a batch whose upload names no failed back end. A failed
    batch raises, so that the checkpoint keeps it for the next run, and what names its objects is not published."""

    def run(df: DataFrame) -> None:
        failed = upload(df)
        if failed:
            raise RuntimeError(f"not uploaded to {failed}; the index is not published")
        publish()

    return run


def periodic(spark: SparkSession, job: Callable[[], object], checkpoint: str, every: str):
    """Start running a batch job at an interval ("1 hour"): garbage collection, index sync, eviction. A job that raises
    ends the query, and its exception tells so."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda df, i: job()).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def finalize(flush: Callable[[DataFrame], DataFrame], open_files: DataFrame, waits: tuple[float, ...] = (0.05, 0.2, 0.8), wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """open_files (id) that could not be flushed, to be marked incomplete. flush takes files and gives those that failed;
    these, and no others, are tried again after each wait."""
    left = cut(flush(open_files).select("id"))
    for pause in waits:
        if left.isEmpty():
            break
        wait(pause)
        left = cut(flush(left).select("id"))
    return left


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The operations log, one JSON object a line, as a stream; lines that do not parse are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def event_counts(events: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events (ts, event_type, value) a window and type; those later than the delay are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def buffered_writes(ops: DataFrame, budget: int = 1 << 20) -> DataFrame:
    """A stream of writes (inode, seq, offset, data) as runs (inode, offset, data): contiguous ones are merged, and a run
    is flushed by a gap or at `budget` bytes. State is one run an inode; what is left at the end of a batch is kept and
    flushed by the timeout."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    import pandas as pd

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, data = state.get if state.exists else (None, b"")
        out = []
        if not state.hasTimedOut:
            for _, offset, new in sorted((r.seq, r.offset, bytes(r.data)) for p in parts for r in p.itertuples()):
                if data and (offset != start + len(data) or len(data) + len(new) > budget):
                    out.append((key[0], start, data))
                    data = b""
                if not data:
                    start = offset
                data += new
        if state.hasTimedOut or len(data) >= budget:
            out.append((key[0], start, data))
            data = b""
        if data:
            state.update((start, data))
            state.setTimeoutDuration(1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["inode", "offset", "data"])

    return ops.groupBy("inode").applyInPandasWithState(step, "inode long, offset long, data binary", "start long, data binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
