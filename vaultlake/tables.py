"""Written intermediate tables, and numbers for sorted rows, for operators that go level by level."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many bytes (row count times row width) may be broadcast.
BROADCAST_BYTES = 8 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a machine-local one only where that is unset and the master is local."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="vaultlake-tables-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


#: For tables of objects: a reader holds a row group's values at once, up to 4096 rows, and twice that while it grows.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "8"}


def cut(df: DataFrame, large: bool = False) -> DataFrame:
    """df written as Parquet and read back: its lineage ends there, and lost executors cost no recomputation. The files
    go when the driver ends. large: rows hold whole objects."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vaultlake-tables/{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS | {"compression": "zstd"} if large else {})).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast if its counted rows fit BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def number(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df and `name` long: its rows counted from 0 in this order. A range-partitioned sort and the partitions' sizes, of
    which the driver sees one row each, so that no task holds more than its range."""
    rows = cut(df.orderBy(*order).withColumns({"p__": F.spark_partition_id(), "m__": F.monotonically_increasing_id()}))
    start, starts = 0, {}
    for p, n in sorted(tuple(r) for r in rows.groupBy("p__").count().collect()):
        starts[p], start = start, start + n
    base = F.create_map(*[F.lit(x).cast("long") for kv in (starts or {0: 0}).items() for x in kv])
    return rows.select(*df.columns, (base[F.col("p__").cast("long")] + F.col("m__").bitwiseAND((1 << 33) - 1)).alias(name))
