"""Shared pieces: word expressions, materialised tables, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import BATCH_BYTES, small_batches  # noqa: F401  operators take them from here

#: A word is a run of characters outside these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"\x20\x09-\x0D"

#: Tables of at most this many bytes (row count times row width) may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Narrow tables are written in files of so many rows, and at least in so many files.
ROWS_A_FILE, LEAST_FILES = 1 << 20, 8

_own_dir: str | None = None


def words(text: Column) -> Column:
    """array<string> of the words of a text; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is made only where the setting is absent and the master is local, as in tests.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="vaultlake-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


#: Tables written by `materialize` within the innermost `scope`.
_scopes: list[list[str]] = []


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def materialize(df: DataFrame, rows: int | None = None, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts the lineage.

    The files outlive any executor, keep column pruning and give the planner true sizes. They go with the scope that is
    open (unless keep is set), with `discard`, or else when the driver ends. rows: at most so many rows come out of a
    shuffle; then they are written as files of ROWS_A_FILE instead of one small file a shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))
    path = f"{shared_dir(spark)}/vaultlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _files(spark, path)
    fs.deleteOnExit(at)
    if _scopes and not keep:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` returned and that nothing will read again."""
    path = getattr(df, "_scratch", None)
    if path:
        fs, at = _files(df.sparkSession, path)
        fs.delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialize` writes inside are deleted at the end; what is wanted must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            fs, at = _files(spark, path)
            fs.delete(at, True)


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark df for broadcast if its counted rows fit BROADCAST_BYTES; else leave the choice to a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def shielded(docs: DataFrame, needed: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), which keeps the columns, while those not needed go by names that no operator uses."""
    names = docs.columns
    own = [c if c in needed else f"given_{i}" for i, c in enumerate(names)]
    out = work(docs.toDF(*own))
    return out.select(*[F.col(o).alias(n) for o, n in zip(own, names, strict=True)])


def connected_components(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """(a long, b long) edges -> (node, component): the smallest node reachable, for each node on an edge. nodes: about
    how many nodes there are, if known, by which the first table's files are sized.

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014) until the edges form stars. Each step is
    a grouped minimum, combined before its shuffle, and an equi-join that adaptive execution splits where one node
    has many edges. The driver sees only a count and a checksum a round. Empty input gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), nodes)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(a.alias("node"), b.alias("component")).union(now.select(b.alias("node"), b.alias("component")).distinct())
        seen = mark
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a")
        before, now = now, materialize(
            small.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b"))).distinct(),
            mark[0],
        )
        discard(before)
