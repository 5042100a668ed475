"""Archive tables made of the driver's tables, and table-shaped sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digests import bucket_of, digest

ROOT, FILE_BASE, DIR_MODE, FILE_MODE, INLINE_MAX = 1, 1 << 20, 16877, 33188, 4096
NOW = 1_700_000_000
#: A version's files: dropped, edited and re-moded by doc_id mod 10.
DROPPED, EDITED, REMODED = 0, 1, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dir_id(path: Column) -> Column:
    """Directories are numbered by a digest of their path, above all file ids; the root is 1."""
    return F.when(path == "", ROOT).otherwise((1 << 61) + F.conv(F.substring(F.sha2(path, 256), 1, 14), 16, 10).cast("long"))


def files(docs: DataFrame, version: int = 1) -> DataFrame:
    """(inode, path, mode, size, object_id, mtime, content) of documents as files; version 2 has changes."""
    text, mode = F.coalesce(F.col("text"), F.lit("")), F.lit(FILE_MODE)
    if version == 2:
        docs = docs.where(F.col("doc_id") % 10 != DROPPED)
        text = F.when(F.col("doc_id") % 10 == EDITED, F.concat(text, F.lit(" edited"))).otherwise(text)
        mode = F.when(F.col("doc_id") % 10 == REMODED, FILE_MODE - 36).otherwise(FILE_MODE)
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        (F.col("doc_id") + FILE_BASE).alias("inode"), path.alias("path"), mode.cast("long").alias("mode"), F.octet_length(text).cast("long").alias("size"),
        digest(text).alias("object_id"), (NOW - F.col("doc_id") * 60).alias("mtime"), text.alias("content"),
    )


def page_files(pages: DataFrame) -> DataFrame:
    """Pages as the files that version 2 adds."""
    html = F.coalesce(F.col("html"), F.lit(""))
    path = F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return pages.select(
        (F.col("page_id") + 2 * FILE_BASE * 1024).alias("inode"), path.alias("path"), F.lit(FILE_MODE).cast("long").alias("mode"), F.octet_length(html).cast("long").alias("size"),
        digest(html).alias("object_id"), F.lit(NOW).cast("long").alias("mtime"), html.alias("content"),
    )


def tree(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inodes, dentries) of files: directories are derived from paths of any depth."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = found.select(F.explode(above).alias("dir")).distinct()
    nodes = found.select(F.col("inode").alias("id"), "mode", "size", "mtime", F.col("object_id").alias("file_digest"))
    nodes = nodes.unionByName(dirs.select(dir_id(F.col("dir")).alias("id"), F.lit(DIR_MODE).cast("long").alias("mode"), F.lit(4096).cast("long").alias("size"), F.lit(NOW).cast("long").alias("mtime"), F.lit(None).cast("string").alias("file_digest")))
    up, last = lambda p: F.regexp_extract(p, "^(.*)/[^/]*$", 1), lambda p: F.regexp_extract(p, "([^/]*)$", 1)
    edges = found.select(dir_id(up(F.col("path"))).alias("parent_inode"), last(F.col("path")).alias("name"), F.col("inode").alias("inode_id"))
    return nodes, edges.unionByName(dirs.where("dir <> ''").select(dir_id(up(F.col("dir"))).alias("parent_inode"), last(F.col("dir")).alias("name"), dir_id(F.col("dir")).alias("inode_id")))


def file_chunks(found: DataFrame) -> DataFrame:
    """Extents of files over the inline limit, one a file."""
    return found.where(F.col("size") > INLINE_MAX).select("inode", F.lit(0).cast("long").alias("offset"), "object_id", F.col("size").alias("plain_len"))


def chunk_index(docs: DataFrame) -> DataFrame:
    """(object_id, size, created_at): every distinct content; created when its first file was."""
    return files(docs).groupBy("object_id").agg(F.first("size").alias("size"), F.min("mtime").alias("created_at"))


def extents(lineitem: DataFrame) -> DataFrame:
    """(inode, offset, object_id, plain_len): an order's lines as contiguous extents of one file."""
    length = F.col("l_quantity").cast("long")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").rowsBetween(Window.unboundedPreceding, -1)
    return lineitem.select(F.col("l_orderkey").alias("inode"), F.coalesce(F.sum(length).over(w), F.lit(0)).alias("offset"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("object_id"), length.alias("plain_len"))


def snapshots(orders: DataFrame) -> DataFrame:
    """(archive, id, timestamp, protected): each customer is an archive, each order date one of its snapshots."""
    dates = orders.select(F.col("o_custkey").alias("archive"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp")).distinct()
    w = Window.partitionBy("archive").orderBy("timestamp")
    return dates.withColumn("id", F.row_number().over(w).cast("long")).select("archive", "id", "timestamp", (F.col("id") % 17 == 0).alias("protected"))


def replicas(docs: DataFrame, backends: int = 4) -> DataFrame:
    """(object_id, backend, bytes): stored copies, some missing, some with other bytes than their id says."""
    held = files(docs).groupBy("object_id").agg(F.first("content").alias("content"))
    ids = held.select("object_id", "content", F.explode(F.sequence(F.lit(0), F.lit(backends - 1))).alias("backend"))
    roll = bucket_of(F.concat("object_id", F.lit("@"), F.col("backend").cast("string")), 11)
    damaged = F.when(F.col("roll") == 1, F.concat(F.col("content"), F.lit(" damaged"))).otherwise(F.col("content"))
    return ids.withColumn("roll", roll).where("roll <> 0").select("object_id", "backend", damaged.cast("binary").alias("bytes"))
