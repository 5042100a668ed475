"""Scrub, verification and extent algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .placement import hashed


def scrub(extents: DataFrame, stored: DataFrame) -> DataFrame:
    """(object_id, status, files): the bytes of each distinct object (object_id, bytes) are hashed once: verified, corrupt
    or missing, and how many files refer to it."""
    used = extents.groupBy("object_id").agg(F.countDistinct("inode").alias("files"))
    status = F.when(F.col("found_id").isNull(), "missing").when(F.col("found_id") != F.col("object_id"), "corrupt").otherwise("verified")
    return used.join(hashed(stored).select("object_id", "found_id"), "object_id", "left").select("object_id", status.alias("status"), "files")


def verify_files(inodes: DataFrame, extents: DataFrame, scrubbed: DataFrame, incomplete: DataFrame) -> DataFrame:
    """(inode, ok): not marked incomplete; inline files no longer than their size; others have extents unless empty,
    and every object of theirs is verified. Holes are no error."""
    state = extents.join(scrubbed.select("object_id", "status"), "object_id", "left").groupBy("inode").agg(F.bool_and(F.coalesce(F.col("status") == "verified", F.lit(False))).alias("good"))
    out = inodes.join(state, "inode", "left").join(incomplete.select("inode", F.lit(True).alias("marked")), "inode", "left")
    whole = F.when(F.col("inline_len").isNotNull(), F.col("inline_len") <= F.col("size")).otherwise(F.coalesce("good", F.col("size") == 0))
    return out.select("inode", (whole & F.col("marked").isNull()).alias("ok"))


def gaps(extents: DataFrame) -> DataFrame:
    """(inode, offset, plain_len, status) of extents: overlap if it begins before the bytes so far end, gap (zeros) if after."""
    w = Window.partitionBy("inode").orderBy("offset", "plain_len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.max(F.col("offset") + F.col("plain_len")).over(w), F.lit(0))
    status = F.when(F.col("offset") < F.col("end"), "overlap").when(F.col("offset") > F.col("end"), "gap").otherwise("contiguous")
    return extents.withColumn("end", end).select("inode", "offset", "plain_len", status.alias("status"))


def truncate(extents: DataFrame, sizes: DataFrame) -> DataFrame:
    """extents after (inode, new_size): those from the new end on go, the one across it is shortened."""
    cut = F.col("new_size").isNotNull() & (F.col("offset") + F.col("plain_len") > F.col("new_size"))
    out = extents.join(sizes, "inode", "left").where("new_size IS NULL OR offset < new_size")
    return out.withColumn("plain_len", F.when(cut, F.col("new_size") - F.col("offset")).otherwise(F.col("plain_len"))).select(*extents.columns)


def drop_range(extents: DataFrame, start: int, end: int) -> DataFrame:
    """extents without those that begin in [start, end); one that crosses start is shortened to it."""
    crosses = (F.col("offset") < start) & (F.col("offset") + F.col("plain_len") > start)
    return extents.where((F.col("offset") < start) | (F.col("offset") >= end)).withColumn("plain_len", F.when(crosses, start - F.col("offset")).otherwise(F.col("plain_len")))


def replace_range(extents: DataFrame, new: DataFrame, start: int, end: int) -> DataFrame:
    """extents with those that begin in [start, end) replaced by new ones; a key that survives and comes again raises
    when the result is read."""
    left = extents.where((F.col("offset") < start) | (F.col("offset") >= end))
    twice = left.select("inode", "offset", F.lit(True).alias("twice"))
    checked = F.when(F.col("twice").isNull(), F.col("plain_len")).otherwise(F.raise_error(F.lit("an extent is there already")).cast("long"))
    return left.unionByName(new.join(twice, ["inode", "offset"], "left").withColumn("plain_len", checked).select(*extents.columns))


def punch(extents: DataFrame, start: int, end: int) -> DataFrame:
    """extents with [start, end) as a hole: both parts of one that crosses an edge stay, as (skip, plain_len) of its object."""
    rows = extents.select("*", F.lit(0).cast("long").alias("skip"))
    finish = F.col("offset") + F.col("plain_len")
    outside = rows.where((finish <= start) | (F.col("offset") >= end))
    inside = rows.where((finish > start) & (F.col("offset") < end))
    left = inside.where(F.col("offset") < start).withColumn("plain_len", start - F.col("offset"))
    right = inside.where(finish > end).select(*[{"offset": F.lit(end).cast("long"), "plain_len": finish - end, "skip": end - F.col("offset")}.get(c, F.col(c)).alias(c) for c in rows.columns])
    return outside.unionByName(left).unionByName(right)
