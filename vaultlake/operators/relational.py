"""Reads over the metadata tables: sizes, listings, overlaps, orphans, inventories. All declarative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import is_regular
from .placement import hashed


def dedup_stats(found: DataFrame, inline_max: int = 4096) -> DataFrame:
    """One row: logical and inline bytes, references, distinct objects and their bytes, savings in percent.

    One grouping by object combines the copies in each task before the shuffle, so that one very common content is
    a row a task.
    """
    objects = found.groupBy("object_id").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    out = objects.agg(
        F.sum("n").alias("reference_count"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("logical_bytes"), F.count("*").alias("unique_objects"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"), F.coalesce(F.sum(F.when(F.col("size") <= inline_max, F.col("n") * F.col("size"))), F.lit(0)).alias("inline_bytes"),
    )
    saved = F.when(F.col("logical_bytes") > 0, F.greatest(F.lit(0.0), (1 - F.col("unique_bytes") / F.col("logical_bytes")) * 100)).otherwise(0.0)
    return out.withColumn("savings_percent", F.round(saved, 6))


def totals(inodes: DataFrame, extents: DataFrame) -> DataFrame:
    """One row: bytes of all inodes (directories too), their number, referenced and physical bytes, distinct objects."""
    objects = extents.groupBy("object_id").agg(F.max("plain_len").alias("p"), F.sum("plain_len").alias("r"))
    a = inodes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"), F.count("*").alias("inodes"), F.count_if(is_regular(F.col("mode"))).alias("regular_files"))
    b = objects.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("referenced_plain_bytes"), F.coalesce(F.sum("p"), F.lit(0)).alias("physical_bytes"), F.count("*").alias("used_objects"))
    return a.crossJoin(b)  # one row each


def list_page(dentries: DataFrame, inodes: DataFrame, parent: int, after: str = "", limit: int = 1000) -> DataFrame:
    """Children of a directory after a name, in name order: one page of a keyset listing."""
    children = dentries.where((F.col("parent_inode") == parent) & (F.col("name") > after))
    return children.join(inodes, children["inode_id"] == inodes["id"]).select("name", "inode_id", "mode", "size").orderBy("name").limit(limit)


def overlapping(extents: DataFrame, index: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """Extents that meet [start, end), with their index rows; extents without one drop out."""
    hit = (F.col("offset") < end) & (F.col("offset") + F.col("plain_len") > start)
    return extents.where(hit).join(index, "object_id")


def orphans(index: DataFrame, references: DataFrame, pins: DataFrame, now: int, grace_hours: int) -> DataFrame:
    """Indexed objects that nothing references, not queued, and strictly older than the grace period."""
    old = index.where(now - F.col("created_at") > grace_hours * 3600)
    return old.join(references.select("object_id"), "object_id", "left_anti").join(pins.select("object_id"), "object_id", "left_anti")


def used_objects(*versions: DataFrame) -> DataFrame:
    """Distinct objects over the live version and all snapshots."""
    out = versions[0].select("object_id")
    for v in versions[1:]:
        out = out.union(v.select("object_id"))
    return out.distinct()


def inventory(referenced: DataFrame, available: DataFrame, complete: bool = True) -> DataFrame:
    """(object_id, status) of objects available (object_id, bytes): missing, corrupt (the bytes have another id),
    unreferenced if the listing is complete."""
    both = referenced.select("object_id", F.lit(True).alias("wanted")).join(hashed(available).select("object_id", "found_id"), "object_id", "full_outer")
    status = F.when(F.col("found_id").isNull(), "missing").when(F.col("found_id") != F.col("object_id"), "corrupt")
    if complete:
        status = status.when(F.col("wanted").isNull(), "unreferenced")
    return both.select("object_id", status.alias("status")).where("status IS NOT NULL")


def hardlinks(found: DataFrame) -> DataFrame:
    """(object_id, first_path, links): the first path of each content that has several."""
    return found.groupBy("object_id").agg(F.min("path").alias("first_path"), F.count("*").alias("links")).where("links > 1")


def evict(cache: DataFrame, limit: int, part: str = "store") -> DataFrame:
    """What each store's cache drops: the oldest until the rest fits the limit. Ties by id.

    Total minus the running sum of what went before is still over the limit.
    """
    w = Window.partitionBy(part)
    before = F.coalesce(F.sum("size").over(w.orderBy("used_at", "object_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cache.withColumns({"total": F.sum("size").over(w), "before": before}).where(F.col("total") - F.col("before") > limit).drop("total", "before")


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table and those rows whose key it lacks; of rows with one key, the least by all columns."""
    others = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("first")).select(key, "first.*")
    return table.unionByName(first.join(table.select(key), key, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in the place of those with equal keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def set_if_absent(table: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, value) after offers (key, value, seq): what is stored wins, then the first offer."""
    offers = rows.groupBy("key").agg(F.min_by("value", "seq").alias("offer"))
    return table.join(offers, "key", "full_outer").select("key", F.coalesce("value", "offer").alias("value"))


def newest(rows: DataFrame, keep: int, order: list[Column], part: str | None = None) -> DataFrame:
    """The first `keep` rows of each part by order."""
    if part is None:
        return rows.orderBy(*order).limit(keep)
    w = Window.partitionBy(part).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n")


def adopt(offers: DataFrame) -> DataFrame:
    """Shared pool: of all offers of a content in a namespace the first by (seq, archive, object_id) wins and the others
    adopt its object."""
    first = offers.groupBy("ns", "content_id").agg(F.min(F.struct("seq", "archive", "object_id")).alias("first"))
    out = offers.join(first, ["ns", "content_id"])
    won = (F.col("seq") == F.col("first.seq")) & (F.col("archive") == F.col("first.archive")) & (offers["object_id"] == F.col("first.object_id"))
    return out.select("ns", "content_id", "archive", F.col("first.object_id").alias("object_id"), F.when(won, "published").otherwise("adopted").alias("outcome"))


def skip_unchanged(source: DataFrame, archived: DataFrame) -> DataFrame:
    """(path, skip): size, time and digest all equal what is archived."""
    old = archived.select("path", F.col("size").alias("s"), F.col("mtime").alias("t"), F.col("object_id").alias("o"))
    same = F.col("size").eqNullSafe(F.col("s")) & F.col("mtime").eqNullSafe(F.col("t")) & F.col("object_id").eqNullSafe(F.col("o"))
    return source.join(old, "path", "left").select("path", same.alias("skip"))
