"""Ingest as a whole: files to chunks, identities, dedup against the index, sealed objects, queue and index rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import extension
from ..tables import cut
from . import chunking, sealing

#: Files of these kinds hold compressed bytes already.
PACKED = ("7z", "avi", "bz2", "gz", "jpeg", "jpg", "lz4", "mkv", "mov", "mp3", "mp4", "ogg", "png", "rar", "webm", "webp", "xz", "zip", "zst")


def worth_a_codec(path: Column, packed: tuple[str, ...] = PACKED) -> Column:
    """The extension, in lower case, is not one of a compressed kind."""
    return ~extension(path).isin(list(packed))


@dataclass
class Ingested:
    """extents (inode, offset, object_id, plain_len); objects (object_id, bytes) and index (object_id, plaintext_hash, record,
    comp_type, size, created_at) of chunks that were new; queue (object_id, added_at)."""

    extents: DataFrame
    objects: DataFrame
    index: DataFrame
    queue: DataFrame


def ingest(files: DataFrame, index: DataFrame, key: bytes, now: int, sizes: tuple[int, int, int] = chunking.SIZES, key_seed: str | None = None) -> Ingested:
    """files (inode, path, content) against index (object_id, plaintext_hash). A batch is deduplicated whole, against the
    index and within itself; a chunk of many files is sealed once. Files of a compressed kind get no codec."""
    chunks = cut(chunking.chunk(files, sizes).join(files.select("inode", worth_a_codec(F.col("path")).alias("codec")), "inode"))
    known = index.groupBy("plaintext_hash").agg(F.min("object_id").alias("object_id"))
    fresh = chunks.groupBy("plaintext_hash").agg(F.first("data").alias("data"), F.max("plain_len").alias("plain_len"), F.bool_or("codec").alias("codec")).join(known, "plaintext_hash", "left_anti")
    packed = sealing.compress(fresh.where("codec").drop("codec")).unionByName(sealing.compress(fresh.where("NOT codec").drop("codec"), min_size=1 << 62))
    sealed = cut(sealing.seal(packed, key, key_seed))  # written before it is used twice: keys are random
    rows = sealed.select("object_id", "plaintext_hash", "record", "comp_type", F.col("plain_len").alias("size"), F.lit(now).cast("long").alias("created_at"))
    ids = known.select("plaintext_hash", "object_id").unionByName(sealed.select("plaintext_hash", "object_id"))
    extents = chunks.select("inode", "offset", "plaintext_hash", "plain_len").join(ids, "plaintext_hash").select("inode", "offset", "object_id", "plain_len")
    return Ingested(extents, sealed.select("object_id", F.col("sealed").alias("bytes")), rows, sealed.select("object_id", F.lit(now).cast("long").alias("added_at")))


def stats(files: DataFrame, done: Ingested) -> DataFrame:
    """One row: files, bytes, chunks, new_chunks, new_bytes, dedup_percent (chunks that were there already)."""
    a = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    b = done.extents.agg(F.count("*").alias("chunks"))
    c = done.index.agg(F.count("*").alias("new_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("new_bytes"))
    percent = F.when(F.col("chunks") > 0, F.round(100 * (F.col("chunks") - F.col("new_chunks")) / F.col("chunks"), 6)).otherwise(0.0)
    return a.crossJoin(b).crossJoin(c).withColumn("dedup_percent", percent)  # one row each


def promote(inodes: DataFrame, extents: DataFrame, wanted: DataFrame, index: DataFrame, key: bytes, now: int) -> tuple[DataFrame, DataFrame, Ingested]:
    """(inodes, extents, ingested) after the inline contents of wanted (id) became chunks at offset 0."""
    rows = inodes.join(wanted.select("id"), "id", "left_semi").where("inline_data IS NOT NULL").select(F.col("id").alias("inode"), F.lit("").alias("path"), F.col("inline_data").alias("content"))
    done = ingest(rows, index, key, now)
    moved = rows.select(F.col("inode").alias("id"), F.lit(True).alias("moved"))
    out = inodes.join(moved, "id", "left").withColumn("inline_data", F.when(F.col("moved").isNull(), F.col("inline_data"))).select(*inodes.columns)
    return out, extents.unionByName(done.extents.select(*extents.columns)), done


def check_settings(cipher: str, codec: str, mode: str, padding: int, grace_hours: int) -> None:
    """The settings of a new archive, by allow-lists and ranges."""
    for name, value, allowed in (("cipher", cipher, ("aes256gcm",)), ("codec", codec, ("none", "zstd")), ("mode", mode, ("none", "raid0", "raid1", "raid10", "raid5", "raid6"))):
        if value not in allowed:
            raise ValueError(f"{name} is one of {', '.join(allowed)}")
    if not 0 <= padding <= 1 << 20 or not 0 <= grace_hours <= 24 * 365:
        raise ValueError("padding or grace out of range")
