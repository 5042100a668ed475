"""Placement over backends, audit and repair of replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import bucket_of, digest

MODES = ("none", "raid0", "raid1", "raid10", "raid5", "raid6")


def hashed(stored: DataFrame) -> DataFrame:
    """Stored copies (object_id, backend, bytes) with found_id, the digest of their bytes, in the bytes' place."""
    return stored.withColumn("found_id", digest(F.col("bytes"))).drop("bytes")


def default_mode(mode: str | None, n: int) -> str:
    """The mode of a store with n backends: raid0 where several have none; too few for a mode is an error."""
    mode = mode or "none"
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if n < {"raid5": 2, "raid6": 3, "raid10": 2}.get(mode, 1):
        raise ValueError(f"{mode} takes more backends")
    return "raid0" if mode == "none" and n > 1 else mode


def check_topology(noted: int, n: int) -> None:
    """The number of backends is the one the archive was made with; placement hangs on it."""
    if noted != n:
        raise ValueError(f"made for {noted} backends, not {n}")


def targets(object_id: Column, mode: str, n: int) -> Column:
    """array<int> of the backends that hold an object, in order of preference."""
    if n < 1:
        raise ValueError("no backends")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "raid0":
        return F.array(bucket_of(object_id, n).cast("int"))
    if mode == "raid10":
        if n % 2:
            raise ValueError("raid10 takes an even number of backends")
        pair = F.floor(bucket_of(object_id, n) / 2).cast("int")
        return F.array(pair * 2, pair * 2 + 1)
    if mode in ("raid5", "raid6") and n < (2 if mode == "raid5" else 3):
        raise ValueError(f"{mode} takes more backends")
    return F.array(*[F.lit(i) for i in range(n)])


def audit(objects: DataFrame, replicas: DataFrame, mode: str, n: int) -> DataFrame:
    """(object_id, backend, status): verified, missing or corrupt for every copy (object_id, backend, bytes) that should
    be; bytes are hashed."""
    wanted = objects.select("object_id", F.explode(targets(F.col("object_id"), mode, n)).alias("backend"))
    status = F.when(F.col("found_id").isNull(), "missing").when(F.col("found_id") != F.col("object_id"), "corrupt").otherwise("verified")
    return wanted.join(hashed(replicas), ["object_id", "backend"], "left").select("object_id", "backend", status.alias("status"))


def repair_plan(audited: DataFrame) -> DataFrame:
    """(object_id, backend, source): each bad copy and the first backend with a verified one; null: cannot be repaired."""
    source = audited.groupBy("object_id").agg(F.min(F.when(F.col("status") == "verified", F.col("backend"))).alias("source"))
    return audited.where("status <> 'verified'").join(source, "object_id").select("object_id", "backend", "source")


def read_from(audited: DataFrame) -> DataFrame:
    """(object_id, backend, needs_heal) of audited copies: where a read ends, and whether an earlier target was bad."""
    good = audited.groupBy("object_id").agg(F.min(F.when(F.col("status") == "verified", F.col("backend"))).alias("backend"), F.min("backend").alias("first"))
    return good.select("object_id", "backend", (~F.col("backend").eqNullSafe(F.col("first"))).alias("needs_heal"))


def heal(plan: DataFrame, replicas: DataFrame) -> DataFrame:
    """(object_id, backend, bytes): the copies that a repair plan writes, with the bytes of each one's source."""
    source = replicas.select("object_id", F.col("backend").alias("source"), "bytes")
    return plan.join(source, ["object_id", "source"]).select("object_id", "backend", "bytes")
