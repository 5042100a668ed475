"""The metadata tables themselves kept in object stores: sealed pieces, then a sealed manifest, and the way back.

A table's rows are dealt by their hash to pieces of about ROWS_A_PIECE rows and sorted inside, so equal rows give equal
bytes: a later sync seals and uploads only pieces that have changed. The manifest is written last, so that it never names an
object that is not there.
"""

from __future__ import annotations

import json
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import sealing
from ..operators.sealing import unwrap, wrap
from ..tables import cut, small
from .stores import Store, fetch_first

ROWS_A_PIECE = 4096
#: Times keep their microseconds in the text of a row.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Of a piece's place or id in memory.
ENTRY_BYTES = 128
ENTRY = "table string, piece long, plaintext_hash string, object_id string, record string"


def pieces(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, piece, plaintext_hash, plain_len, data) of all rows; an empty table has none. The number of pieces is a power
    of two, so that it rarely changes."""
    out = []
    for name in sorted(tables):
        t, n = tables[name], 1
        total = t.count()
        while n * ROWS_A_PIECE < total:
            n *= 2
        row = F.to_json(F.struct(*[F.col(f"r.`{c}`") for c in sorted(t.columns)]), JSON)
        dealt = t.select(F.struct(*[F.col(f"`{c}`") for c in t.columns]).alias("r")).select("r", F.pmod(F.xxhash64(row), F.lit(n)).alias("piece"))
        dealt = dealt.repartition("piece")  # rows move as they are, as their texts are longer
        data = F.array_join(F.array_sort(F.collect_list(row)), "\n").cast("binary")
        out.append(dealt.groupBy("piece").agg(data.alias("data")).select(F.lit(name).alias("table"), "piece", F.sha2("data", 256).alias("plaintext_hash"), F.octet_length("data").cast("long").alias("plain_len"), "data"))
    return reduce(DataFrame.union, out)


def versions(store: Store) -> list[int]:
    """The numbers of the store's whole manifests, newest first."""
    spark = store.spark
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store.at}-index")
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), reverse=True)


def manifest(store: Store, version: int, key: bytes) -> tuple[dict[str, StructType], DataFrame] | None:
    """(schemas, entries) of one manifest, null where any of its rows does not open under the key."""
    rows = store.spark.read.schema("head boolean, sealed binary").parquet(f"{store.at}-index/{version}").withColumn("text", unwrap(F.col("sealed"), key).cast("string"))
    if not rows.where("text IS NULL").isEmpty():
        return None
    head = rows.where("head").first()
    if head is None:
        return None
    schemas = {k: StructType.fromJson(v) for k, v in json.loads(head.text).items()}
    return schemas, rows.where("NOT head").select(F.from_json("text", ENTRY).alias("e")).select("e.*").withColumn("record", F.unhex("record"))


def sync(tables: dict[str, DataFrame], stores: list[Store], key: bytes) -> int | None:
    """The number of the new manifest in all stores, or null where all hold these rows already. A store that fails raises
    before it has a manifest, and the next sync begins anew."""
    spark = next(iter(tables.values())).sparkSession
    now, held = cut(pieces(tables), large=True), [versions(s) for s in stores]
    schemas = {k: StructType(sorted(t.schema.fields, key=lambda f: f.name)) for k, t in tables.items()}
    known = None
    if all(held) and len({h[0] for h in held}) == 1:
        opened = manifest(stores[0], held[0][0], key)
        if opened:
            known, marks = opened[1], ["table", "piece", "plaintext_hash"]
            changed = now.select(*marks).exceptAll(known.select(*marks)).union(known.select(*marks).exceptAll(now.select(*marks)))
            if opened[0] == schemas and changed.isEmpty():
                return None
    if known is None:
        known = spark.createDataFrame([], "plaintext_hash string, object_id string, record binary")
    known = known.select("plaintext_hash", "object_id", "record").dropDuplicates(["plaintext_hash"])
    lacked = now.select("table", "piece", "plaintext_hash").join(known, "plaintext_hash", "left_anti")
    one = cut(lacked.groupBy("plaintext_hash").agg(F.min(F.struct("table", "piece")).alias("at")).select("at.*"))  # a few bytes a piece, so that rows stay where they are
    fresh = now.join(small(one, ENTRY_BYTES), ["table", "piece"], "left_semi").drop("table", "piece")
    sealed = cut(sealing.seal(sealing.compress(fresh), key), large=True)  # written before it is used twice: keys are random
    entries = cut(now.select("table", "piece", "plaintext_hash").join(known.unionByName(sealed.select(*known.columns)), "plaintext_hash"))
    for store in stores:
        store.upload(sealed.select("object_id", F.col("sealed").alias("bytes")))
    version = max([h[0] for h in held if h], default=0) + 1
    head = spark.range(1).select(F.lit(True).alias("head"), F.lit(json.dumps({k: json.loads(s.json()) for k, s in schemas.items()})).alias("text"))
    line = F.to_json(F.struct("table", "piece", "plaintext_hash", "object_id", F.hex("record").alias("record")))
    rows = cut(head.union(entries.select(F.lit(False), line)).select("head", wrap(F.col("text").cast("binary"), key).alias("sealed")))
    for store in stores:
        rows.write.parquet(f"{store.at}-index/{version}")
    return version


def restore(spark: SparkSession, stores: list[Store], key: bytes) -> dict[str, DataFrame]:
    """The tables of the newest manifest that opens, of the first store that has one; objects come from whichever store
    holds them whole. A piece that cannot be had raises, and so does the lack of any manifest."""
    for store in stores:
        try:
            opened = next((m for v in versions(store) if (m := manifest(store, v, key))), None)
        except Exception as e:  # a store that cannot be read is named, and the next is asked
            warnings.warn(f"{store.at} cannot be read, the next is tried: {e}", stacklevel=2)
            opened = None
        if opened:
            break
    else:
        raise ValueError("no store has a manifest that opens")
    schemas, entries = opened
    entries = cut(entries)
    got = fetch_first(entries.select("object_id").distinct(), stores).select("object_id", F.col("bytes").alias("sealed"))
    data = cut(sealing.open_sealed(entries.select("object_id", "record").dropDuplicates(["object_id"]).join(got, "object_id"), key), large=True)
    bad = data.where("status <> 'ok'").first()
    if bad is not None:
        raise ValueError(f"piece {bad.object_id}: {bad.status}")
    lines = data.select("object_id", "data").join(small(entries.select("object_id", "table"), ENTRY_BYTES), "object_id").select("table", F.explode(F.split(F.col("data").cast("string"), "\n")).alias("row"))
    return {k: lines.where(F.col("table") == k).select(F.from_json("row", s, JSON).alias("r")).select("r.*") for k, s in schemas.items()}


def backup(tables: dict[str, DataFrame], at: str, stamp: int, keep: int = 3) -> list[str]:
    """Write the tables to {at}.indexbak.{stamp}, and delete all but the newest `keep` copies beside it. The copies that
    are left, newest first."""
    if keep < 1:
        raise ValueError("at least one copy is kept")
    spark = next(iter(tables.values())).sparkSession
    for k, t in tables.items():
        t.write.parquet(f"{at}.indexbak.{stamp}/{k}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}.indexbak.{stamp}")
    fs, prefix = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path.getName()[: -len(str(stamp))]
    names = [s.getPath() for s in fs.listStatus(path.getParent())]
    stamps = {p: p.getName().removeprefix(prefix) for p in names if p.getName().startswith(prefix)}
    copies = sorted((p for p, s in stamps.items() if s.isdigit()), key=lambda p: int(stamps[p]), reverse=True)
    for p in copies[keep:]:
        fs.delete(p, True)
    return [p.getName() for p in copies[:keep]]
