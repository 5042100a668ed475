"""Sources and sinks: directories of files, object stores on any Hadoop address, the operations log, snapshot bundles."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import digest
from ..functions.scalars import object_id_valid, safe_component
from ..operators.pool import parse_record
from ..operators.sealing import unwrap
from ..operators.tree import counted
from ..tables import LARGE_ROWS, cut

BUNDLE_VERSION = 1
OBJECTS = "object_id string, bytes binary, prefix string"


def scan_directory(spark: SparkSession, path: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(path, size, mtime, content) of all files below a path, read as binary files, without those that match a pattern.
    Contents are read only where the column is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = found.select(F.regexp_replace("path", "^[a-z0-9+.-]+:/*", "/").alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")
    return counted(rows, list(excludes))


def totals(found: DataFrame) -> DataFrame:
    """(files, bytes): what an estimate and the last line of a dry run say."""
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def address(kind: str, root: str, container: str | None = None) -> str:
    """The Hadoop address of a back end: fs, s3, gcs or azblob. Keys, regions and end points are Hadoop settings."""
    if kind == "azblob" and container:
        return f"abfss://{container}@{root}.dfs.core.windows.net"
    schemes = {"fs": "file://", "s3": "s3a://", "gcs": "gs://"}
    if kind not in schemes:
        raise ValueError(f"unknown back end {kind}")
    return schemes[kind] + root


class Store:
    """Objects (object_id, bytes) as Parquet under an address, in folders by the first two digits of the id."""

    def __init__(self, spark: SparkSession, at: str) -> None:
        self.spark, self.at = spark, at.rstrip("/")

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], OBJECTS)
        return self.spark.read.schema(OBJECTS).parquet(self.at)

    def upload(self, objects: DataFrame, only: DataFrame | None = None) -> None:
        """Append what the store lacks, of `only` (object_id) where that is given. Repeating a batch changes nothing.

        Ids that are stored and ids that are asked for are marks beside the batch: its bytes move once, by folder, so that
        a folder gets one file.
        """
        none = F.lit(None).cast("binary").alias("bytes")
        rows = objects.select("object_id", "bytes", F.lit(False).alias("held"), F.lit(only is None).alias("asked"))
        rows = rows.union(self.read().select("object_id", none, F.lit(True), F.lit(False)))
        if only is not None:
            rows = rows.union(only.select("object_id", none, F.lit(False), F.lit(True)))
        rows = rows.withColumn("prefix", F.substring("object_id", 1, 2)).repartition("prefix")
        one = rows.groupBy("prefix", "object_id").agg(F.max("held").alias("held"), F.max("asked").alias("asked"), F.first("bytes", ignorenulls=True).alias("bytes"))
        one.where("asked AND NOT held AND bytes IS NOT NULL").select("object_id", "bytes", "prefix").write.options(**LARGE_ROWS).mode("append").partitionBy("prefix").parquet(self.at)

    def upload_from_cache(self, cached: DataFrame) -> DataFrame:
        """Upload cached objects whose bytes have their id; (object_id) of the others, which are refused."""
        good = digest(F.col("bytes")) == F.col("object_id")
        self.upload(cached.where(good))
        return cached.where(~good).select("object_id")

    def fetch(self, ids: DataFrame) -> DataFrame:
        """ids (object_id) with bytes and status: ok, missing or corrupt, by the digest of the bytes read."""
        held = ids.withColumn("prefix", F.substring("object_id", 1, 2)).join(self.read(), ["object_id", "prefix"], "left")
        status = F.when(F.col("bytes").isNull(), "missing").when(digest(F.col("bytes")) != F.col("object_id"), "corrupt").otherwise("ok")
        return held.select("object_id", F.when(status == "ok", F.col("bytes")).alias("bytes"), status.alias("status"))

    def check(self, ids: DataFrame) -> DataFrame:
        """ids (object_id) with status, as `fetch` has it. Bytes are digested where they are read and do not move."""
        held = self.read().select("object_id", "prefix", (digest(F.col("bytes")) == F.col("object_id")).alias("whole"))
        found = ids.select("object_id", F.substring("object_id", 1, 2).alias("prefix")).join(held, ["object_id", "prefix"], "left")
        return found.select("object_id", F.when(F.col("whole").isNull(), "missing").when(F.col("whole"), "ok").otherwise("corrupt").alias("status"))


def fetch_first(ids: DataFrame, stores: list[Store]) -> DataFrame:
    """ids (object_id) with bytes and source: of the first store, local ones before others, whose copy has the id. Only
    whole copies of what is asked for move, once, and are held against the ids where they lie."""
    wanted, out = ids.select("object_id").distinct(), ids.sparkSession.createDataFrame([], "object_id string, bytes binary, source int")
    for i, store in enumerate(stores):
        whole = store.read().where(digest(F.col("bytes")) == F.col("object_id"))
        out = out.union(whole.join(wanted, "object_id", "left_semi").select("object_id", "bytes", F.lit(i)))
    first = out.groupBy("object_id").agg(F.min_by("bytes", "source").alias("bytes"), F.min("source").alias("source"))
    return ids.select("object_id").join(first, "object_id", "left")


def upload_all(objects: DataFrame, stores: list[Store], attempts: int = 6, wait: Callable[[float], None] = time.sleep) -> list[int]:
    """Upload to all stores, and again only to those that failed, after 2, 4, ... and at most 30 seconds. The numbers of
    stores that failed to the end."""
    left = list(range(len(stores)))
    for attempt in range(attempts):
        failed = []
        for i in left:
            try:
                stores[i].upload(objects)
            except Exception:  # any failure of a back end is retried, and named in the end
                failed.append(i)
        left = failed
        if not left:
            break
        if attempt + 1 < attempts:
            wait(min(30.0, 2.0 ** (attempt + 1)))
    return left


def append_log(spark: SparkSession, path: str, event: dict) -> None:
    """One more line of JSON in the operations log."""
    spark.createDataFrame([(json.dumps(event, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def last_events(lines: DataFrame, schema: str, order: list[Column], keep: int = 5) -> DataFrame:
    """The last lines (value) of a log by order, parsed; those that do not parse are dropped after they were counted."""
    last = lines.orderBy(*order).limit(keep)
    parsed = last.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return parsed.where("e IS NOT NULL AND e._corrupt IS NULL").select("e.*").drop("_corrupt")


def export_bundle(tables: dict[str, DataFrame], objects: DataFrame, path: str) -> None:
    """A bundle: the tables of a snapshot, every object (object_id, bytes) its extents name, and last a manifest."""
    spark = objects.sparkSession
    used = tables["file_chunks"].select("object_id").distinct()
    objects.join(used, "object_id", "left_semi").select("object_id", "bytes").write.parquet(f"{path}/objects")
    for k, t in tables.items():
        t.write.parquet(f"{path}/tables/{k}")
    marks = {k: checksum(spark.read.parquet(f"{path}/tables/{k}")) for k in tables}
    spark.createDataFrame([(json.dumps({"version": BUNDLE_VERSION, "tables": marks}),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def checksum(df: DataFrame) -> str:
    """The number of rows and a sum of row digests, which no order changes."""
    names = sorted(df.columns)
    return "{}:{}".format(*df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*names).cast("decimal(38,0)")), F.lit(0))).first())


def check_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(problem, object_id) of a bundle: version, table, bad id, duplicate id, object hash, missing object. No rows: sound."""
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    if manifest["version"] > BUNDLE_VERSION:
        return spark.createDataFrame([("version", None)], "problem string, object_id string")
    bad = [("table", k) for k, mark in manifest["tables"].items() if checksum(spark.read.parquet(f"{path}/tables/{k}")) != mark]
    out = spark.createDataFrame(bad, "problem string, object_id string")
    objects = spark.read.parquet(f"{path}/objects")
    problem = F.when(~object_id_valid(F.col("object_id")), "bad id").when(digest(F.col("bytes")) != F.col("object_id"), "object hash")
    out = out.union(objects.select(problem.alias("problem"), "object_id").where("problem IS NOT NULL"))
    out = out.union(objects.groupBy("object_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate id"), "object_id"))
    wanted = spark.read.parquet(f"{path}/tables/file_chunks").select("object_id").distinct()
    return out.union(wanted.join(objects, "object_id", "left_anti").select(F.lit("missing object"), "object_id"))


def import_bundle(spark: SparkSession, path: str, store: Store) -> dict[str, DataFrame]:
    """The tables of a bundle, after its objects were published to the store; a bundle with any problem is refused."""
    problems = check_bundle(spark, path).limit(5).collect()
    if problems:
        raise ValueError(f"bundle refused: {[tuple(p) for p in problems]}")
    store.upload(spark.read.parquet(f"{path}/objects"))
    manifest = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    return {k: spark.read.parquet(f"{path}/tables/{k}") for k in manifest["tables"]}


class SharedPool:
    """One namespace of a store that several archives share: objects (object_id, bytes), and records (content_id, object_id,
    record) under the domain's key. Objects are written before the records that name them.

    Of writers at the same time the store's last check decides nothing: give one job the writing, or put the records in a
    table format with transactions."""

    def __init__(self, spark: SparkSession, root: str, namespace: str, key: bytes) -> None:
        if not spark.range(1).select(safe_component(F.lit(namespace))).first()[0]:
            raise ValueError(f"not a namespace: {namespace!r}")
        self.spark, self.key = spark, key
        self.objects = Store(spark, f"{root.rstrip('/')}/{namespace}/objects")
        self.at = f"{root.rstrip('/')}/{namespace}/records"

    def records(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], "content_id string, object_id string, record binary")
        return self.spark.read.parquet(self.at)

    def put(self, objects: DataFrame, only: DataFrame | None = None) -> None:
        """Store objects (object_id, bytes), those of `only` (object_id) where that is given. An id that is no digest, and
        an object that is there with other bytes, raise."""
        ids = (objects if only is None else only).select("object_id").distinct()
        got = self.objects.check(ids)
        bad = ids.where(~object_id_valid(F.col("object_id"))).union(got.where("status = 'corrupt'").select("object_id")).first()
        if bad is not None:
            raise ValueError(f"object {bad.object_id} is no digest, or is stored with other bytes")
        self.objects.upload(objects, only)

    def checked(self, wanted: DataFrame) -> DataFrame:
        """wanted (content_id) with object_id, plaintext_hash and status: absent, bad record, missing, corrupt or ok."""
        r = wanted.select("content_id").join(self.records(), "content_id", "left").withColumn("r", parse_record(unwrap(F.col("record"), self.key)))
        got = self.objects.check(r.where("object_id IS NOT NULL").select("object_id").distinct()).select("object_id", F.col("status").alias("held"))
        early = F.when(F.col("object_id").isNull(), "absent").when(F.col("r").isNull() | (F.col("r.object_id") != F.col("object_id")), "bad record")
        return r.join(got, "object_id", "left").select("content_id", "object_id", F.col("r.plaintext_hash").alias("plaintext_hash"), F.coalesce(early, "held").alias("status"))

    def publish(self, offers: DataFrame, objects: DataFrame | None = None) -> DataFrame:
        """(content_id, archive, object_id, outcome) of offers (content_id, archive, seq, object_id, bytes, record,
        plaintext_hash). Where the bytes come apart, once an object, as objects (object_id, bytes), offers have none.

        A content that the pool has is adopted if its record opens, its object is whole and the plaintext is the same,
        else refused. Of several offers of a new content the first is published and the others adopt it by the same rule.
        Who is first is decided without the bytes, which move once, into the store.
        """
        offers = cut(offers)
        fresh = offers.join(self.records().select("content_id"), "content_id", "left_anti")
        own = F.lit(None).cast("string") if objects is not None else digest(F.col("bytes"))
        fresh = fresh.withColumn("own", own)
        first = fresh.groupBy("content_id").agg(F.min(F.struct("seq", "archive", "object_id", "own", "record")).alias("f"))
        first = cut(first.select("content_id", "f.*"))
        if objects is None:
            self.put(fresh.join(first, ["content_id", "archive", "seq", "object_id", "own"], "left_semi").select("object_id", "bytes"))
        else:
            self.put(objects, first)
            lost = first.join(self.objects.read().select("object_id"), "object_id", "left_anti").first()
            if lost is not None:
                raise ValueError(f"object {lost.object_id} is offered without bytes")
        first.select("content_id", "object_id", "record").write.mode("append").parquet(self.at)
        won = first.select("content_id", "archive", "seq", F.lit(True).alias("won"))
        held = self.checked(offers.select("content_id").distinct()).withColumnsRenamed({"object_id": "pooled", "plaintext_hash": "p"})
        both = offers.select("content_id", "archive", "seq", "plaintext_hash").join(held, "content_id").join(won, ["content_id", "archive", "seq"], "left")
        same = (F.col("status") == "ok") & (F.col("p") == F.col("plaintext_hash"))
        outcome = F.when(~F.coalesce(same, F.lit(False)), "refused").when(F.col("won"), "published").otherwise("adopted")
        return cut(both.select("content_id", "archive", F.when(outcome != "refused", F.col("pooled")).alias("object_id"), outcome.alias("outcome")))
