"""Snapshots as written versions of the tables: create, list, restore, delete. File state is versioned; control tables
(snapshots, their controls, settings, operations) stay live."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digests import leaf_hash, verify_inclusion
from ..functions.scalars import snapshot_kind
from ..tables import cut
from . import content, versions
from .relational import upsert
from .tree import inclusion_proofs, node_hashes, resolve

CONTROL = ("snapshots", "snapshot_controls", "config", "snapshot_operations")
ARCHIVE_ID, REVISION = "archive_id", "snapshot_history_revision"


def _at(store: str, snapshot_id: int, name: str) -> str:
    return f"{store}/{name}/snapshot_id={snapshot_id}"


def create(tables: dict[str, DataFrame], store: str, name: str, timestamp: int) -> dict[str, DataFrame]:
    """tables with a new row in snapshots (id, name, timestamp, tree_root), after the file state was written to store.

    The root is formed from the written copy, so that it cannot differ from what a restore reads; it is null where a
    digest is missing.
    """
    spark = tables["inodes"].sparkSession
    new = (tables["snapshots"].agg(F.max("id")).first()[0] or 0) + 1
    for k, t in tables.items():
        if k not in CONTROL:
            t.write.parquet(_at(store, new, k))
    frozen = load(spark, store, new, [k for k in tables if k not in CONTROL])
    root = node_hashes(frozen["inodes"], frozen["dentries"])[1].first()
    row = spark.range(1).select(F.lit(new).cast("long").alias("id"), F.lit(name).alias("name"), F.lit(timestamp).cast("long").alias("timestamp"), F.lit(root[0] if root else None).cast("string").alias("tree_root"))
    return tables | {"snapshots": tables["snapshots"].unionByName(row)}


def load(spark: SparkSession, store: str, snapshot_id: int, names: list[str]) -> dict[str, DataFrame]:
    """The file state of one snapshot."""
    return {k: spark.read.parquet(_at(store, snapshot_id, k)) for k in names}


def listed(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("id")


def restore(live: dict[str, DataFrame], store: str, snapshot_id: int) -> dict[str, DataFrame]:
    """live with the file state of a snapshot; control tables stay as they are."""
    spark = live["inodes"].sparkSession
    return load(spark, store, snapshot_id, [k for k in live if k not in CONTROL]) | {k: t for k, t in live.items() if k in CONTROL}


def verify(tables: dict[str, DataFrame], store: str, snapshot_id: int) -> bool:
    """The written copy still has the root that was noted for it."""
    spark = tables["snapshots"].sparkSession
    frozen = load(spark, store, snapshot_id, ["inodes", "dentries"])
    noted = tables["snapshots"].where(F.col("id") == snapshot_id).first()
    found = node_hashes(frozen["inodes"], frozen["dentries"])[1].first()
    return noted is not None and found is not None and found[0] is not None and noted.tree_root == found[0]


def delete(tables: dict[str, DataFrame], store: str, ids: list[int]) -> dict[str, DataFrame]:
    """tables without these snapshots and their controls; their files go first, so that no row names missing files."""
    spark = tables["snapshots"].sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for k in (k for k in tables if k not in CONTROL):
        for i in ids:
            path = spark._jvm.org.apache.hadoop.fs.Path(_at(store, i, k))
            path.getFileSystem(conf).delete(path, True)
    out = tables | {"snapshots": tables["snapshots"].where(~F.col("id").isin(ids))}
    if "snapshot_controls" in tables:
        out["snapshot_controls"] = tables["snapshot_controls"].where(~F.col("snapshot_id").isin(ids))
    return out


def newest(snapshots: DataFrame) -> DataFrame:
    """(archive, id) of each archive's newest snapshot: the one to which a checkpoint is moved after a prune."""
    return snapshots.groupBy("archive").agg(F.max("id").alias("id"))


def used_objects(store: str, spark: SparkSession, ids: list[int]) -> DataFrame:
    """Distinct object_id over the extents of these snapshots."""
    return spark.read.parquet(*[_at(store, i, "file_chunks") for i in ids]).select("object_id").distinct()


def copy(tables: dict[str, DataFrame], at: str) -> dict[str, DataFrame]:
    """The tables written below a path, without the rows of snapshots: a copy that can be opened on its own."""
    for k, t in tables.items():
        (t.limit(0) if k == "snapshots" else t).write.parquet(f"{at}/{k}")
    spark = tables["inodes"].sparkSession
    return {k: spark.read.schema(t.schema).parquet(f"{at}/{k}") for k, t in tables.items()}


def _setting(config: DataFrame, key: str) -> str | None:
    row = config.where(F.col("key") == key).first()
    return row.value if row else None


def _put(tables: dict[str, DataFrame], key: str, value: str) -> dict[str, DataFrame]:
    row = tables["config"].sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"))
    return tables | {"config": upsert(tables["config"], row, ["key"])}


def revision(config: DataFrame) -> int:
    """The number of changes of the history that config (key, value) notes: 0 without any; what is no number raises."""
    value = _setting(config, REVISION)
    if value is not None and not (value.isascii() and value.isdigit()):
        raise ValueError(f"invalid {REVISION}")
    return int(value or 0)


def bump(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return _put(tables, REVISION, str(revision(tables["config"]) + 1))


def history(tables: dict[str, DataFrame], new_id: str | None = None) -> tuple[dict[str, DataFrame], str, int, DataFrame]:
    """(tables, archive id, revision, snapshots by id). The archive id is made on first use, and kept in the tables given
    back; so is a revision of 0."""
    archive, now = _setting(tables["config"], ARCHIVE_ID), revision(tables["config"])
    if archive is None:
        archive = new_id or uuid.uuid4().hex
        tables = _put(tables, ARCHIVE_ID, archive)
    if _setting(tables["config"], REVISION) is None:
        tables = _put(tables, REVISION, "0")
    return tables, archive, now, listed(tables["snapshots"].select("id", "name", "timestamp"))


def controls(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, protected, tags array<string>) of every snapshot; those without a row are not protected and have no tags."""
    held = tables["snapshot_controls"].select(F.col("snapshot_id").alias("id"), "protected", F.from_json("tags_json", "array<string>").alias("tags"))
    return tables["snapshots"].select("id").join(held, "id", "left").select("id", F.coalesce("protected", F.lit(False)).alias("protected"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def set_controls(tables: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """tables after changes (snapshot_id, protected, tags_json) with distinct ids: nulls leave what is there. An unknown id
    raises, and nothing is changed. One batch is one more revision."""
    unknown = changes.join(tables["snapshots"].select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_anti").first()
    if unknown is not None:
        raise ValueError(f"unknown snapshot id {unknown.snapshot_id}")
    old = tables["snapshot_controls"].select("snapshot_id", F.col("protected").alias("p"), F.col("tags_json").alias("t"))
    rows = changes.join(old, "snapshot_id", "left").select("snapshot_id", F.coalesce("protected", "p", F.lit(False)).alias("protected"), F.coalesce("tags_json", "t", F.lit("[]")).alias("tags_json"))
    return bump(tables | {"snapshot_controls": upsert(tables["snapshot_controls"].select(*rows.columns), rows, ["snapshot_id"])})


def apply_plan(tables: dict[str, DataFrame], store: str, archive: str, at_revision: int, ids: list[int], allow_empty: bool = False) -> tuple[dict[str, DataFrame], str]:
    """(tables, outcome) of a deletion plan, by the rules of `versions.check_plans`; all of its snapshots go, or none."""
    spark = tables["snapshots"].sparkSession
    plan = spark.createDataFrame([(0, archive, at_revision, allow_empty, ids)], "plan int, archive string, revision long, allow_empty boolean, ids array<long>")
    own = _setting(tables["config"], ARCHIVE_ID)
    now = spark.createDataFrame([(own, revision(tables["config"]))] if own else [], "archive string, revision long")
    snaps = controls(tables).select(F.lit(own).cast("string").alias("archive"), "id", "protected")
    outcome = versions.check_plans(plan, snaps, now).first().outcome
    return (bump(delete(tables, store, ids)) if outcome == "APPLIED" else tables), outcome


def anchor(checkpoints: DataFrame, archive: object, snapshot_id: int, root: str | None) -> DataFrame:
    """Checkpoints (archive, seq, root) moved to a snapshot whatever was there, as after a prune that was meant."""
    if root is None:
        raise ValueError(f"snapshot {snapshot_id} has no root")
    row = checkpoints.sparkSession.range(1).select(F.lit(archive).alias("archive"), F.lit(snapshot_id).cast("long").alias("seq"), F.lit(root).alias("root"))
    return upsert(checkpoints, row, ["archive"])


def prove(nodes: DataFrame, found: DataFrame, root: str) -> DataFrame:
    """(path, proved) of found (path, name, mode, digest): the file's own leaf, formed from what was read, and every folder
    above it fold up to the root. nodes are those of `node_hashes`.

    One row for each component of a path is joined with its proof, so a path costs as many rows as it has components;
    a name is looked up under the parent that the path names, also where the file has other names.
    """
    parts = F.split("path", "/")
    steps = found.select("path", F.col("name").alias("own"), F.col("mode").alias("own_mode"), "digest", F.posexplode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("n", "step"))
    steps = cut(steps)
    proofs = inclusion_proofs(nodes, steps.select(F.col("step").alias("path")).distinct()).select(F.col("path").alias("step"), "i", "siblings", "levels", "dir_root")
    folders = nodes.select(F.col("path").alias("step"), "name", "mode")
    met = steps.join(proofs, "step").join(folders, "step")
    below = F.lead("dir_root").over(Window.partitionBy("path").orderBy("n"))
    leaf = F.when(below.isNull(), leaf_hash(F.col("own"), snapshot_kind(F.col("own_mode")), F.col("own_mode"), F.col("digest"))).otherwise(leaf_hash(F.col("name"), snapshot_kind(F.col("mode")), F.col("mode"), below))
    met = met.withColumn("leaf", leaf)
    good = verify_inclusion(F.col("leaf"), F.col("i"), F.col("siblings"), F.col("levels"), F.col("dir_root")) & ((F.col("n") > 0) | (F.col("dir_root") == root))
    ok = met.groupBy("path").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("all"), F.count("*").alias("k"))
    return found.select("path").join(ok, "path", "left").select("path", F.coalesce(F.col("all") & (F.col("k") == F.size(parts) - 1), F.lit(False)).alias("proved"))


def restore_paths(frozen: dict[str, DataFrame], objects: DataFrame, root: str, requests: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(path, content, status) of requests (path) from a snapshot's tables and objects (object_id, data). nodes: those that
    `node_hashes` gives for these tables, if they are at hand.

    status: missing, not a file, no digest, digest (bytes or size are not those noted), not proved (the noted digest does
    not fold to root), else ok; content is null unless ok. Only the files asked for are read.
    """
    nodes = node_hashes(frozen["inodes"], frozen["dentries"])[0] if nodes is None else nodes
    nodes = cut(nodes.join(frozen["inodes"].select(F.col("id").alias("inode_id"), "mode"), "inode_id"))
    asked = requests.select("path").distinct()
    clean = F.concat(F.lit("/"), F.array_join(F.filter(F.split("path", "/"), lambda x: x != ""), "/"))
    found = resolve(nodes, asked).withColumn("clean", clean)
    held = frozen["inodes"].select(F.col("id").alias("inode_id"), "mode", "size", "file_digest")
    found = cut(found.join(held, "inode_id", "left").withColumn("file", F.coalesce(snapshot_kind(F.col("mode")) == 1, F.lit(False))))
    wanted = found.where("file").select(F.col("inode_id").alias("inode"), "size").distinct()
    extents = frozen["file_chunks"].join(wanted.select("inode"), "inode", "left_semi")
    read = content.whole(extents, objects, wanted).select(F.col("inode").alias("inode_id"), "content", F.col("status").alias("read"))
    read = cut(found.join(read, "inode_id", "left").withColumn("digest", content.inline_digest(F.col("content"))))  # contents are read once
    same = (F.col("read") == "ok") & (F.col("digest") == F.col("file_digest")) & (F.octet_length("content") == F.col("size"))
    named = read.where("file").select(F.col("clean").alias("path"), F.element_at(F.split("clean", "/"), -1).alias("name"), "mode", F.col("file_digest").alias("digest")).distinct()
    proved = cut(prove(nodes, cut(named), root).withColumnRenamed("path", "clean"))
    out = read.withColumn("same", F.coalesce(same, F.lit(False))).join(proved, "clean", "left")
    status = (
        F.when(F.col("inode_id").isNull(), "missing").when(~F.col("file"), "not a file").when(F.col("file_digest").isNull(), "no digest")
        .when(~F.col("same"), "digest").when(~F.coalesce("proved", F.lit(False)), "not proved").otherwise("ok")
    )
    return out.select("path", F.when(status == "ok", F.col("content")).alias("content"), status.alias("status"))


def restore_from(tables: dict[str, DataFrame], store: str, snapshot_id: int, checkpoint: tuple[int, str] | None, objects: DataFrame, requests: DataFrame) -> DataFrame:
    """`restore_paths` of a written snapshot, against the root noted for it, once a trusted checkpoint (seq, root) says that
    the snapshot is neither older than it nor another; without a checkpoint nothing is restored."""
    spark = tables["snapshots"].sparkSession
    noted = tables["snapshots"].where(F.col("id") == snapshot_id).first()
    if noted is None or noted.tree_root is None:
        raise ValueError(f"snapshot {snapshot_id} is unknown or has no root")
    snap = spark.createDataFrame([(0, snapshot_id, noted.tree_root)], "archive int, id long, root string")
    known = spark.createDataFrame([(0, *checkpoint)] if checkpoint else [], "archive int, seq long, root string")
    status = versions.check_freshness(snap, known).first().status
    if status != "ok":
        raise ValueError(f"snapshot {snapshot_id}: {status}")
    return restore_paths(load(spark, store, snapshot_id, ["inodes", "dentries", "file_chunks"]), objects, noted.tree_root, requests)
