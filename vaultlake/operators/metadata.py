"""Lookups in the metadata tables, and changes of them. A change takes tables and gives new ones; a batch of requests is
one table, so that a lookup or change is a join whatever their number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import file_type
from ..tables import cut, number
from .relational import orphans
from .tree import climb

MAX_XATTRS, MAX_LINKS = 1024, (1 << 32) - 2


def get_inodes(inodes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) with the inode's columns, null where there is none; a digest that has not 64 hex digits counts as none."""
    return ids.join(inodes, "id", "left").withColumn("file_digest", F.when(F.length("file_digest") == 64, F.col("file_digest")))


def dentry_inodes(dentries: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (parent_inode, name) with inode_id, null where there is no such entry."""
    return requests.join(dentries.select("parent_inode", "name", "inode_id"), ["parent_inode", "name"], "left")


def placed(dentries: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) with their smallest parent_inode, 1 without any, and their smallest name, empty without any."""
    held = dentries.groupBy(F.col("inode_id").alias("id")).agg(F.min("parent_inode").alias("p"), F.min("name").alias("n"))
    return ids.join(held, "id", "left").select("id", F.coalesce("p", F.lit(1)).cast("long").alias("parent_inode"), F.coalesce("n", F.lit("")).alias("name"))


def inodes_using(extents: DataFrame, objects: DataFrame) -> DataFrame:
    """(object_id, inode), distinct, of the objects asked for."""
    return extents.join(objects.select("object_id"), "object_id", "left_semi").select("object_id", "inode").distinct()


def object_flags(index: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (object_id) with present, and domain: the index's flag, false where there is no row."""
    held = index.select("object_id", F.lit(True).alias("p"), F.col("domain").alias("d"))
    return ids.join(held, "object_id", "left").select("object_id", F.coalesce("p", F.lit(False)).alias("present"), F.coalesce("d", F.lit(False)).alias("domain"))


def by_content(index: DataFrame, content: DataFrame) -> DataFrame:
    """content (plaintext_hash) with object_id, the smallest of several, null where the content is new."""
    first = index.groupBy("plaintext_hash").agg(F.min("object_id").alias("object_id"))
    return content.join(first, "plaintext_hash", "left")


def with_links(inodes: DataFrame, dentries: DataFrame) -> DataFrame:
    """inodes with nlink: 2 for a directory, else the number of names."""
    n = dentries.groupBy(F.col("inode_id").alias("id")).agg(F.count("*").alias("n"))
    return inodes.join(n, "id", "left").withColumn("nlink", F.when(_is_dir(), 2).otherwise(F.coalesce("n", F.lit(0))).cast("long")).drop("n")


def _is_dir(mode: str = "mode") -> Column:
    return file_type(F.col(mode)) == "directory"


def insert_nodes(inodes: DataFrame, dentries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inodes, dentries) with new nodes (parent_inode, name, and columns of inodes but id). Ids go on from the largest, in
    order of parent and name. A name that is taken, or given twice, raises when the result is read."""
    last = inodes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = number(new, "parent_inode", "name", name="n__").withColumn("id", F.col("n__") + F.lit(last + 1))
    edges = dentries.unionByName(fresh.select("parent_inode", "name", F.col("id").alias("inode_id")))
    return inodes.unionByName(fresh.select(*inodes.columns)), unique(edges, ["parent_inode", "name"])


def unique(table: DataFrame, keys: list[str]) -> DataFrame:
    """table, which raises when it is read if a key occurs twice."""
    others = [c for c in table.columns if c not in keys]
    one = table.groupBy(*keys).agg(F.count("*").alias("n__"), *[F.first(c).alias(c) for c in others])
    checked = F.when(F.col("n__") == 1, F.col(others[0])).otherwise(F.raise_error(F.lit("a key occurs twice")).cast(table.schema[others[0]].dataType))
    return one.withColumn(others[0], checked).select(*table.columns)


def link(inodes: DataFrame, dentries: DataFrame, names: DataFrame) -> DataFrame:
    """dentries with further names (parent_inode, name, inode_id) of files. Directories, unknown inodes and inodes with
    too many names raise when the result is read."""
    known = with_links(inodes, dentries).select(F.col("id").alias("inode_id"), "mode", "nlink")
    asked = names.join(known, "inode_id", "left")
    wrong = F.when(F.col("mode").isNull(), "no such inode").when(_is_dir(), "a directory").when(F.col("nlink") >= MAX_LINKS, "too many links")
    good = asked.withColumn("inode_id", F.when(wrong.isNull(), F.col("inode_id")).otherwise(F.raise_error(wrong).cast("long")))
    return unique(dentries.unionByName(good.select(*dentries.columns)), ["parent_inode", "name"])


def unlink(tables: dict[str, DataFrame], requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, outcomes) after names (parent_inode, name, only_empty) are taken away.

    tables: inodes, dentries, and any tables with a column inode, whose rows go with their inode. A directory goes with all
    below it, unless it has children and only_empty is set. An inode dies with its last name. outcomes: (parent_inode,
    name, inode_id, nlink, status), status removed, missing or not_empty, nlink the names that are left.
    """
    edges = tables["dentries"]
    kind = tables["inodes"].select(F.col("id").alias("inode_id"), _is_dir().alias("dir"))
    full = edges.select(F.col("parent_inode").alias("inode_id")).distinct().withColumn("full", F.lit(True))
    asked = cut(dentry_inodes(edges, requests).join(kind, "inode_id", "left").join(full, "inode_id", "left"))
    status = F.when(F.col("inode_id").isNull(), "missing").when(F.col("dir") & F.col("only_empty") & F.col("full"), "not_empty").otherwise("removed")
    asked = asked.withColumn("status", status)
    gone = asked.where("status = 'removed'")
    level, dirs = cut(gone.where("dir").select(F.col("inode_id").alias("d")).distinct()), []
    while not level.isEmpty():
        dirs.append(level)
        below = edges.join(level, F.col("parent_inode") == F.col("d")).join(kind.where("dir").select(F.col("inode_id").alias("k")), F.col("inode_id") == F.col("k"), "left_semi")
        level = cut(below.select(F.col("inode_id").alias("d")).distinct().join(reduce(DataFrame.union, dirs), "d", "left_anti"))
    left = edges.join(gone.select("parent_inode", "name"), ["parent_inode", "name"], "left_anti")
    if dirs:
        left = left.join(reduce(DataFrame.union, dirs).select(F.col("d").alias("parent_inode")), "parent_inode", "left_anti")
    left = cut(left.select(*edges.columns))
    dead = cut(edges.select("inode_id").distinct().join(left.select("inode_id"), "inode_id", "left_anti"))
    out = {"dentries": left, "inodes": tables["inodes"].join(dead, F.col("id") == F.col("inode_id"), "left_anti")}
    out |= {k: t.join(dead, F.col("inode") == F.col("inode_id"), "left_anti") for k, t in tables.items() if k not in out}
    names = left.groupBy("inode_id").agg(F.count("*").alias("nlink"))
    outcomes = asked.join(names, "inode_id", "left").select("parent_inode", "name", "inode_id", F.when(F.col("inode_id").isNotNull(), F.coalesce("nlink", F.lit(0))).alias("nlink"), "status")
    return out, outcomes


def rename(tables: dict[str, DataFrame], source: tuple[int, str], target: tuple[int, str]) -> tuple[dict[str, DataFrame], str]:
    """(tables, status) after one name (parent, name) became another: renamed, missing, cycle, not_directory,
    is_directory or not_empty. What stood under the target's name loses that name."""
    edges, inodes = tables["dentries"], tables["inodes"]
    at = lambda p: (F.col("parent_inode") == p[0]) & (F.col("name") == p[1])
    kind = inodes.select(F.col("id").alias("inode_id"), _is_dir().alias("dir"))
    old = edges.where(at(source)).join(kind, "inode_id").first()
    if old is None:
        return tables, "missing"
    if source == target:
        return tables, "renamed"
    if old.dir:
        start = edges.sparkSession.range(1).select(F.lit(target[0]).cast("long").alias("start"))
        if not climb(edges, start).where(F.col("ancestor") == old.inode_id).isEmpty():
            return tables, "cycle"
    there = edges.where(at(target)).join(kind, "inode_id").first()
    if there is not None:
        if there.inode_id == old.inode_id:
            return tables, "renamed"
        if there.dir != old.dir:
            return tables, "is_directory" if there.dir else "not_directory"
        request = edges.where(at(target)).select("parent_inode", "name", F.lit(True).alias("only_empty"))
        tables, outcome = unlink(tables, request)
        if outcome.first().status != "removed":
            return tables, "not_empty"
        edges = tables["dentries"]
    moved = edges.withColumns({"parent_inode": F.when(at(source), F.lit(target[0]).cast("long")).otherwise(F.col("parent_inode")), "name": F.when(at(source), F.lit(target[1])).otherwise(F.col("name"))})
    return tables | {"dentries": moved}, "renamed"


def update(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the columns that changes holds besides keys, where these are not null: attributes, sizes, times, digests
    and flags are all set like this."""
    new = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"{c}__") for c in new])
    return table.join(renamed, keys, "left").select(*[F.coalesce(f"{c}__", c).alias(c) if c in new else F.col(c) for c in table.columns])


def set_inline(inodes: DataFrame, extents: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inodes, extents) after inline contents (id, data): empty data is none, the size follows, and extents go."""
    new = data.select("id", F.when(F.octet_length("data") > 0, F.col("data")).alias("inline_new"), F.octet_length("data").cast("long").alias("size_new"))
    out = inodes.join(new, "id", "left").withColumns({"inline_data": F.when(F.col("size_new").isNull(), F.col("inline_data")).otherwise(F.col("inline_new")), "size": F.coalesce("size_new", "size")})
    return out.select(*inodes.columns), remove(extents, data.select(F.col("id").alias("inode")), ["inode"])


def remove(table: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """table without the rows that have these keys: extents of an inode, entries, index rows, queued objects, markers."""
    return table.join(keys.select(*names), names, "left_anti")


def set_xattrs(attrs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attrs, outcomes) after requests (inode, name, value, flag) with distinct names for an inode.

    flag create fails where the name is there, replace where it is not, any sets both. An inode has at most MAX_XATTRS;
    of new names beyond, the last in name order fail. outcomes: (inode, name, status), status set, exists, absent or
    too_many.

    Both joins are sorted ones: the planner takes rows made of others by a generator for a table as small as these, and
    would broadcast all attributes.
    """
    held = attrs.select("inode", "name", F.lit(True).alias("there")).hint("merge")
    counts = attrs.groupBy("inode").agg(F.count("*").alias("n")).hint("merge")
    asked = requests.join(held, ["inode", "name"], "left").join(counts, "inode", "left")
    there = F.coalesce("there", F.lit(False))
    early = F.when(there & (F.col("flag") == "create"), "exists").when(~there & (F.col("flag") == "replace"), "absent")
    new = F.when(~there & early.isNull(), 1).otherwise(0)
    upto = F.sum(new).over(Window.partitionBy("inode").orderBy("name").rowsBetween(Window.unboundedPreceding, 0))
    asked = asked.withColumns({"early": early, "new": new}).withColumn("upto", upto)
    status = F.coalesce("early", F.when((F.col("new") == 1) & (F.coalesce("n", F.lit(0)) + F.col("upto") > MAX_XATTRS), "too_many"), F.lit("set"))
    done = asked.withColumn("status", status)
    fresh = done.where("status = 'set'").select(*attrs.columns)
    return remove(attrs, fresh, ["inode", "name"]).unionByName(fresh), done.select("inode", "name", "status")


def fifo(queue: DataFrame) -> DataFrame:
    """The upload queue in the order in which objects came, ties by id."""
    return queue.orderBy("added_at", "object_id")


def add_backends(backends: DataFrame, uris: DataFrame) -> DataFrame:
    """backends (id, uri) with new addresses (uri), each once; ids go on from the largest, in order of addresses."""
    last = backends.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = number(uris.select("uri").distinct().join(backends, "uri", "left_anti"), "uri", name="n")
    return backends.unionByName(fresh.select((F.col("n") + F.lit(last + 1)).alias("id"), "uri"))


def collect_garbage(index: DataFrame, references: DataFrame, frozen: DataFrame, pins: DataFrame, stored: DataFrame, now: int, grace_hours: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, removed, local_orphans): index without what neither the live tables, any snapshot (frozen) nor the queue
    (pins) holds and that is older than the grace period; and stored objects that no table names any more."""
    removed = cut(orphans(index, references, pins, now, grace_hours).join(frozen.select("object_id"), "object_id", "left_anti").select("object_id"))
    left = remove(index, removed, ["object_id"])
    named = reduce(DataFrame.union, (t.select("object_id") for t in (left, references, frozen, pins)))
    return left, removed, stored.select("object_id").distinct().join(named, "object_id", "left_anti")


def wipe(tables: dict[str, DataFrame], root: DataFrame, keep: tuple[str, ...] = ("config",)) -> dict[str, DataFrame]:
    """All tables emptied but those of keep; inodes has the root's row alone."""
    return {k: t if k in keep else root.select(*t.columns) if k == "inodes" else t.limit(0) for k, t in tables.items()}


def delete_inodes(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """tables without the inodes of ids (id) and their rows in every table with a column inode; names stay."""
    gone = ids.select(F.col("id").alias("inode"))
    out = {k: remove(t, gone, ["inode"]) for k, t in tables.items() if "inode" in t.columns}
    return tables | out | {"inodes": remove(tables["inodes"], ids, ["id"])}


def attributes(inodes: DataFrame, dentries: DataFrame) -> DataFrame:
    """(id, size, blocks, kind, perm, nlink, mtime, atime, ctime): blocks of 512 bytes, and one time for all three."""
    rows = with_links(inodes, dentries)
    t = F.col("mtime")
    return rows.select("id", "size", F.ceil(F.col("size") / 512).alias("blocks"), file_type(F.col("mode")).alias("kind"), F.col("mode").bitwiseAND(0o7777).alias("perm"), "nlink", t.alias("mtime"), t.alias("atime"), t.alias("ctime"))


def mark_incomplete(markers: DataFrame, ids: DataFrame) -> DataFrame:
    """markers (inode) and those of ids (id), each once. `remove` takes markers away again."""
    return markers.select("inode").union(ids.select("id")).distinct()


def incomplete(inodes: DataFrame, markers: DataFrame) -> DataFrame:
    """inodes with incomplete: whether a marker says that their last write has not ended."""
    held = markers.select(F.col("inode").alias("id")).distinct().withColumn("m__", F.lit(True))
    return inodes.join(held, "id", "left").withColumn("incomplete", F.coalesce("m__", F.lit(False))).drop("m__")


def queue_length(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count("*").alias("n"))
