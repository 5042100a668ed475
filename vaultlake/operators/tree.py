"""Trees as edge lists: walks, closures, globs, hashes. One join a level; depth is bounded by the guard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import EMPTY_ROOT, leaf_hash
from ..functions.scalars import matches, safe_name, snapshot_kind
from ..shipping import small_batches
from ..tables import cut, number

MAX_DEPTH = 4096


def walk(dentries: DataFrame, root: int = 1) -> DataFrame:
    """(path, inode_id, depth, parent_inode, name) of all below root, level by level, a file under each of its names. A
    node met again on its own path ends that path."""
    edges = cut(dentries.select(F.col("parent_inode").alias("p"), "name", F.col("inode_id").alias("c")))
    level = edges.where(F.col("p") == root).select(F.concat(F.lit("/"), "name").alias("path"), F.col("c").alias("inode_id"), "p", "name", F.array(F.lit(root), F.col("c")).alias("seen"))
    found, depth = [], 1
    while depth <= MAX_DEPTH:
        level = cut(level)
        if level.isEmpty():
            break
        found.append(level.select("path", "inode_id", F.lit(depth).alias("depth"), F.col("p").alias("parent_inode"), "name"))
        above = level.select("path", F.col("inode_id").alias("up"), "seen")
        below = above.join(edges, above["up"] == edges["p"]).where(~F.array_contains("seen", F.col("c")))
        level = below.select(F.concat("path", F.lit("/"), "name").alias("path"), F.col("c").alias("inode_id"), "p", "name", F.array_append("seen", F.col("c")).alias("seen"))
        depth += 1
    else:
        raise ValueError(f"deeper than {MAX_DEPTH} levels")
    if not found:
        return level.select("path", "inode_id", F.lit(0).alias("depth"), F.col("p").alias("parent_inode"), "name")
    return reduce(DataFrame.union, found)


def climb(dentries: DataFrame, start: DataFrame, root: int = 1) -> DataFrame:
    """(start, ancestor, steps) of inodes (start), upwards to root by the smallest parent, a node's own row at 0 steps."""
    edges = cut(dentries.groupBy(F.col("inode_id").alias("c")).agg(F.min("parent_inode").alias("p")))
    level, found = start.select("start", F.col("start").alias("ancestor"), F.lit(0).alias("steps")), []
    for steps in range(MAX_DEPTH + 1):
        level = cut(level)
        if level.isEmpty():
            return reduce(DataFrame.union, found, level)
        found.append(level)
        level = level.where(F.col("ancestor") != root).join(edges, F.col("ancestor") == F.col("c")).select("start", F.col("p").alias("ancestor"), F.lit(steps + 1).alias("steps"))
    raise ValueError(f"deeper than {MAX_DEPTH} levels")


def resolve(walked: DataFrame, requests: DataFrame, root: int = 1) -> DataFrame:
    """(path, inode_id, status) of requested paths: found, missing, or unsafe where a component is . or .. ; the root is /."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    clean = F.concat(F.lit("/"), F.array_join(parts, "/"))
    asked = requests.select("path", clean.alias("clean"), F.forall(parts, safe_name).alias("safe"))
    found = asked.join(walked.select(F.col("path").alias("clean"), "inode_id"), "clean", "left")
    inode = F.when(F.col("safe"), F.when(F.col("clean") == "/", F.lit(root).cast("long")).otherwise(F.col("inode_id")))
    return found.select("path", inode.alias("inode_id"), F.when(~F.col("safe"), "unsafe").when(inode.isNull(), "missing").otherwise("found").alias("status"))


def resolve_links(walked: DataFrame, links: DataFrame, requests: DataFrame, most: int = 40) -> DataFrame:
    """(path, target, status) of requested paths with symbolic links (inode_id, target) followed: found, missing, or loop
    beyond `most` links. An absolute target starts at the root; a relative one is appended to the link's own path."""
    named = cut(walked.join(links, "inode_id", "left").select(F.col("path").alias("at"), F.col("target").alias("to")))
    now, done = cut(requests.select("path", F.col("path").alias("at"))), []
    for _ in range(most + 1):
        # the longest prefix that is a link is where the path turns
        parts = F.split("at", "/")
        heads = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        met = now.select("path", "at", F.posexplode(heads).alias("n", "head")).join(named.where("to IS NOT NULL").withColumnRenamed("at", "head"), "head")
        first = met.groupBy("path").agg(F.min_by(F.struct("head", "to", "at"), "n").alias("f"))
        rest = F.expr("substring(f.at, length(f.head) + 1)")
        turned = F.when(F.col("f.to").startswith("/"), F.concat("f.to", rest)).otherwise(F.concat("f.head", F.lit("/"), "f.to", rest))
        turned = cut(first.select("path", turned.alias("at")))
        done.append(now.join(turned.select("path"), "path", "left_anti"))
        now = turned
        if now.isEmpty():
            break
    ended = reduce(DataFrame.union, done).join(named.select("at", F.lit(True).alias("there")), "at", "left")
    out = ended.select("path", F.when(F.col("there"), F.col("at")).alias("target"), F.when(F.col("there"), "found").otherwise("missing").alias("status"))
    return out.union(now.select("path", F.lit(None).cast("string"), F.lit("loop")))


def subtree(walked: DataFrame, path: str) -> DataFrame:
    """The node at path and all below it."""
    return walked.where((F.col("path") == path) | F.col("path").startswith(path + "/"))


def excluded(found: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, counted, ingested): an estimate drops what matches a pattern, ingest also what is below a match."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit, below = F.lit(False), F.lit(False)
    for p in patterns:
        hit, below = hit | matches(F.col("path"), p), below | _any(above, p)
    return found.select("path", (~hit).alias("counted"), (~below).alias("ingested"))


def counted(found: DataFrame, patterns: list[str]) -> DataFrame:
    """What an estimate counts: the files that match no pattern."""
    return found.where(~reduce(lambda a, b: a | b, (matches(F.col("path"), p) for p in patterns), F.lit(False)))


def _any(paths: Column, pattern: str) -> Column:
    return F.exists(paths, lambda x: matches(x, pattern))


def extract_matching(found: DataFrame, pattern: str) -> DataFrame:
    """Regular files that match; other kinds are restored whether or not they do."""
    return found.where((snapshot_kind(F.col("mode")) != 1) | matches(F.col("path"), pattern))


def creates_cycle(walked: DataFrame, source: str, target_parent: str) -> bool:
    """Renaming source below target_parent would put a directory under itself."""
    return not subtree(walked, source).where(F.col("path") == target_parent).isEmpty()


#: Levels folded at once: a worker holds the 2 ** FOLD leaves below one node.
FOLD = 10
_NODES = "dir long, k int, i long, hash string, left long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dir, left, b, steps, nodes) -> the nodes (dir, k, i, hash, left) of the next levels above block b of a level
    of left nodes. Nodes pair upwards, an odd one with itself, and one alone stays as it is."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            hashes, width, at = [x["hash"] for x in sorted(r["nodes"], key=lambda x: x["i"])], r["left"], r["b"] << FOLD
            for k in range(1, r["steps"] + 1):
                if width > 1:
                    pairs = zip(hashes[::2], [*hashes[1::2], *hashes[-1:]][: (len(hashes) + 1) // 2], strict=True)
                    hashes = [None if x is None or y is None else hashlib.sha256(f"pair|{x}{y}".encode()).hexdigest() for x, y in pairs]
                width, at = (width + 1) // 2, at >> 1
                out += [(r["dir"], k, at + n, x, width) for n, x in enumerate(hashes)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["dir", "k", "i", "hash", "left"])


class Folds:
    """Merkle folds of many ordered lists at once: nodes (dir, k, i, hash, left) of each list's level k from the leaves, at
    0, up to `top`; lists that are shorter end in copies of their root."""

    def __init__(self, leaves: DataFrame, key: str, *order: str) -> None:
        """leaves (key, order columns, hash, more): index is (leaves, dir, i), where i counts a list's leaves from 0 in
        order. Nodes pair upwards, an odd one with itself; a null hash makes all above it null."""
        small_batches(leaves.sparkSession)
        self.index = number(leaves, key, *order, name="at__")
        first = self.index.groupBy(F.col(key).alias("dir")).agg(F.min("at__").alias("first"), F.count("*").alias("n"))
        first = cut(first)
        self.index = self.index.join(first, F.col(key) == F.col("dir")).withColumn("i", F.col("at__") - F.col("first")).drop("at__", "first")
        most = first.agg(F.max("n")).first()[0] or 0
        level, parts = self.index.select("dir", F.lit(0).alias("k"), "i", "hash", F.col("n").alias("left")), []
        self.top, height = 0, max(most - 1, 0).bit_length()
        while True:
            parts.append(level)
            if self.top == height:
                break
            level, steps = level.where(F.col("k") == self.top), min(FOLD, height - self.top)
            blocks = level.groupBy("dir", "left", F.floor(F.col("i") / (1 << FOLD)).alias("b")).agg(F.collect_list(F.struct("i", "hash")).alias("nodes"))
            folded = blocks.select("dir", "left", "b", F.lit(steps).alias("steps"), "nodes").mapInArrow(_fold, _NODES)
            level = cut(folded.withColumn("k", F.col("k") + self.top))
            self.top += steps
        self.nodes = reduce(DataFrame.union, parts)

    def roots(self) -> DataFrame:
        """(dir, root) of each list."""
        return self.nodes.where(F.col("k") == self.top).select("dir", F.col("hash").alias("root"))

    def proofs(self, wanted: DataFrame) -> DataFrame:
        """wanted (dir, i, more) with siblings array<string>, levels int, of each leaf asked for. All siblings come by one
        join of (leaf, level) with the nodes, and are put together once a leaf."""
        out = wanted.join(self.index.groupBy("dir").agg(F.count("*").alias("n")), "dir")
        out = cut(out.withColumn("levels", (F.ceil(F.log2("n") - 1e-12) + 1).cast("int")))
        steps = out.where("levels > 1").select("dir", "i", "n", F.explode(F.sequence(F.lit(0), F.col("levels") - 2)).alias("k")).distinct()
        here, width = F.expr("shiftright(i, k)"), F.expr("shiftright(n - 1, k) + 1")
        other = F.when(here.bitwiseXOR(F.lit(1)) < width, here.bitwiseXOR(F.lit(1))).otherwise(here)
        node = self.nodes.select("dir", "k", F.col("i").alias("other"), "hash")
        met = steps.select("dir", "i", "k", other.alias("other")).join(node, ["dir", "k", "other"])
        found = met.groupBy("dir", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "hash"))), lambda x: x["hash"]).alias("siblings"))
        return out.drop("n").join(found, ["dir", "i"], "left").select(*wanted.columns, "levels", F.coalesce("siblings", F.array().cast("array<string>")).alias("siblings"))


def node_hashes(inodes: DataFrame, dentries: DataFrame, root: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, root): (path, inode_id, parent_inode, name, depth, hash) of every name, and (hash) of the root.

    A directory's content is the Merkle root over its children's hashes in name order; a node's hash binds name, kind,
    mode and content. A null digest or a special file makes all above it null. A file with several names stands under
    each of them. Levels are folded deepest first, each by a few grouped aggregations; no task holds a directory.
    """
    attributes = inodes.select(F.col("id").alias("inode_id"), "mode", "file_digest")
    nodes = cut(walk(dentries, root).join(attributes, "inode_id"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    kind, below, out = snapshot_kind(F.col("mode")), None, []
    for depth in range(deepest, 0, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            own = F.when(kind == 2, F.lit(EMPTY_ROOT)).otherwise(F.col("file_digest"))
        else:
            level = level.join(below, level["inode_id"] == below["dir"], "left")
            own = F.when(kind == 2, F.when(F.col("dir").isNull(), F.lit(EMPTY_ROOT)).otherwise(F.col("root"))).otherwise(F.col("file_digest"))
        hash_ = leaf_hash(F.col("name"), kind, F.col("mode"), F.when(kind.isNotNull(), own))
        level = cut(level.select("path", "inode_id", "parent_inode", "name", "depth", hash_.alias("hash")))
        out.append(level)
        below = cut(Folds(level, "parent_inode", "name").roots())
    if below is None:
        return nodes.withColumn("hash", F.lit(None).cast("string")).drop("mode", "file_digest"), inodes.where(F.col("id") == root).select(F.lit(EMPTY_ROOT).alias("hash"))
    return reduce(DataFrame.union, out), below.where(F.col("dir") == root).select(F.col("root").alias("hash"))


def tree_hashes(inodes: DataFrame, dentries: DataFrame, root: int = 1) -> DataFrame:
    """(inode_id, hash, depth) of every name, the root at depth 0."""
    nodes, top = node_hashes(inodes, dentries, root)
    return top.select(F.lit(root).cast("long").alias("inode_id"), "hash", F.lit(0).alias("depth")).union(nodes.select("inode_id", "hash", "depth"))


def inclusion_proofs(nodes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(path, inode_id, leaf, i, siblings, levels, dir_root): of every node of `node_hashes`, or of those whose path is in
    only (path), the proof within its directory.

    A path is proved by the proofs of its components: each directory's root is the content of the node above.
    """
    folds = Folds(nodes, "parent_inode", "name")
    wanted = folds.index.select("dir", "i", "path", "inode_id", F.col("hash").alias("leaf"))
    if only is not None:
        wanted = wanted.join(only, "path", "left_semi")
    return folds.proofs(cut(wanted)).join(folds.roots(), "dir").select("path", "inode_id", "leaf", "i", "siblings", "levels", F.col("root").alias("dir_root"))
