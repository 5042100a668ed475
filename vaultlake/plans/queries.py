"""One query for each archive operator over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests, scalars
from ..operators import chunking, content, erasure, integrity, metadata, placement, pool, relational, sealing, snapshots, tree, versions, writes
from ..tables import cut, shared_dir
from ..sources import archive, index_sync, stores
from ..sources.archive import NOW, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: DuckDB forms of the archive tables.
WITH = """WITH RECURSIVE f AS (SELECT doc_id, doc_id + 1048576 inode, '/' || lang || '/' || source || '/' || doc_id || '.txt' path, 33188::BIGINT mode, strlen(coalesce(text, ''))::BIGINT size,
  sha256(coalesce(text, '')) object_id, 1700000000 - doc_id * 60 mtime, coalesce(text, '') content FROM documents),
f2 AS (SELECT inode, path, CASE WHEN doc_id % 10 = 2 THEN 33152 ELSE 33188 END::BIGINT mode, strlen(t)::BIGINT size, sha256(t) object_id, mtime
  FROM (SELECT *, CASE WHEN doc_id % 10 = 1 THEN content || ' edited' ELSE content END t FROM f WHERE doc_id % 10 <> 0)
  UNION ALL SELECT page_id + 2147483648, '/pages/' || page_id || '.html', 33188, strlen(coalesce(html, '')), sha256(coalesce(html, '')), 1700000000 FROM pages),
c AS (SELECT object_id, any_value(size) size, min(mtime) created_at FROM f GROUP BY object_id),
e AS (SELECT l_orderkey inode, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT "offset", sha256(l_partkey::VARCHAR) object_id, l_quantity::BIGINT plain_len FROM lineitem),
s AS (SELECT archive, timestamp, row_number() OVER (PARTITION BY archive ORDER BY timestamp) id FROM (SELECT DISTINCT o_custkey archive, epoch(o_orderdate)::BIGINT timestamp FROM orders)),
sn AS (SELECT archive, id, timestamp, id % 17 = 0 protected FROM s),
rp AS (SELECT object_id, backend, CASE WHEN roll = 1 THEN sha256(object_id) ELSE object_id END found_id FROM
  (SELECT object_id, b.backend::INTEGER backend, ('0x' || substr(sha256(object_id || '@' || b.backend), 1, 15))::BIGINT % 11 roll FROM (SELECT DISTINCT object_id FROM f), range(4) b(backend)) WHERE roll <> 0),
dirs AS (SELECT DISTINCT unnest(['', '/' || lang, '/' || lang || '/' || source]) dir FROM documents),
dd AS (SELECT dir, CASE WHEN dir = '' THEN 1 ELSE 2305843009213693952 + ('0x' || substr(sha256(dir), 1, 14))::BIGINT END id FROM dirs)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = WITH + sql
        return f

    return put


def _files(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    found = archive.files(table(spark, sf_dir, "documents"), version)
    return found.unionByName(archive.page_files(table(spark, sf_dir, "pages"))) if version == 2 else found


def _extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.extents(table(spark, sf_dir, "lineitem"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.snapshots(table(spark, sf_dir, "orders"))


@query("""SELECT count(*)::BIGINT reference_count, sum(size)::BIGINT logical_bytes, count(DISTINCT object_id)::BIGINT unique_objects, (SELECT sum(size) FROM c)::BIGINT unique_bytes,
coalesce(sum(CASE WHEN size <= 4096 THEN size END), 0)::BIGINT inline_bytes, round(greatest(0.0::DOUBLE, (1 - (SELECT sum(size) FROM c)::DOUBLE / sum(size)) * 100), 6) savings_percent FROM f""")
def dedup_stats(spark, sf_dir):
    return relational.dedup_stats(_files(spark, sf_dir))


@query("SELECT count(*)::BIGINT files, coalesce(sum(size), 0)::BIGINT bytes FROM f WHERE NOT (path LIKE '/fr/%')")
def backup_estimate(spark, sf_dir):
    return tree.counted(_files(spark, sf_dir), ["/fr/**"]).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@query("SELECT path, NOT path LIKE '%/src1/%' counted, NOT path LIKE '%/src1/%' AND NOT path LIKE '/de/%' ingested FROM f")
def exclude_closure(spark, sf_dir):
    return tree.excluded(_files(spark, sf_dir), ["**/src1/*", "/de"])


@query("SELECT path, size FROM f WHERE path LIKE '/en/src1/%.txt' OR path LIKE '/en/src1_/%.txt'")
def extract_glob(spark, sf_dir):
    found = _files(spark, sf_dir)
    return tree.extract_matching(found, "en/src1/*.txt").union(tree.extract_matching(found, "/en/src1?/*.txt")).select("path", "size")


@query("SELECT inode id, size FROM f")
def list_regular_files(spark, sf_dir):
    nodes, _ = archive.tree(_files(spark, sf_dir))
    return nodes.where(scalars.is_regular(F.col("mode"))).select("id", "size")


@query("SELECT * FROM (SELECT doc_id || '.txt' AS name, inode inode_id, mode, size FROM f WHERE path LIKE '/en/src3/%' AND doc_id || '.txt' > '3' ORDER BY name LIMIT 20)")
def readdir_page(spark, sf_dir):
    nodes, edges = archive.tree(_files(spark, sf_dir))
    parent = spark.range(1).select(archive.dir_id(F.lit("/en/src3"))).first()[0]
    return relational.list_page(edges, nodes, parent, "3", 20)


@query("SELECT path, inode inode_id, 3 depth FROM f UNION ALL SELECT dir, id, len(dir) - len(replace(dir, '/', '')) FROM dd WHERE dir <> ''")
def tree_walk(spark, sf_dir):
    _, edges = archive.tree(_files(spark, sf_dir))
    return tree.walk(edges).select("path", "inode_id", "depth")


@query("SELECT path, inode inode_id FROM f WHERE path LIKE '/de/%' UNION ALL SELECT dir, id FROM dd WHERE dir = '/de' OR dir LIKE '/de/%'")
def delete_recursive(spark, sf_dir):
    _, edges = archive.tree(_files(spark, sf_dir))
    return tree.subtree(tree.walk(edges), "/de").select("path", "inode_id")


@query("SELECT (sum(size) + (SELECT count(*) * 4096 FROM dd))::BIGINT logical_bytes, (count(*) + (SELECT count(*) FROM dd))::BIGINT inodes, count(*)::BIGINT regular_files, "
       "(SELECT sum(size) FROM f WHERE size > 4096)::BIGINT referenced_plain_bytes, (SELECT sum(size) FROM c WHERE size > 4096)::BIGINT physical_bytes, (SELECT count(*) FROM c WHERE size > 4096)::BIGINT used_objects FROM f")
def archive_status(spark, sf_dir):
    found = _files(spark, sf_dir)
    nodes, _ = archive.tree(found)
    return relational.totals(nodes, archive.file_chunks(found))


@query("SELECT ceil(sum(size) / 4096.0)::BIGINT blocks, count(*)::BIGINT files FROM f")
def statfs(spark, sf_dir):
    return _files(spark, sf_dir).agg(F.ceil(F.sum("size") / 4096).alias("blocks"), F.count("*").alias("files"))


@query("""SELECT inode, "offset", plain_len, object_id, p.p_size FROM e JOIN (SELECT sha256(p_partkey::VARCHAR) oid, p_size FROM part) p ON e.object_id = p.oid WHERE "offset" < 60 AND "offset" + plain_len > 20""")
def extent_range_join(spark, sf_dir):
    index = table(spark, sf_dir, "part").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("object_id"), "p_size")
    return relational.overlapping(_extents(spark, sf_dir), index, 20, 60).select("inode", "offset", "plain_len", "object_id", "p_size")


@query("SELECT object_id, size FROM c WHERE 1700000000 - created_at > 2 * 3600 AND object_id NOT IN (SELECT object_id FROM f WHERE doc_id % 7 <> 0) AND object_id NOT IN (SELECT object_id FROM f WHERE doc_id % 14 = 0)")
def gc_orphans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return relational.orphans(archive.chunk_index(docs), archive.files(docs.where("doc_id % 7 <> 0")), archive.files(docs.where("doc_id % 14 = 0")), NOW, 2).select("object_id", "size")


@query("SELECT object_id FROM f WHERE doc_id % 7 <> 0 UNION SELECT object_id FROM f2")
def gc_used_set(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return relational.used_objects(archive.files(docs.where("doc_id % 7 <> 0")), _files(spark, sf_dir, 2))


@query("""SELECT coalesce(a.object_id, b.object_id) object_id, CASE WHEN b.object_id IS NULL THEN 'missing' WHEN b.found_id <> b.object_id THEN 'corrupt' ELSE 'unreferenced' END status
FROM (SELECT DISTINCT object_id FROM f WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT * FROM rp WHERE backend = 0) b ON a.object_id = b.object_id
WHERE b.object_id IS NULL OR b.found_id <> b.object_id OR a.object_id IS NULL""")
def archive_inventory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = archive.files(docs.where("doc_id % 7 <> 0")).select("object_id").distinct()
    return relational.inventory(wanted, archive.replicas(docs).where("backend = 0"))


@query("SELECT object_id, min(path) first_path, count(*)::BIGINT links FROM f GROUP BY object_id HAVING count(*) > 1")
def hardlink_groups(spark, sf_dir):
    return relational.hardlinks(_files(spark, sf_dir))


@query("""SELECT store, object_id, size, used_at FROM (SELECT *, sum(size) OVER (PARTITION BY store) - coalesce(sum(size) OVER (PARTITION BY store ORDER BY used_at, object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) rest
FROM (SELECT inode % 16 store, inode::VARCHAR object_id, size, mtime used_at FROM f)) WHERE rest > 50000""")
def cache_eviction(spark, sf_dir):
    cache = _files(spark, sf_dir).select((F.col("inode") % 16).alias("store"), F.col("inode").cast("string").alias("object_id"), "size", F.col("mtime").alias("used_at"))
    return relational.evict(cache, 50_000).select("store", "object_id", "size", "used_at")


@query("SELECT object_id, min(size)::BIGINT size FROM f2 WHERE object_id NOT IN (SELECT object_id FROM c) GROUP BY object_id UNION ALL SELECT object_id, size FROM c")
def chunk_index_insert_or_ignore(spark, sf_dir):
    known = archive.chunk_index(table(spark, sf_dir, "documents")).select("object_id", "size")
    return relational.insert_or_ignore(known, _files(spark, sf_dir, 2).select("object_id", "size"), "object_id")


@query("SELECT path, mode, size FROM f2 UNION ALL SELECT path, mode, size FROM f WHERE path NOT IN (SELECT path FROM f2)")
def entry_upsert(spark, sf_dir):
    return relational.upsert(_files(spark, sf_dir).select("path", "mode", "size"), _files(spark, sf_dir, 2).select("path", "mode", "size"), ["path"])


@query("SELECT user_id::VARCHAR AS key, arg_min(event_type, event_id) AS value FROM events GROUP BY user_id")
def config_first_writer(spark, sf_dir):
    offers = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return relational.set_if_absent(offers.limit(0).select("key", "value"), offers)


@query("""SELECT ns, content_id, archive, first_value(object_id) OVER w object_id, CASE WHEN row_number() OVER w = 1 THEN 'published' ELSE 'adopted' END outcome
FROM (SELECT inode % 3 ns, object_id content_id, inode archive, sha256(inode::VARCHAR) object_id, mtime seq FROM f) WINDOW w AS (PARTITION BY ns, content_id ORDER BY seq, archive)""")
def shared_pool(spark, sf_dir):
    offers = _files(spark, sf_dir).select((F.col("inode") % 3).alias("ns"), F.col("object_id").alias("content_id"), F.col("inode").alias("archive"), F.sha2(F.col("inode").cast("string"), 256).alias("object_id"), F.col("mtime").alias("seq"))
    return relational.adopt(offers)


@query("SELECT f2.path, f.path IS NOT NULL AND f.size = f2.size AND f.mtime = f2.mtime AND f.object_id = f2.object_id skip FROM f2 LEFT JOIN f ON f2.path = f.path")
def incremental_skip(spark, sf_dir):
    return relational.skip_unchanged(_files(spark, sf_dir, 2), _files(spark, sf_dir))


@query("""SELECT coalesce(f.path, f2.path) path, CASE WHEN f.path IS NULL THEN 'added' WHEN f2.path IS NULL THEN 'removed' WHEN f.object_id <> f2.object_id THEN 'content_changed' ELSE 'metadata_changed' END change
FROM f FULL JOIN f2 ON f.path = f2.path WHERE f.path IS NULL OR f2.path IS NULL OR f.object_id <> f2.object_id OR f.mode <> f2.mode OR f.size <> f2.size""")
def diff_snapshots(spark, sf_dir):
    return versions.diff_entries(_files(spark, sf_dir), _files(spark, sf_dir, 2))


@query("""SELECT coalesce(f.path, f2.path) path, CASE WHEN f.path IS NULL THEN 'added' WHEN f2.path IS NULL THEN 'removed' ELSE 'modified' END change
FROM f FULL JOIN f2 ON f.path = f2.path WHERE f.path IS NULL OR f2.path IS NULL OR f.object_id <> f2.object_id""")
def diff_paths(spark, sf_dir):
    return versions.diff_paths(_files(spark, sf_dir), _files(spark, sf_dir, 2))


@query("""SELECT archive, id, timestamp, protected, protected OR (d = 1 AND dd_ <= 7) OR (w = 1 AND ww <= 4) OR (m = 1 AND mm <= 12) OR (y = 1 AND yy <= 3) kept FROM (SELECT *,
row_number() OVER (PARTITION BY archive, pd ORDER BY timestamp DESC, id) d, dense_rank() OVER (PARTITION BY archive ORDER BY pd DESC) dd_, row_number() OVER (PARTITION BY archive, pw ORDER BY timestamp DESC, id) w,
dense_rank() OVER (PARTITION BY archive ORDER BY pw DESC) ww, row_number() OVER (PARTITION BY archive, pm ORDER BY timestamp DESC, id) m, dense_rank() OVER (PARTITION BY archive ORDER BY pm DESC) mm,
row_number() OVER (PARTITION BY archive, py ORDER BY timestamp DESC, id) y, dense_rank() OVER (PARTITION BY archive ORDER BY py DESC) yy FROM (SELECT *, strftime(t, '%Y-%m-%d') pd, strftime(t, '%G-%V') pw,
strftime(t, '%Y-%m') pm, strftime(t, '%Y') py FROM (SELECT *, make_timestamp(timestamp * 1000000) t FROM sn)))""")
def prune_gfs(spark, sf_dir):
    return versions.retention(_snapshots(spark, sf_dir), daily=7, weekly=4, monthly=12, yearly=3)


@query("SELECT archive, id, timestamp, protected, row_number() OVER (PARTITION BY archive ORDER BY timestamp DESC, id DESC) <= 5 kept FROM sn")
def prune_newest(spark, sf_dir):
    return versions.keep_newest(_snapshots(spark, sf_dir), 5)


@query("""SELECT archive plan, CASE WHEN archive % 11 = 0 THEN 'NOOP' WHEN archive % 13 = 0 THEN 'DUPLICATE_ID' WHEN archive % 7 = 0 THEN 'WRONG_ARCHIVE' WHEN archive % 5 = 0 THEN 'STALE_HISTORY'
WHEN n <= 2 THEN 'EMPTY_HISTORY_FORBIDDEN' WHEN archive % 3 = 0 AND archive % 2 = 0 THEN 'UNKNOWN_SNAPSHOT' WHEN n >= 17 AND archive % 3 = 0 THEN 'SNAPSHOT_PROTECTED' WHEN archive % 3 = 0 THEN 'UNKNOWN_SNAPSHOT' ELSE 'APPLIED' END outcome
FROM (SELECT archive, count(*) n FROM sn GROUP BY archive)""")
def delete_plan(spark, sf_dir):
    snaps = _snapshots(spark, sf_dir)
    a = F.col("archive")
    archives = snaps.select("archive").distinct()
    ids = F.when(a % 11 == 0, F.array().cast("array<long>")).when(a % 13 == 0, F.array(F.lit(1), F.lit(1))).when((a % 3 == 0) & (a % 2 == 0), F.array(F.lit(17), F.lit(-1))).when(a % 3 == 0, F.array(F.lit(17), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    plans = archives.select(a.alias("plan"), "archive", F.lit(4).alias("revision"), F.lit(False).alias("allow_empty"), ids.cast("array<long>").alias("ids"))
    now = archives.where(a % 7 != 0).select("archive", F.when(a % 5 == 0, 5).otherwise(4).alias("revision"))
    return versions.check_plans(plans, snaps, now)


@query("""SELECT archive, id, CASE WHEN archive % 4 = 0 THEN 'no_checkpoint' WHEN id < 3 THEN 'rolled_back' WHEN id = 3 AND archive % 3 = 0 THEN 'tampered' ELSE 'ok' END status FROM sn""")
def checkpoint_status(spark, sf_dir):
    snaps = _snapshots(spark, sf_dir).withColumn("root", F.sha2(F.concat_ws("/", "archive", "id"), 256))
    known = snaps.where("id = 3 AND archive % 4 <> 0").select("archive", F.col("id").alias("seq"), F.when(F.col("archive") % 3 == 0, F.lit("other")).otherwise(F.col("root")).alias("root"))
    missing = snaps.select("archive").distinct().where("archive % 4 <> 0").join(known, "archive", "left_anti").select("archive", F.lit(3).cast("long").alias("seq"), F.lit("x").alias("root"))
    return versions.check_freshness(snaps, known.unionByName(missing))


@query("""SELECT inode, "offset" + CASE WHEN inode % 3 = 0 THEN 5 WHEN inode % 3 = 1 AND "offset" > 0 THEN -1 ELSE 0 END "offset", plain_len,
CASE WHEN inode % 3 = 0 AND "offset" = 0 THEN 'gap' WHEN inode % 3 = 1 AND "offset" = mo THEN 'contiguous' WHEN inode % 3 = 1 AND nth2 THEN 'overlap' ELSE 'contiguous' END status
FROM (SELECT *, min("offset") OVER (PARTITION BY inode) mo, row_number() OVER (PARTITION BY inode ORDER BY "offset") = 2 nth2 FROM e)""")
def extent_gaps(spark, sf_dir):
    m = F.col("inode") % 3
    moved = F.col("offset") + F.when(m == 0, 5).when((m == 1) & (F.col("offset") > 0), -1).otherwise(0)
    return integrity.gaps(_extents(spark, sf_dir).withColumn("offset", moved))


@query("""SELECT inode, "offset", object_id, CASE WHEN inode % 2 = 0 AND "offset" + plain_len > 40 THEN 40 - "offset" ELSE plain_len END plain_len FROM e WHERE inode % 2 = 1 OR "offset" < 40""")
def extent_truncate(spark, sf_dir):
    ext = _extents(spark, sf_dir)
    sizes = ext.select("inode").distinct().where("inode % 2 = 0").withColumn("new_size", F.lit(40).cast("long"))
    return integrity.truncate(ext, sizes)


@query("""SELECT inode, "offset", object_id, CASE WHEN "offset" < 30 AND "offset" + plain_len > 30 THEN 30 - "offset" ELSE plain_len END plain_len FROM e WHERE "offset" < 30 OR "offset" >= 70""")
def extent_drop_range(spark, sf_dir):
    return integrity.drop_range(_extents(spark, sf_dir), 30, 70)


@query("""SELECT inode, "offset", plain_len, 0::BIGINT skip FROM e WHERE "offset" + plain_len <= 30 OR "offset" >= 70
UNION ALL SELECT inode, "offset", 30 - "offset", 0 FROM e WHERE "offset" + plain_len > 30 AND "offset" < 30
UNION ALL SELECT inode, 70, "offset" + plain_len - 70, 70 - "offset" FROM e WHERE "offset" + plain_len > 70 AND "offset" < 70""")
def extent_punch(spark, sf_dir):
    return integrity.punch(_extents(spark, sf_dir), 30, 70).select("inode", "offset", "plain_len", "skip")


_H = "('0x' || substr(sha256(object_id), 1, 15))::BIGINT % 4"


@query(f"SELECT object_id, ({_H})::INTEGER raid0, (2 * (({_H}) // 2))::INTEGER raid10_a, (2 * (({_H}) // 2) + 1)::INTEGER raid10_b FROM c")
def raid_placement(spark, sf_dir):
    o = F.col("object_id")
    pair = placement.targets(o, "raid10", 4)
    return archive.chunk_index(table(spark, sf_dir, "documents")).select("object_id", placement.targets(o, "raid0", 4)[0].alias("raid0"), pair[0].alias("raid10_a"), pair[1].alias("raid10_b"))


_AUDIT = "au AS (SELECT o.object_id, b.backend::INTEGER backend, CASE WHEN rp.object_id IS NULL THEN 'missing' WHEN found_id <> rp.object_id THEN 'corrupt' ELSE 'verified' END status FROM c o CROSS JOIN range(4) b(backend) LEFT JOIN rp ON rp.object_id = o.object_id AND rp.backend = b.backend)"


def _audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return placement.audit(archive.chunk_index(docs), archive.replicas(docs), "raid1", 4)


@query(f", {_AUDIT} SELECT * FROM au")
def replication_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


@query(f", {_AUDIT} SELECT a.object_id, a.backend, g.source FROM au a LEFT JOIN (SELECT object_id, min(backend) source FROM au WHERE status = 'verified' GROUP BY object_id) g ON a.object_id = g.object_id WHERE a.status <> 'verified'")
def replicate_repair(spark, sf_dir):
    return placement.repair_plan(_audit(spark, sf_dir))


@query(f", {_AUDIT} SELECT object_id, min(CASE WHEN status = 'verified' THEN backend END) backend, coalesce(min(CASE WHEN status = 'verified' THEN backend END), -1) <> 0 needs_heal FROM au GROUP BY object_id")
def replica_read(spark, sf_dir):
    return placement.read_from(_audit(spark, sf_dir))


_SCRUB = "sc AS (SELECT u.object_id, CASE WHEN found_id IS NULL THEN 'missing' WHEN found_id <> u.object_id THEN 'corrupt' ELSE 'verified' END status, files FROM (SELECT object_id, count(DISTINCT inode)::BIGINT files FROM f WHERE size > 4096 GROUP BY object_id) u LEFT JOIN (SELECT * FROM rp WHERE backend = 1) r ON r.object_id = u.object_id)"


def _scrub(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return integrity.scrub(archive.file_chunks(archive.files(docs)), archive.replicas(docs).where("backend = 1"))


@query(f", {_SCRUB} SELECT * FROM sc")
def scrub(spark, sf_dir):
    return _scrub(spark, sf_dir)


@query(f", {_SCRUB} SELECT inode, doc_id % 50 <> 0 AND (f.size <= 4096 OR coalesce(status = 'verified', false)) ok FROM f LEFT JOIN sc ON f.object_id = sc.object_id")
def verify_all(spark, sf_dir):
    found = _files(spark, sf_dir)
    inodes = found.select("inode", "size", F.when(F.col("size") <= archive.INLINE_MAX, F.col("size")).alias("inline_len"))
    marked = found.where((F.col("inode") - archive.FILE_BASE) % 50 == 0).select("inode")
    return integrity.verify_files(inodes, archive.file_chunks(found), _scrub(spark, sf_dir), marked)


@query("SELECT path, sha256('entry|1|' || mode || '|' || size || '|' || strlen(path) || ':' || path || '|' || object_id) AS hash FROM f")
def snapshot_entry_hash(spark, sf_dir):
    return _files(spark, sf_dir).select("path", digests.entry_hash(F.col("path"), F.lit(1), F.col("mode"), F.col("size"), F.col("object_id")).alias("hash"))


def _fold(name: str, leaves: str) -> str:
    """Merkle roots as CTEs: {name}_root (dir, root) over leaves (dir, name, h)."""
    return f"""{name}_l AS (SELECT dir, row_number() OVER (PARTITION BY dir ORDER BY name) - 1 i, count(*) OVER (PARTITION BY dir) n, h FROM ({leaves})),
{name}_t AS (SELECT dir, i, n, h FROM {name}_l UNION ALL SELECT dir, i // 2, (n + 1) // 2, sha256('pair|' || max(CASE WHEN i % 2 = 0 THEN h END) || max(CASE WHEN i % 2 = 1 OR i = n - 1 THEN h END))
  FROM {name}_t WHERE n > 1 GROUP BY dir, i // 2, n), {name}_root AS (SELECT dir, h root FROM {name}_t WHERE n = 1)"""


_NODE = "sha256('node|{kind}|{mode}|' || strlen({name}) || ':' || {name} || '|' || {content})"
_LAST, _UP = "regexp_extract({0}, '([^/]*)$', 1)", "regexp_extract({0}, '^(.*)/[^/]*$', 1)"
#: Every tenth document has a second name in its source's folder.
_TREE = f""", l3 AS (SELECT '/' || lang || '/' || source dir, inode, t.name, {_NODE.format(kind=1, mode=33188, name="t.name", content="object_id")} h FROM (SELECT f.inode, f.object_id, d.lang, d.source, u.name
  FROM f JOIN documents d ON f.doc_id = d.doc_id, unnest(CASE WHEN d.doc_id % 10 = 0 THEN [d.doc_id || '.txt', d.doc_id || '.lnk'] ELSE [d.doc_id || '.txt'] END) u(name)) t),
{_fold("f3", "SELECT dir, name, h FROM l3")},
l2 AS (SELECT {_UP.format("dir")} dir, dir path, {_LAST.format("dir")} AS name, {_NODE.format(kind=2, mode=16877, name=_LAST.format("dir"), content="root")} h FROM f3_root),
{_fold("f2_", "SELECT dir, name, h FROM l2")},
l1 AS (SELECT '' dir, dir path, substr(dir, 2) AS name, {_NODE.format(kind=2, mode=16877, name="substr(dir, 2)", content="root")} h FROM f2__root),
{_fold("f1", "SELECT dir, name, h FROM l1")}"""


def _linked_tree(spark, sf_dir):
    """The tree of documents, every tenth under a second name."""
    found = _files(spark, sf_dir)
    nodes, edges = archive.tree(found)
    second = edges.where(F.col("name").endswith("0.txt")).withColumn("name", F.concat(F.regexp_extract("name", "^(.*)[.]txt$", 1), F.lit(".lnk")))
    return nodes, edges.unionByName(second)


@query(_TREE + """ SELECT 1 AS inode_id, root AS hash, 0 AS depth FROM f1_root UNION ALL SELECT id, h, 1 FROM l1 JOIN dd ON dd.dir = l1.path
UNION ALL SELECT id, h, 2 FROM l2 JOIN dd ON dd.dir = l2.path UNION ALL SELECT inode, h, 3 FROM l3""")
def tree_root(spark, sf_dir):
    return tree.tree_hashes(*_linked_tree(spark, sf_dir))


@query(_TREE + """, p AS (SELECT l3.dir || '/' || name path, h leaf, l3.dir FROM l3 UNION ALL SELECT path, h, dir FROM l2 UNION ALL SELECT path, h, dir FROM l1),
r AS (SELECT dir, root FROM f3_root UNION ALL SELECT dir, root FROM f2__root UNION ALL SELECT dir, root FROM f1_root)
SELECT path, leaf, root dir_root, ceil(log2(count(*) OVER (PARTITION BY p.dir)) - 1e-12)::INTEGER siblings, TRUE ok FROM p JOIN r ON p.dir = r.dir""")
def merkle_proofs(spark, sf_dir):
    """Every node's proof in its directory, checked against the directory's root."""
    proofs = tree.inclusion_proofs(tree.node_hashes(*_linked_tree(spark, sf_dir))[0])
    ok = digests.verify_inclusion(*[F.col(c) for c in ("leaf", "i", "siblings", "levels", "dir_root")])
    return proofs.select("path", "leaf", "dir_root", F.size("siblings").alias("siblings"), ok.alias("ok"))


@query("SELECT event_id, CASE (event_id % 8) WHEN 0 THEN 'directory' WHEN 1 THEN 'regular' WHEN 2 THEN 'symlink' WHEN 3 THEN 'fifo' WHEN 4 THEN 'char_device' WHEN 5 THEN 'block_device' WHEN 6 THEN 'socket' ELSE 'regular' END AS kind FROM events")
def mode_to_filetype(spark, sf_dir):
    bits = F.array(*map(F.lit, [16384, 32768, 40960, 4096, 8192, 24576, 49152, 61440]))
    return table(spark, sf_dir, "events").select("event_id", scalars.file_type(bits[(F.col("event_id") % 8).cast("int")] + 420).alias("kind"))


@query("SELECT inode, CASE WHEN size >= 1048576 THEN format('{:.2f} MiB', size / 1048576.0) WHEN size >= 1024 THEN format('{:.2f} KiB', size / 1024.0) ELSE size || ' B' END size_text FROM f")
def human_bytes(spark, sf_dir):
    return _files(spark, sf_dir).select("inode", scalars.human_bytes(F.col("size")).alias("size_text"))


@query("SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_id::VARCHAR END AS BIGINT), 300)::BIGINT setting FROM events")
def config_typed(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", scalars.typed_setting(raw, "long", 300).alias("setting"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'too new' WHEN 3 THEN 'invalid' ELSE 'not a number' END status FROM events")
def format_version_gate(spark, sf_dir):
    raw = F.array(F.lit(None).cast("string"), F.lit("1"), F.lit("2"), F.lit("0"), F.lit("x"))[(F.col("event_id") % 5).cast("int")]
    return table(spark, sf_dir, "events").select("event_id", scalars.version_gate(raw).alias("status"))


@query("SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def last_log_events(spark, sf_dir):
    return relational.newest(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), 5, [F.col("ts").desc(), F.col("event_id").desc()])


@query("SELECT event_type, count(*)::BIGINT n, min(ts) first_ts, max(ts) last_ts FROM events GROUP BY event_type")
def log_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT * FROM (SELECT o_orderkey::VARCHAR || '.indexbak.' || epoch(o_orderdate)::BIGINT AS name, o_custkey archive, row_number() OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate)::BIGINT DESC, o_orderkey DESC) n FROM orders) WHERE n <= 3")
def index_backup_rotation(spark, sf_dir):
    copies = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".indexbak."), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")).alias("name"), F.col("o_orderkey").alias("k"))
    stamp = F.regexp_extract("name", r"\.indexbak\.(\d+)$", 1).cast("long")
    kept = relational.newest(copies.where(F.col("name").rlike(r"\.indexbak\.\d+$")), 3, [stamp.desc(), F.col("k").desc()], "archive")
    from pyspark.sql.window import Window

    return kept.select("name", "archive", F.row_number().over(Window.partitionBy("archive").orderBy(stamp.desc(), F.col("k").desc())).alias("n"))


@query("SELECT object_id, backend, CASE WHEN found_id = object_id THEN 'ok' ELSE 'object hash' END status FROM rp UNION ALL SELECT object_id, -1, 'duplicate id' FROM f GROUP BY object_id HAVING count(*) > 1")
def bundle_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    state = F.when(~scalars.object_id_valid(F.col("object_id")), "bad id").when(F.col("found_id") != F.col("object_id"), "object hash").otherwise("ok")
    copies = archive.files(docs).groupBy("object_id").agg(F.count("*").alias("n")).where("n > 1")
    return placement.hashed(archive.replicas(docs)).select("object_id", "backend", state.alias("status")).union(copies.select("object_id", F.lit(-1), F.lit("duplicate id")))


SECRET = b"an archive secret of 32 bytes..."


def _hmac_sql(key: bytes, data: str) -> str:
    """Hex HMAC-SHA-256 of a BLOB expression."""
    inner, outer = ("".join(f"\\x{b ^ x:02X}" for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C))
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || {data})))"


_IDENTITY_KEY = hashlib.sha256(b"content identity:" + SECRET).digest()


@query(f"SELECT inode, {_hmac_sql(_IDENTITY_KEY, 'encode(content)')} content_id, {_hmac_sql(SECRET, "encode(lpad(hex(inode), 16, '0') || ':' || path)")} name_key FROM f")
def content_identity(spark, sf_dir):
    found = _files(spark, sf_dir)
    return found.select("inode", digests.content_id(SECRET, F.col("content")).alias("content_id"), digests.name_key(SECRET, F.col("inode"), F.col("path")).alias("name_key"))


@query("SELECT inode, size bytes, object_id whole FROM f WHERE size > 0")
def cdc_ingest(spark, sf_dir):
    """Chunks of files put together again, by small sizes so that files here are cut at all."""
    found = _files(spark, sf_dir)
    chunks = chunking.chunk(found, (256, 1024, 4096))
    objects = chunks.groupBy(F.col("plaintext_hash").alias("object_id")).agg(F.first("data").alias("data"))
    extents, _ = chunking.ingest(chunks, objects.limit(0))
    whole = chunking.assemble(extents, objects, found.where("size > 0").select("inode", "size"))
    return whole.select("inode", F.octet_length("content").cast("long").alias("bytes"), digests.digest(F.col("content")).alias("whole"))


@query("SELECT object_id plaintext_hash, size bytes, 'ok' status FROM c")
def seal_round_trip(spark, sf_dir):
    """Objects compressed, padded and sealed, then opened with all checks."""
    rows = _files(spark, sf_dir).groupBy(F.col("object_id").alias("plaintext_hash")).agg(F.first("content").cast("binary").alias("data"))
    packed = sealing.compress(rows.withColumn("plain_len", F.octet_length("data").cast("long")))
    key = bytes(range(32))
    opened = sealing.open_sealed(sealing.seal(packed, key, key_seed="query"), key)
    return opened.select(digests.digest(F.col("data")).alias("plaintext_hash"), F.octet_length("data").cast("long").alias("bytes"), "status")


@query("SELECT object_id, size bytes, 'ok' status FROM c")
def erasure_reconstruct(spark, sf_dir):
    """raid6 over five backends with one shard lost and one corrupt, of every object."""
    rows = _files(spark, sf_dir).groupBy("object_id").agg(F.first("content").cast("binary").alias("data"))
    at = digests.bucket_of(F.col("object_id"), 5)
    stored = erasure.shards(rows, 5, "raid6").where(F.col("backend") != at)
    bad = F.when(F.col("backend") == F.pmod(at + 2, F.lit(5)), F.overlay("shard", F.lit(bytearray(b"\xff\x00\xff")), F.lit(1))).otherwise(F.col("shard"))
    out = erasure.reconstruct(stored.withColumn("shard", bad), 5, "raid6")
    return out.select("object_id", F.octet_length("data").cast("long").alias("bytes"), "status")


@query("SELECT inode, greatest(7, least(size, 100))::BIGINT bytes, TRUE ok FROM f")
def write_algebra(spark, sf_dir):
    """Each file cut to 100 bytes, then its first 7 overwritten."""
    found = _files(spark, sf_dir)
    op = lambda seq, op, data, size: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.lit(0).cast("long").alias("offset"), F.lit(data).cast("binary").alias("data"), size.cast("long").alias("size"))
    ops = found.select("inode", F.explode(F.array(op(0, "truncate", None, F.least("size", F.lit(100))), op(1, "write", "changed", F.lit(0)))).alias("o")).select("inode", "o.*")
    out = writes.apply(found, ops)
    return out.select("inode", F.octet_length("content").cast("long").alias("bytes"), (F.substring("content", 1, 7) == F.lit("changed").cast("binary")).alias("ok"))


# Lookups, changes, contents and snapshots

_IDS = "ids AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 1048576 ELSE -doc_id - 5 END id FROM documents)"


def _ids(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.when(d % 3 == 0, d + archive.FILE_BASE).otherwise(-d - 5).alias("id"))


@query(f", {_IDS} SELECT id, mode, size, mtime, object_id file_digest FROM ids LEFT JOIN f ON inode = id")
def inode_lookup(spark, sf_dir):
    nodes, _ = archive.tree(_files(spark, sf_dir))
    return metadata.get_inodes(nodes, _ids(spark, sf_dir))


@query("SELECT dd.id parent_inode, doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.no' END AS name, CASE WHEN doc_id % 3 = 0 THEN inode END inode_id FROM f JOIN dd ON dd.dir = regexp_extract(path, '^(.*)/[^/]*$', 1)")
def dentry_lookup(spark, sf_dir):
    found = _files(spark, sf_dir)
    _, edges = archive.tree(found)
    doc = F.col("inode") - archive.FILE_BASE
    asked = found.select(archive.dir_id(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).alias("parent_inode"), F.concat(doc.cast("string"), F.when(doc % 3 == 0, ".txt").otherwise(".no")).alias("name"))
    return metadata.dentry_inodes(edges, asked)


@query(f", {_IDS} SELECT ids.id, coalesce(dd.id, 1) parent_inode, CASE WHEN doc_id % 10 = 0 THEN doc_id || '.lnk' ELSE coalesce(doc_id || '.txt', '') END AS name FROM ids LEFT JOIN f ON inode = ids.id LEFT JOIN dd ON dd.dir = regexp_extract(path, '^(.*)/[^/]*$', 1)")
def parent_and_name(spark, sf_dir):
    _, edges = _linked_tree(spark, sf_dir)
    return metadata.placed(edges, _ids(spark, sf_dir))


@query('SELECT DISTINCT object_id, inode FROM e WHERE object_id IN (SELECT sha256(p_partkey::VARCHAR) FROM part WHERE p_size = 7)')
def inodes_using_chunk(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where("p_size = 7").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("object_id"))
    return metadata.inodes_using(_extents(spark, sf_dir), wanted)


@query("SELECT i.object_id, c.object_id IS NOT NULL present, coalesce(c.size % 2 = 0, false) AS domain FROM (SELECT DISTINCT object_id FROM f2) i LEFT JOIN c ON c.object_id = i.object_id")
def chunk_exists(spark, sf_dir):
    index = archive.chunk_index(table(spark, sf_dir, "documents")).withColumn("domain", F.col("size") % 2 == 0)
    return metadata.object_flags(index, _files(spark, sf_dir, 2).select("object_id").distinct())


@query("SELECT f2.path, f2.object_id plaintext_hash, m.o object_id FROM f2 LEFT JOIN (SELECT object_id, min(inode::VARCHAR) o FROM f GROUP BY object_id) m ON m.object_id = f2.object_id")
def dedup_lookup(spark, sf_dir):
    index = _files(spark, sf_dir).select(F.col("object_id").alias("plaintext_hash"), F.col("inode").cast("string").alias("object_id"))
    return metadata.by_content(index, _files(spark, sf_dir, 2).select("path", F.col("object_id").alias("plaintext_hash")))


@query("""SELECT e.inode, e.name, CASE WHEN e.there AND e.flag = 'create' THEN 'exists' WHEN NOT e.there AND e.flag = 'replace' THEN 'absent'
WHEN NOT e.there AND 1020 + row_number() OVER (PARTITION BY inode, NOT there AND flag <> 'replace' ORDER BY name) > 1024 THEN 'too_many' ELSE 'set' END status
FROM (SELECT user_id inode, event_id::VARCHAR AS name, event_id % 4 = 0 there, ['any', 'create', 'replace'][event_id % 3 + 1] flag FROM events) e""")
def xattr_set(spark, sf_dir):
    """Every user has 1020 attributes besides a quarter of its events' names, so that few new ones fit."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("inode"), F.col("event_id").cast("string").alias("name"), F.col("event_id"))
    have = events.where("event_id % 4 = 0").select("inode", "name", F.lit(b"v").alias("value"))
    filler = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1020) - F.col("n"), F.lit(0)).cast("int"))).alias("k")
    counts = events.groupBy("inode").agg(F.count_if(F.col("event_id") % 4 == 0).alias("n"))
    have = have.unionByName(counts.where("n < 1020").select("inode", filler).select("inode", F.concat(F.lit("fill"), F.col("k").cast("string")).alias("name"), F.lit(b"v").alias("value")))
    flag = F.array(F.lit("any"), F.lit("create"), F.lit("replace"))[(F.col("event_id") % 3).cast("int")]
    return metadata.set_xattrs(have, events.select("inode", "name", F.lit(b"w").alias("value"), flag.alias("flag")))[1]


@query("SELECT inode id, CASE WHEN doc_id % 4 = 0 THEN 33152 ELSE mode END::BIGINT mode, CASE WHEN doc_id % 6 = 0 THEN 7 ELSE size END::BIGINT size, mtime FROM f UNION ALL SELECT id, 16877, 4096, 1700000000 FROM dd")
def attribute_update(spark, sf_dir):
    nodes, _ = archive.tree(_files(spark, sf_dir))
    d = F.col("doc_id")
    changes = table(spark, sf_dir, "documents").select((d + archive.FILE_BASE).alias("id"), F.when(d % 4 == 0, archive.FILE_MODE - 36).cast("long").alias("mode"), F.when(d % 6 == 0, 7).cast("long").alias("size"))
    return metadata.update(nodes, changes, ["id"]).select("id", "mode", "size", "mtime")


@query("""SELECT inode inode_id, CASE WHEN doc_id % 20 = 0 THEN 1 WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END::BIGINT nlink FROM f WHERE path NOT LIKE '/de/%' AND doc_id % 5 <> 1""")
def unlink_names(spark, sf_dir):
    """Names of one file in five, second names of one in twenty and the folder /de go; the files that are left, with links."""
    nodes, edges = _linked_tree(spark, sf_dir)
    doc = F.col("inode_id") - archive.FILE_BASE
    files_ = edges.where(F.col("name").rlike("[.](txt|lnk)$"))
    gone = files_.where(((doc % 5 == 1) & F.col("name").endswith(".txt")) | ((doc % 20 == 0) & F.col("name").endswith(".lnk"))).unionByName(edges.where("name = 'de'"))
    left, _ = metadata.unlink({"inodes": nodes, "dentries": edges}, gone.select("parent_inode", "name", F.lit(False).alias("only_empty")))
    return metadata.with_links(left["inodes"], left["dentries"]).where(F.col("id").between(archive.FILE_BASE, (1 << 60))).select(F.col("id").alias("inode_id"), "nlink")


@query("""SELECT CASE WHEN path LIKE '/de/%' THEN '/en/moved' || substr(path, 4) ELSE path END path, inode inode_id FROM f
UNION ALL SELECT CASE WHEN dir = '/de' OR dir LIKE '/de/%' THEN '/en/moved' || substr(dir, 4) ELSE dir END, id FROM dd WHERE dir <> ''""")
def rename_folder(spark, sf_dir):
    nodes, edges = archive.tree(_files(spark, sf_dir))
    en = spark.range(1).select(archive.dir_id(F.lit("/en"))).first()[0]
    tables, status = metadata.rename({"inodes": nodes, "dentries": edges}, (archive.ROOT, "de"), (en, "moved"))
    if status != "renamed":
        raise ValueError(status)
    return tree.walk(tables["dentries"]).select("path", "inode_id")


@query("""SELECT doc_id, doc_id || '.txt' AS name, 1 + (SELECT max(id) FROM (SELECT inode id FROM f UNION ALL SELECT id FROM dd)) + row_number() OVER (ORDER BY doc_id || '.new') - 1 inode_id FROM f WHERE doc_id % 9 = 0""")
def insert_entries(spark, sf_dir):
    """New files in the root folder, numbered on from the largest inode."""
    nodes, edges = archive.tree(_files(spark, sf_dir))
    d = F.col("doc_id")
    new = table(spark, sf_dir, "documents").where("doc_id % 9 = 0").select(F.lit(1).cast("long").alias("parent_inode"), F.concat(d.cast("string"), F.lit(".new")).alias("name"), F.lit(archive.FILE_MODE).cast("long").alias("mode"), F.lit(0).cast("long").alias("size"), F.lit(archive.NOW).cast("long").alias("mtime"), F.lit(None).cast("string").alias("file_digest"))
    _, out = metadata.insert_nodes(nodes, edges, new)
    doc = F.regexp_extract("name", "^(.*)[.]new$", 1)
    return out.where(F.col("name").endswith(".new")).select(doc.cast("long").alias("doc_id"), F.concat(doc, F.lit(".txt")).alias("name"), "inode_id")


@query("""SELECT object_id, 'removed' AS outcome FROM c WHERE created_at < 1700000000 - 2 * 3600 AND object_id NOT IN (SELECT object_id FROM f WHERE doc_id % 7 <> 0) AND object_id NOT IN (SELECT object_id FROM f WHERE doc_id % 14 = 0)
  AND object_id NOT IN (SELECT object_id FROM f WHERE doc_id % 21 = 0)
UNION ALL SELECT DISTINCT object_id, 'local orphan' FROM f2 WHERE object_id NOT IN (SELECT object_id FROM c)
UNION ALL SELECT object_id, 'local orphan' FROM c WHERE created_at < 1700000000 - 2 * 3600 AND object_id NOT IN (SELECT object_id FROM f WHERE doc_id % 7 <> 0) AND object_id NOT IN (SELECT object_id FROM f WHERE doc_id % 14 = 0)
  AND object_id NOT IN (SELECT object_id FROM f WHERE doc_id % 21 = 0)""")
def gc(spark, sf_dir):
    """What neither live files, a snapshot nor the queue holds leaves the index; then what no table names is a local orphan."""
    docs = table(spark, sf_dir, "documents")
    part = lambda rule: archive.files(docs.where(rule)).select("object_id")
    stored = archive.chunk_index(docs).select("object_id").union(_files(spark, sf_dir, 2).select("object_id"))
    _, removed, local = metadata.collect_garbage(archive.chunk_index(docs), part("doc_id % 7 <> 0"), part("doc_id % 21 = 0"), part("doc_id % 14 = 0"), stored, NOW, 2)
    return removed.select("object_id", F.lit("removed").alias("outcome")).union(local.select("object_id", F.lit("local orphan")))


def _chunked(spark, sf_dir):
    """(extents, objects, sizes) of all files, cut by small sizes so that files have several extents."""
    found = _files(spark, sf_dir)
    chunks = cut(chunking.chunk(found, (256, 1024, 4096)))
    extents = chunks.select("inode", "offset", "plain_len", F.col("plaintext_hash").alias("object_id"))
    return extents, chunks.groupBy(F.col("plaintext_hash").alias("object_id")).agg(F.first("data").alias("data")), found.select("inode", "size")


@query("SELECT inode, sha256(content || '|' || size) AS digest, 'ok' status, CASE WHEN doc_id % 6 = 0 THEN 'missing_digest' WHEN doc_id % 6 = 1 THEN 'changed' ELSE 'verified' END outcome FROM f")
def file_digests(spark, sf_dir):
    """Digests of whole files from their extents, held against what is noted for them."""
    found = cut(content.digests(*_chunked(spark, sf_dir)))
    doc = F.col("inode") - archive.FILE_BASE
    noted = F.when(doc % 6 == 1, F.sha2(F.lit("other"), 256)).when(doc % 6 != 0, content.inline_digest(F.col("content")))
    outcomes = content.verify(found, _files(spark, sf_dir).select("inode", noted.alias("file_digest")))
    return found.join(outcomes, "inode").select("inode", "digest", "status", "outcome")


@query("SELECT inode, start, upper(substr(hex(encode(content)), (2 * start + 1)::INTEGER, 1400)) bytes FROM f, (VALUES (0::BIGINT), (300::BIGINT), (5000::BIGINT)) t(start)")
def read_ranges(spark, sf_dir):
    """700 bytes of each file from three places, over the edges of its extents and its end."""
    extents, objects, sizes = _chunked(spark, sf_dir)
    starts = F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 300, 5000)])).alias("start")
    out = content.read(extents, objects, sizes, sizes.select("inode", starts, F.lit(700).cast("long").alias("length")))
    return out.select("inode", "start", F.hex("content").alias("bytes"))


@query("""SELECT '/' || path AS path, inode inode_id, 'found' status FROM f WHERE doc_id % 3 = 0 UNION ALL SELECT path || '/x', NULL, 'missing' FROM f WHERE doc_id % 3 = 1
UNION ALL SELECT '/..' || path, NULL, 'unsafe' FROM f WHERE doc_id % 3 = 2""")
def path_resolution(spark, sf_dir):
    found = _files(spark, sf_dir)
    _, edges = archive.tree(found)
    doc = F.col("inode") - archive.FILE_BASE
    asked = found.select(F.when(doc % 3 == 0, F.concat(F.lit("/"), "path")).when(doc % 3 == 1, F.concat("path", F.lit("/x"))).otherwise(F.concat(F.lit("/.."), "path")).alias("path"))
    return tree.resolve(tree.walk(edges), asked)


@query("SELECT path, inode inode_id, size FROM f UNION ALL SELECT 'root is kept', NULL, (SELECT count(*) FROM f)")
def snapshot_restore(spark, sf_dir):
    """The first version's files are written as a snapshot, the second version comes, and the snapshot is restored."""
    store = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    state = lambda version: dict(zip(("inodes", "dentries"), archive.tree(_files(spark, sf_dir, version)), strict=True))
    none = spark.createDataFrame([], "id long, name string, timestamp long, tree_root string")
    tables = snapshots.create(state(1) | {"snapshots": none}, store, "first", NOW)
    live = snapshots.restore(tables | state(2), store, 1)
    kept = snapshots.verify(live, store, 1) and live["snapshots"].count() == 1
    walked = tree.walk(live["dentries"]).join(live["inodes"].where("file_digest IS NOT NULL").select(F.col("id").alias("inode_id"), "size"), "inode_id")
    files_ = cut(walked.select("path", "inode_id", "size"))
    snapshots.delete(live, store, [1])
    return files_.union(files_.agg(F.lit("root is kept" if kept else "root is lost"), F.lit(None).cast("long"), F.count("*")))


@query("SELECT archive, max(id) id FROM sn GROUP BY archive")
def newest_snapshot(spark, sf_dir):
    return snapshots.newest(_snapshots(spark, sf_dir))


@query("SELECT row_number() OVER (ORDER BY uri) + 3 id, uri FROM (SELECT DISTINCT 's3a://' || o_custkey % 40 uri FROM orders) WHERE uri NOT IN ('s3a://1', 's3a://2', 's3a://3') UNION ALL SELECT * FROM (VALUES (1, 's3a://1'), (2, 's3a://2'), (3, 's3a://3'))")
def backend_registry(spark, sf_dir):
    have = spark.createDataFrame([(i, f"s3a://{i}") for i in (1, 2, 3)], "id long, uri string")
    return metadata.add_backends(have, table(spark, sf_dir, "orders").select(F.concat(F.lit("s3a://"), (F.col("o_custkey") % 40).cast("string")).alias("uri")))


@query("SELECT object_id, n - 1 AS place FROM (SELECT object_id, row_number() OVER (ORDER BY min(mtime), object_id) n FROM f GROUP BY object_id)")
def upload_queue_fifo(spark, sf_dir):
    from ..tables import number

    queue = _files(spark, sf_dir).groupBy("object_id").agg(F.min("mtime").alias("added_at"))
    return number(queue, "added_at", "object_id", name="place").select("object_id", "place")


@query("""SELECT CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN path || '/x' WHEN 2 THEN path ELSE '/' || lang || '/' || source END path, max(CASE WHEN doc_id % 4 = 0 THEN object_id END) content,
CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'digest' ELSE 'not a file' END status FROM f JOIN documents USING (doc_id) GROUP BY ALL""")
def partial_restore(spark, sf_dir):
    """Files restored by path with proofs up to the root; a quarter of the noted digests is of other bytes."""
    found = cut(_files(spark, sf_dir))
    extents, objects, _ = _chunked(spark, sf_dir)
    doc = F.col("inode") - archive.FILE_BASE
    inodes, edges = archive.tree(found.withColumn("object_id", F.when(doc % 4 == 2, F.sha2(F.lit("other"), 256)).otherwise(content.inline_digest(F.col("content")))))
    inodes, edges = cut(inodes), cut(edges)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    asked = found.select(F.when(doc % 4 == 1, F.concat("path", F.lit("/x"))).when(doc % 4 == 3, folder).otherwise(F.col("path")).alias("path"))
    nodes, root = tree.node_hashes(inodes, edges)
    out = snapshots.restore_paths({"inodes": inodes, "dentries": edges, "file_chunks": extents}, objects, root.first()[0], asked, nodes)
    return out.select("path", digests.digest(F.col("content")).alias("content"), "status")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, 'lineitem' AS t FROM lineitem UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'third sync uploads 1 table'")
def index_sync_round_trip(spark, sf_dir):
    """Tables sealed to two stores, synced again unchanged, synced with one more row, and restored from the second store."""
    base = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    both, key = [stores.Store(spark, f"{base}/{x}") for x in "ab"], bytes(range(32))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    tables = {"lineitem": lines, "config": spark.createDataFrame([("k", "v")], "key string, value string"), "empty": lines.limit(0)}
    first = index_sync.sync(tables, both, key)
    before = both[0].read().count()
    again = index_sync.sync(tables, both, key)
    third = index_sync.sync(tables | {"config": tables["config"].union(spark.createDataFrame([("l", "w")], "key string, value string"))}, both, key)
    new = both[0].read().count() - before
    back = index_sync.restore(spark, [stores.Store(spark, f"{base}/none"), both[1]], key)
    good = (first, again, third, new, back["config"].count(), back["empty"].count()) == (1, None, 2, 1, 2, 0)
    rows = back["lineitem"].select(*lines.columns, F.lit("lineitem").alias("t"))
    note = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema], F.lit(f"third sync uploads {new} table" if good else "wrong").alias("t"))
    return rows.union(note)


@query("SELECT inode, object_id content_id, CASE WHEN row_number() OVER (PARTITION BY object_id ORDER BY doc_id % 2, inode) = 1 THEN 'published' ELSE 'adopted' END outcome FROM f")
def pool_publish(spark, sf_dir):
    """Two batches, of even and of odd documents, published to one pool of sealed objects."""
    found = _files(spark, sf_dir)
    names = cut(found.select("inode", F.col("object_id").alias("plaintext_hash")))
    base, key = f"{shared_dir(spark)}/pool-{uuid.uuid4().hex}", bytes(range(32))
    shared = stores.SharedPool(spark, base, "ns", key)
    out = []
    for rest in (0, 1):
        own = F.col("inode") % 2 == rest
        plain = found.where(own).select(F.col("object_id").alias("plaintext_hash"), F.col("size").alias("plain_len"), F.col("content").cast("binary").alias("data")).dropDuplicates(["plaintext_hash"])
        sealed = cut(pool.seal_shared(sealing.compress(plain), key, key), large=True)
        offers = names.where(own).join(sealed.select("plaintext_hash", "object_id", "shared_record"), "plaintext_hash")
        offers = offers.select(F.col("plaintext_hash").alias("content_id"), F.col("inode").alias("archive"), F.lit(0).alias("seq"), "object_id", F.col("shared_record").alias("record"), "plaintext_hash")
        out.append(shared.publish(offers, sealed.select("object_id", F.col("sealed").alias("bytes"))))
    return out[0].union(out[1]).select(F.col("archive").alias("inode"), "content_id", "outcome")


@query("""SELECT inode id, size, (size + 511) // 512 blocks, 'regular' kind, 420::BIGINT perm, 1::BIGINT nlink, mtime, doc_id % 7 = 0 incomplete FROM f
UNION ALL SELECT id, 4096, 8, 'directory', 493, 2, 1700000000, FALSE FROM dd""")
def file_attributes(spark, sf_dir):
    inodes, edges = archive.tree(_files(spark, sf_dir))
    marks = metadata.mark_incomplete(spark.createDataFrame([], "inode long"), _files(spark, sf_dir).where((F.col("inode") - archive.FILE_BASE) % 7 == 0).select(F.col("inode").alias("id")))
    kept = metadata.incomplete(metadata.attributes(inodes, edges), marks)
    return kept.select("id", "size", "blocks", "kind", "perm", "nlink", "mtime", "incomplete")


@query("SELECT archive * 100000 + id id, id % 17 = 0 AND id % 3 <> 0 protected, CASE WHEN id % 5 = 0 THEN 'a,b' ELSE '' END tags FROM sn")
def snapshot_controls(spark, sf_dir):
    """Protection and tags of all snapshots, set in two batches, of which the second leaves some as they are."""
    snaps = _snapshots(spark, sf_dir).select((F.col("archive") * 100000 + F.col("id")).alias("id"), F.col("id").alias("n"), "protected")
    tables = {"snapshots": snaps.select("id"), "config": spark.createDataFrame([], "key string, value string"), "snapshot_controls": spark.createDataFrame([], "snapshot_id long, protected boolean, tags_json string")}
    first = snaps.where("protected OR n % 5 = 0").select(F.col("id").alias("snapshot_id"), "protected", F.lit(None).cast("string").alias("tags_json"))
    second = snaps.where("n % 5 = 0 OR n % 3 = 0").select(F.col("id").alias("snapshot_id"), F.when(F.col("n") % 3 == 0, F.lit(False)).alias("protected"), F.when(F.col("n") % 5 == 0, '["a","b"]').alias("tags_json"))
    out = snapshots.controls(snapshots.set_controls(snapshots.set_controls(tables, first), second))
    return out.select("id", "protected", F.array_join("tags", ",").alias("tags"))
