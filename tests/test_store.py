"""Stores, bundles, snapshots, changes of metadata, contents, sealing across archives."""

import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vaultlake.operators import content, ingest, integrity, metadata, pool, sealing, snapshots, tree
from vaultlake.sources import archive, index_sync, stores
from vaultlake.streaming import jobs
from vaultlake.tables import number


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sha(data):
    return hashlib.sha256(data).hexdigest()


DIR, FILE = archive.DIR_MODE, archive.FILE_MODE


@pytest.fixture
def tables(spark):
    nodes = [(1, DIR), (2, DIR), (3, DIR), (4, DIR), (10, FILE), (11, FILE), (12, FILE)]
    names = [(1, "a", 2), (2, "b", 3), (1, "empty", 4), (3, "f", 10), (1, "g", 10), (1, "h", 11), (2, "i", 12)]
    return {
        "inodes": spark.createDataFrame([(i, m, 5, 0, sha(b"%d" % i) if m == FILE else None) for i, m in nodes], "id long, mode long, size long, mtime long, file_digest string"),
        "dentries": spark.createDataFrame(names, "parent_inode long, name string, inode_id long"),
        "file_chunks": spark.createDataFrame([(10, 0, "x", 5), (12, 0, "y", 5)], "inode long, offset long, object_id string, plain_len long"),
    }


def test_unlink(spark, tables):
    ask = lambda *r: spark.createDataFrame(list(r), "parent_inode long, name string, only_empty boolean")
    out, said = metadata.unlink(tables, ask((1, "a", True), (1, "empty", True), (1, "g", False), (1, "no", False)))
    assert rows(said) == sorted([(1, "a", 2, 1, "not_empty"), (1, "empty", 4, 0, "removed"), (1, "g", 10, 1, "removed"), (1, "no", None, None, "missing")], key=repr)
    assert {r.id for r in out["inodes"].collect()} == {1, 2, 3, 10, 11, 12}
    out, _ = metadata.unlink(tables, ask((1, "a", False)))
    assert {r.id for r in out["inodes"].collect()} == {1, 4, 10, 11} and rows(out["file_chunks"]) == [(10, 0, "x", 5)]
    assert {r.id: r.nlink for r in metadata.with_links(out["inodes"], out["dentries"]).collect()} == {1: 2, 4: 2, 10: 1, 11: 1}


def test_rename(tables):
    say = lambda s, t: metadata.rename(tables, s, t)[1]
    assert say((1, "no"), (1, "x")) == "missing" and say((1, "a"), (3, "x")) == "cycle" and say((1, "a"), (2, "x")) == "cycle"
    assert say((1, "h"), (1, "a")) == "is_directory" and say((1, "empty"), (1, "h")) == "not_directory" and say((1, "empty"), (1, "a")) == "not_empty"
    assert say((1, "g"), (3, "f")) == "renamed"  # two names of one file
    out, said = metadata.rename(tables, (1, "h"), (2, "i"))
    assert said == "renamed" and {r.path for r in tree.walk(out["dentries"]).collect()} == {"/a", "/a/b", "/a/b/f", "/a/i", "/empty", "/g"}
    assert {r.id for r in out["inodes"].collect()} == {1, 2, 3, 4, 10, 11}
    assert metadata.rename(tables, (1, "a"), (1, "empty"))[1] == "renamed"


def test_links_and_new_nodes(spark, tables):
    one = spark.createDataFrame([(2, "again", 11)], "parent_inode long, name string, inode_id long")
    assert {r.id: r.nlink for r in metadata.with_links(tables["inodes"], metadata.link(tables["inodes"], tables["dentries"], one)).collect()}[11] == 2
    for bad in ((2, "d", 2), (2, "n", 99), (1, "h", 11)):
        with pytest.raises(Exception, match="directory|no such|twice"):
            metadata.link(tables["inodes"], tables["dentries"], spark.createDataFrame([bad], one.schema)).collect()
    new = spark.createDataFrame([(1, n, FILE, 0, 0, None) for n in ("z", "y")], "parent_inode long, name string, mode long, size long, mtime long, file_digest string")
    nodes, edges = metadata.insert_nodes(tables["inodes"], tables["dentries"], new)
    assert {r.name: r.inode_id for r in edges.where("inode_id > 12").collect()} == {"y": 13, "z": 14} and nodes.count() == 9
    with pytest.raises(Exception, match="twice"):
        metadata.insert_nodes(tables["inodes"], tables["dentries"], new.withColumn("name", F.lit("h")))[1].collect()
    assert rows(number(spark.range(100).repartition(7), F.col("id").desc(), name="n").where("id + n <> 99")) == []
    assert number(spark.range(0), "id").collect() == []


def test_xattrs(spark):
    have = spark.createDataFrame([(1, f"n{i:04}", bytearray(b"v")) for i in range(1023)], "inode long, name string, value binary")
    ask = spark.createDataFrame([(1, "a", b"1", "any"), (1, "b", b"1", "create"), (1, "n0001", b"2", "replace"), (1, "n0002", b"2", "create"), (1, "q", b"2", "replace"), (2, "a", b"3", "create")], "inode long, name string, value binary, flag string")
    out, said = metadata.set_xattrs(have, ask)
    assert rows(said) == sorted([(1, "a", "set"), (1, "b", "too_many"), (1, "n0001", "set"), (1, "n0002", "exists"), (1, "q", "absent"), (2, "a", "set")], key=repr)
    assert out.count() == 1025 and bytes(out.where("name = 'n0001'").first().value) == b"2"
    assert metadata.remove(out, ask, ["inode", "name"]).count() == 1021


def test_attributes_are_not_broadcast(spark):
    """A thousand attributes an inode, made by a generator: the planner takes them for a hundred rows."""
    attrs = spark.range(100).select(F.col("id").alias("inode"), F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("k")).select("inode", F.col("k").cast("string").alias("name"), F.lit(b"v").alias("value"))
    ask = spark.range(300).select((F.col("id") % 100).alias("inode"), (F.col("id") + 900).cast("string").alias("name"), F.lit(b"w").alias("value"), F.lit("create").alias("flag"))
    _, said = metadata.set_xattrs(attrs, ask)
    assert "Broadcast" not in said._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in said.groupBy("status").count().collect()} == {("exists", 101), ("set", 199)}


def test_inline_and_updates(spark):
    inodes = spark.createDataFrame([(1, 5, bytearray(b"12345")), (2, 9, None)], "id long, size long, inline_data binary")
    extents = spark.createDataFrame([(2, 0, "x", 9)], "inode long, offset long, object_id string, plain_len long")
    data = spark.createDataFrame([(1, bytearray()), (2, bytearray(b"ab"))], "id long, data binary")
    a, b = metadata.set_inline(inodes, extents, data)
    assert sorted((r.id, r.size, r.inline_data and bytes(r.inline_data)) for r in a.collect()) == [(1, 0, None), (2, 2, b"ab")] and b.isEmpty()
    assert [(r.id, r.size) for r in metadata.update(inodes, spark.createDataFrame([(1, 7)], "id long, size long"), ["id"]).orderBy("id").collect()] == [(1, 7), (2, 9)]
    after, more, done = ingest.promote(inodes, extents, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "object_id string, plaintext_hash string"), bytes(32), 1)
    assert after.where("inline_data IS NOT NULL").isEmpty() and more.count() == 2 and done.objects.count() == 1


def test_contents(spark):
    objects = spark.createDataFrame([("a", bytearray(b"abcd")), ("b", bytearray(b"xy"))], "object_id string, data binary")
    ext = spark.createDataFrame([(1, 0, "a", 4), (1, 6, "b", 2), (2, 0, "a", 4), (2, 3, "b", 2), (3, 0, "gone", 4), (4, 0, "a", 4)], "inode long, offset long, object_id string, plain_len long")
    sizes = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 3), (5, 70_000), (6, 0)], "inode long, size long")
    want = {1: b"abcd\0\0xy\0", 5: bytes(70_000), 6: b""}
    got = {r.inode: (r.digest, r.status) for r in content.digests(ext, objects, sizes).collect()}
    assert got == {i: (sha(x + b"|%d" % len(x)), "ok") for i, x in want.items()} | {2: (None, "overlap"), 3: (None, "missing object"), 4: (None, "past the end")}
    assert {r.inode: bytes(r.content) for r in content.whole(ext, objects, sizes).where("status = 'ok'").collect()} == want
    rng = random.Random(2)
    ask = [(i, rng.randrange(12), rng.randrange(12)) for i in (1, 5, 6) for _ in range(30)]
    df = spark.createDataFrame(sorted(set((i, s) for i, s, _ in ask)), "inode long, start long").withColumn("length", (F.col("start") * 7 + 3) % 11)
    for r, n in zip(content.read(ext, objects, sizes, df).orderBy("inode", "start").collect(), df.orderBy("inode", "start").collect(), strict=True):
        assert bytes(r.content) == want[r.inode][r.start : r.start + n.length]
    with pytest.raises(Exception, match="there already"):
        integrity.replace_range(ext.where("inode = 1"), ext.where("inode = 1"), 5, 9).collect()


def test_links_in_paths(spark):
    edges = spark.createDataFrame([(1, "d", 2), (2, "f", 10), (1, "l", 20), (1, "abs", 21), (1, "x", 22), (1, "y", 23)], "parent_inode long, name string, inode_id long")
    links = spark.createDataFrame([(20, "../d"), (21, "/d/f"), (22, "/y"), (23, "/x")], "inode_id long, target string")
    ask = spark.createDataFrame([(p,) for p in ("/d/f", "/abs", "/x", "/none", "/abs/more")], "path string")
    got = {r.path: (r.target, r.status) for r in tree.resolve_links(tree.walk(edges), links, ask).collect()}
    assert got == {"/d/f": ("/d/f", "found"), "/abs": ("/d/f", "found"), "/x": (None, "loop"), "/none": (None, "missing"), "/abs/more": (None, "missing")}
    assert rows(tree.climb(edges, spark.createDataFrame([(10,)], "start long"))) == [(10, 1, 2), (10, 10, 0), (10, 2, 1)]


def test_one_name_more_changes_no_other_hash(spark, tables):
    root = lambda e: tree.node_hashes(tables["inodes"], e)[1].first().hash
    assert tree.node_hashes(tables["inodes"], tables["dentries"])[0].count() == 7  # the file with two names stands under both
    assert root(tables["dentries"]) != root(tables["dentries"].where("name <> 'g'")) is not None


def test_store_and_bundle(spark, tmp_path):
    put = lambda *x: spark.createDataFrame([(sha(b), bytearray(b)) for b in x], "object_id string, bytes binary")
    near, far = stores.Store(spark, f"{tmp_path}/near"), stores.Store(spark, f"{tmp_path}/far")
    near.upload(put(b"1"))
    near.upload(put(b"1", b"2"))
    assert near.read().count() == 2
    bad = put(b"3").withColumn("bytes", F.lit(b"damaged"))
    assert rows(far.upload_from_cache(put(b"2", b"4").union(bad))) == [(sha(b"3"),)]
    ids = put(b"1", b"4", b"5").select("object_id")
    assert {r.object_id: (r.bytes and bytes(r.bytes), r.source) for r in stores.fetch_first(ids, [near, far]).collect()} == {sha(b"1"): (b"1", 0), sha(b"4"): (b"4", 1), sha(b"5"): (None, None)}

    class Broken(stores.Store):
        tries = 0

        def upload(self, objects):
            self.tries += 1
            if self.tries < 3:
                raise OSError

    broken, waits = Broken(spark, "x"), []
    assert stores.upload_all(put(b"6"), [near, broken], wait=waits.append) == [] and waits == [2.0, 4.0] and near.read().count() == 3
    chunks = spark.createDataFrame([(1, 0, sha(b"1"), 1)], "inode long, offset long, object_id string, plain_len long")
    stores.export_bundle({"file_chunks": chunks}, near.read(), f"{tmp_path}/bundle")
    assert stores.check_bundle(spark, f"{tmp_path}/bundle").isEmpty()
    assert stores.import_bundle(spark, f"{tmp_path}/bundle", far)["file_chunks"].count() == 1 and far.read().count() == 3
    near.read().select(F.lit("not an id").alias("object_id"), "bytes").limit(1).write.mode("append").parquet(f"{tmp_path}/bundle/objects")
    with pytest.raises(ValueError, match="bad id"):
        stores.import_bundle(spark, f"{tmp_path}/bundle", far)
    assert stores.address("s3", "b") == "s3a://b" and stores.address("azblob", "acc", "c").startswith("abfss://c@acc")


def test_directory_and_log(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in (("a.txt", b"abc"), ("sub/b.txt", b"de"), ("sub/drop.txt", b"f")):
        (tmp_path / "in" / name).write_bytes(data)
    found = stores.scan_directory(spark, f"{tmp_path}/in", ("**/drop.txt",))
    assert rows(stores.totals(found)) == [(2, 5)] and {bytes(r.content) for r in found.collect()} == {b"abc", b"de"}
    for i in range(3):
        stores.append_log(spark, f"{tmp_path}/log", {"event": "gc", "n": i})
    lines = spark.read.text(f"{tmp_path}/log").union(spark.createDataFrame([("{broken",)], "value string"))
    last = stores.last_events(lines, "event string, n long", [F.col("value").desc()], keep=3)
    assert [r.n for r in last.collect()] == [2, 1]


def test_snapshots(spark, tables, tmp_path):
    control = {"snapshots": spark.createDataFrame([], "id long, name string, timestamp long, tree_root string"), "config": spark.createDataFrame([("k", "v")], "key string, value string")}
    store = f"{tmp_path}/store"
    first = snapshots.create(tables | control, store, "one", 1)
    changed = first | {"dentries": first["dentries"].where("name <> 'h'"), "file_chunks": first["file_chunks"].limit(1), "config": control["config"].withColumn("value", F.lit("new"))}
    second = snapshots.create(changed, store, "two", 2)
    roots = [r.tree_root for r in snapshots.listed(second["snapshots"]).collect()]
    assert len(set(roots)) == 2 and None not in roots and snapshots.verify(second, store, 1)
    back = snapshots.restore(second, store, 1)
    assert rows(back["dentries"]) == rows(tables["dentries"]) and back["config"].first().value == "new" and back["snapshots"].count() == 2
    assert rows(snapshots.used_objects(store, spark, [1, 2])) == [("x",), ("y",)]
    left = snapshots.delete(back | {"snapshots": second["snapshots"]}, store, [1])
    assert [r.id for r in left["snapshots"].collect()] == [2] and not (tmp_path / "store/inodes/snapshot_id=1").exists()


def test_ingest(spark):
    data = random.Random(4).randbytes(3000)
    files = spark.createDataFrame([(1, "/a.txt", bytearray(b"same " * 400)), (2, "/b.txt", bytearray(b"same " * 400)), (3, "/c.zip", bytearray(b"\0" * 900)), (4, "/d", bytearray(data))], "inode long, path string, content binary")
    none = spark.createDataFrame([], "object_id string, plaintext_hash string")
    done = ingest.ingest(files, none, bytes(32), 5, (256, 1024, 4096))
    opened = sealing.open_sealed(done.objects.withColumnRenamed("bytes", "sealed").join(done.index.select("object_id", "record"), "object_id"), bytes(32))
    whole = content.whole(done.extents, opened.select("object_id", "data"), files.select("inode", F.octet_length("content").cast("long").alias("size")))
    assert {r.inode: bytes(r.content) for r in whole.collect()} == {r.inode: bytes(r.content) for r in files.collect()}
    assert done.objects.count() == done.queue.count() == done.index.select("plaintext_hash").distinct().count()
    again = ingest.ingest(files, done.index, bytes(32), 6, (256, 1024, 4096))
    assert again.objects.isEmpty() and rows(again.extents) == rows(done.extents)
    assert ingest.stats(files, again).first().dedup_percent == 100.0
    codec = done.index.where(F.col("plaintext_hash").isin([sha(b"\0" * 900), sha(b"\0" * 256)])).select((F.col("comp_type") % 128).alias("c")).collect()
    assert {r.c for r in codec} <= {0}
    with pytest.raises(ValueError):
        ingest.check_settings("rot13", "zstd", "none", 0, 1)


def test_sealing_across_archives(spark):
    texts = [b"one plain text " * 30, b"", b"x"]
    plain = spark.createDataFrame([(sha(t), len(t), bytearray(t)) for t in texts], "plaintext_hash string, plain_len long, data binary")
    a, d = bytes(32), bytes([1]) * 32
    sealed = pool.seal_shared(sealing.compress(plain), a, d, key_seed="s").withColumn("domain", F.col("plain_len") > 5)
    good = pool.open_auto(sealed, a, d).collect()
    assert {bytes(r.data) for r in good} == set(texts) and {r.status for r in good} == {"ok"}
    assert sorted(r.status for r in pool.open_auto(sealed, a, None).collect()) == ["no domain key", "ok", "ok"]
    assert sorted(r.status for r in pool.open_auto(sealed, a, a).collect()) == ["bad record", "ok", "ok"]  # no fall-back to the other record
    broken = sealed.withColumn("sealed", F.overlay("sealed", F.lit(bytearray(b"!")), F.lit(1)))
    assert {r.status for r in pool.open_auto(broken, a, d).collect()} == {"object hash"}
    record = pool.pack_record(F.lit(bytearray(32)), F.lit(129), F.lit(1), F.lit(2**40 + 3), F.lit(7), F.lit("ab" * 32), F.lit("cd" * 32))
    r = spark.range(1).select(F.octet_length(record).alias("n"), pool.parse_record(record).alias("r"), pool.parse_record(F.lit(bytearray(119))).alias("bad")).first()
    assert r.n == 119 and r.bad is None and (r.r.comp_type, r.r.cipher, r.r.plain_len, r.r.sealed_len, r.r.object_id) == (129, 1, 2**40 + 3, 7, "ab" * 32)


def test_names_containers_and_settings(spark):
    names = spark.createDataFrame([(n,) for n in ("a", "ü" * 40, "x" * 62, "x" * 63, "")], "n string")
    hidden = names.select("n", pool.hide_name(F.col("n"), bytes(32)).alias("h"))
    out = hidden.select("n", pool.show_name(F.col("h"), bytes(32)).alias("back"), pool.show_name(F.col("h"), bytes([1]) * 32).alias("wrong"), F.octet_length("h").alias("size")).collect()
    assert all(r.n == r.back and r.wrong is None for r in out) and len({r.size for r in out}) == 2
    box = pool.wrap_inline(F.lit(bytearray(b"rec")), F.lit(bytearray(b"cipher")))
    r = spark.range(1).select(pool.unwrap_inline(box).alias("b"), pool.unwrap_inline(F.lit(bytearray(b"no"))).alias("bad")).first()
    assert (bytes(r.b.record), bytes(r.b.sealed), r.bad) == (b"rec", b"cipher", None)
    sealed = pool.seal_setting(F.lit("value"), bytes(32))
    r = spark.range(1).select(pool.open_setting(sealed, bytes(32)).alias("a"), pool.open_setting(F.lit("plain"), bytes(32)).alias("b"), pool.open_setting(sealed, bytes([2]) * 32).alias("c")).first()
    assert tuple(r) == ("value", "plain", None)
    r = spark.range(1).select(pool.cipher_pair_valid(F.lit("AES-256-GCM"), F.lit(0)).alias("a"), pool.cipher_pair_valid(F.lit("aes256gcm"), F.lit(1)).alias("b"), pool.cipher_pair_valid(F.lit("x"), F.lit(0)).alias("c")).first()
    assert tuple(r) == (True, False, False)
    one = spark.range(1).select(pool.shared_content_id("ns", b"s" * 32, F.lit("t")).alias("a"), pool.shared_content_id("other", b"s" * 32, F.lit("t")).alias("b")).first()
    assert one.a != one.b and len(one.a) == 64


def test_log_streams(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text('{"ts": "2024-01-01T10:00:00Z", "event_type": "gc", "value": 1.5}\nbroken\n{"ts": "2024-01-01T11:00:00Z", "event_type": "gc", "value": 2}\n{"ts": "2024-01-09T00:00:00Z", "event_type": "prune", "value": 1}\n')
    events = jobs.log_stream(spark, f"{tmp_path}/log", "ts timestamp, event_type string, value double")
    sink = f"{tmp_path}/out"
    assert jobs.event_counts(events).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(sink).awaitTermination(90)
    assert [(r.event_type, r.n, r.value) for r in spark.read.parquet(sink).collect()] == [("gc", 2, 3.5)]  # the other window is still open


def test_buffered_writes(spark, tmp_path):
    ops = [(1, 0, 0, b"ab"), (1, 1, 2, b"cd"), (1, 2, 9, b"z"), (2, 0, 5, b"q" * 12)]
    spark.createDataFrame([(i, s, o, bytearray(d)) for i, s, o, d in ops], "inode long, seq long, offset long, data binary").coalesce(1).write.parquet(f"{tmp_path}/ops")
    stream = spark.readStream.schema("inode long, seq long, offset long, data binary").parquet(f"{tmp_path}/ops")
    sink = f"{tmp_path}/runs"
    query = jobs.buffered_writes(stream, 10).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start(sink)
    got, want, until = set(), {(1, 0, b"abcd"), (1, 9, b"z"), (2, 5, b"q" * 12)}, time.time() + 90
    (tmp_path / "runs").mkdir(exist_ok=True)
    try:
        while got != want and time.time() < until:  # the last run comes by the timeout
            time.sleep(1)
            got = {(r.inode, r.offset, bytes(r.data)) for r in spark.read.schema("inode long, offset long, data binary").parquet(sink).collect()}
    finally:
        query.stop()
    assert got == want


@pytest.fixture
def state(spark):
    """Files with contents: the folder /a/b holds f, whose second name is /g."""
    data = {10: b"first file", 11: b"", 12: b"x" * 700}
    put = lambda b: hashlib.sha256(b + b"|%d" % len(b)).hexdigest()
    nodes = [(1, DIR, 0, None), (2, DIR, 0, None), (3, DIR, 0, None), *[(i, FILE, len(b), put(b)) for i, b in data.items()], (13, FILE, 0, None)]
    names = [(1, "a", 2), (2, "b", 3), (3, "f", 10), (1, "g", 10), (1, "h", 11), (2, "i", 12), (2, "j", 13)]
    return {
        "inodes": spark.createDataFrame(nodes, "id long, mode long, size long, file_digest string"),
        "dentries": spark.createDataFrame(names, "parent_inode long, name string, inode_id long"),
        "file_chunks": spark.createDataFrame([(i, 0, sha(b), len(b)) for i, b in data.items() if b], "inode long, offset long, object_id string, plain_len long"),
        "snapshots": spark.createDataFrame([], "id long, name string, timestamp long, tree_root string"),
        "snapshot_controls": spark.createDataFrame([], "snapshot_id long, protected boolean, tags_json string"),
        "config": spark.createDataFrame([("k", "v")], "key string, value string"),
    }, spark.createDataFrame([(sha(b), bytearray(b)) for b in data.values()], "object_id string, data binary")


def test_partial_restore(spark, state, tmp_path):
    tables, objects = state
    tables["inodes"] = tables["inodes"].where("id <> 13")
    tables["dentries"] = tables["dentries"].where("inode_id <> 13")
    after = snapshots.create(tables, f"{tmp_path}/s", "one", 1)
    root = after["snapshots"].first().tree_root
    ask = spark.createDataFrame([("a/b/f",), ("/g",), ("/h",), ("/a",), ("/no",), ("/a/../g",), ("/g",)], "path string")
    get = lambda frozen, objects, root: {r.path: (r.content and bytes(r.content), r.status) for r in snapshots.restore_paths(frozen, objects, root, ask).collect()}
    got = get(tables, objects, root)
    assert got == {"a/b/f": (b"first file", "ok"), "/g": (b"first file", "ok"), "/h": (b"", "ok"), "/a": (None, "not a file"), "/no": (None, "missing"), "/a/../g": (None, "missing")}
    # another mode of another file is a change that the root does not prove; damaged bytes are told first
    moved = tables | {"inodes": tables["inodes"].withColumn("mode", F.when(F.col("id") == 12, FILE + 1).otherwise(F.col("mode")))}
    damaged = objects.withColumn("data", F.when(F.col("object_id") == sha(b"first file"), F.lit(bytearray(b"fIrst file"))).otherwise(F.col("data")))
    got = get(moved, damaged, root)
    assert got["a/b/f"] == got["/g"] == (None, "digest") and got["/h"] == (None, "not proved")
    for checkpoint, why in ((None, "no_checkpoint"), ((2, root), "rolled_back"), ((1, "x"), "tampered")):
        with pytest.raises(ValueError, match=why):
            snapshots.restore_from(after, f"{tmp_path}/s", 1, checkpoint, objects, ask)


def test_history_and_plans(spark, state, tmp_path):
    tables, _ = state
    tables = tables | {"snapshots": spark.createDataFrame([(i, f"n{i}", i, None) for i in (3, 1, 2)], tables["snapshots"].schema)}
    tables, archive_id, revision, found = snapshots.history(tables, "id")
    assert (archive_id, revision, [r.name for r in found.collect()]) == ("id", 0, ["n1", "n2", "n3"]) and snapshots.history(tables, "other")[1] == "id"
    tables = snapshots.set_controls(tables, spark.createDataFrame([(2, True, None)], "snapshot_id long, protected boolean, tags_json string"))
    tables = snapshots.set_controls(tables, spark.createDataFrame([(2, None, '["x"]')], "snapshot_id long, protected boolean, tags_json string"))
    assert rows(snapshots.controls(tables)) == [(1, False, []), (2, True, ["x"]), (3, False, [])] and snapshots.revision(tables["config"]) == 2
    with pytest.raises(ValueError, match="unknown snapshot id 9"):
        snapshots.set_controls(tables, spark.createDataFrame([(9, True, None)], "snapshot_id long, protected boolean, tags_json string"))
    plan = lambda *a, **k: snapshots.apply_plan(tables, f"{tmp_path}/s", *a, **k)[1]
    assert plan("id", 1, [1]) == "STALE_HISTORY" and plan("no", 2, [1]) == "WRONG_ARCHIVE" and plan("id", 2, [1, 2]) == "SNAPSHOT_PROTECTED" and plan("id", 2, []) == "NOOP"
    tables, outcome = snapshots.apply_plan(tables, f"{tmp_path}/s", "id", 2, [1, 3])
    assert outcome == "APPLIED" and [r.id for r in tables["snapshots"].collect()] == [2] and snapshots.revision(tables["config"]) == 3
    with pytest.raises(ValueError):
        snapshots.revision(spark.createDataFrame([(snapshots.REVISION, "x")], "key string, value string"))
    known = spark.createDataFrame([("a", 9, "r"), ("b", 1, "s")], "archive string, seq long, root string")
    assert rows(snapshots.anchor(known, "a", 2, "t")) == [("a", 2, "t"), ("b", 1, "s")]
    with pytest.raises(ValueError):
        snapshots.anchor(known, "a", 2, None)
    copied = snapshots.copy(tables, f"{tmp_path}/copy")
    assert copied["snapshots"].isEmpty() and rows(copied["dentries"]) == rows(tables["dentries"])


def test_index_sync(spark, tmp_path):
    rows_ = [(i, f"line\n{i}" if i % 3 else None, bytearray([i % 256])) for i in range(9000)]
    tables = {"t": spark.createDataFrame(rows_, "id long, text string, data binary").withColumn("at", F.timestamp_micros(F.col("id") * 1001)), "none": spark.createDataFrame([], "x long")}
    a, b, key = stores.Store(spark, f"{tmp_path}/a"), stores.Store(spark, f"{tmp_path}/b"), bytes(32)
    assert index_sync.sync(tables, [a, b], key) == 1 and a.read().count() == 4 and index_sync.sync(tables, [a, b], key) is None
    more = tables | {"t": tables["t"].where("id <> 77")}
    assert index_sync.sync(more, [a, b], key) == 2 and a.read().count() == 5
    back = index_sync.restore(spark, [stores.Store(spark, f"{tmp_path}/c"), b], key)
    assert rows(back["t"].select("id", "text", "data", "at")) == rows(more["t"]) and back["none"].isEmpty()

    class Broken(stores.Store):
        def upload(self, objects):
            raise OSError

    with pytest.raises(OSError):  # no manifest names what was not uploaded
        index_sync.sync(tables, [a, Broken(spark, f"{tmp_path}/d")], key)
    assert index_sync.versions(a) == [2, 1] and index_sync.versions(stores.Store(spark, f"{tmp_path}/d")) == []
    with pytest.raises(ValueError, match="no store"):
        index_sync.restore(spark, [a, b], bytes([1]) * 32)
    for stamp in (5, 7, 6, 10):
        left = index_sync.backup({"t": tables["t"]}, f"{tmp_path}/idx", stamp, keep=2)
    assert left == ["idx.indexbak.10", "idx.indexbak.7"] and not (tmp_path / "idx.indexbak.5").exists()


def test_shared_pool(spark, tmp_path):
    key = bytes(range(32))
    shared = stores.SharedPool(spark, f"{tmp_path}/pool", "ns", key)

    def offers(*rows_, seed):
        plain = spark.createDataFrame([(c, a, s, sha(t), len(t), bytearray(t)) for c, a, s, t in rows_], "content_id string, archive int, seq int, plaintext_hash string, plain_len long, data binary")
        sealed = pool.seal_shared(sealing.compress(plain), key, key, key_seed=seed)
        return sealed.select("content_id", "archive", "seq", "object_id", F.col("sealed").alias("bytes"), F.col("shared_record").alias("record"), "plaintext_hash")

    text, other = b"a text " * 30, b"another " * 30
    one = shared.publish(offers(("c", 1, 2, text), ("c", 2, 1, text), ("d", 1, 1, other), seed="s"))
    assert {(r.content_id, r.archive): r.outcome for r in one.collect()} == {("c", 1): "adopted", ("c", 2): "published", ("d", 1): "published"}
    two = shared.publish(offers(("c", 3, 0, text), ("d", 3, 0, text), seed="t"))  # d claims the identity of another plaintext
    assert {r.content_id: r.outcome for r in two.collect()} == {"c": "adopted", "d": "refused"}
    assert {r.object_id for r in one.union(two).where("content_id = 'c'").collect()} == {r.object_id for r in shared.records().where("content_id = 'c'").collect()}
    wanted = spark.createDataFrame([("c",), ("e",)], "content_id string")
    assert {r.content_id: r.status for r in shared.checked(wanted).collect()} == {"c": "ok", "e": "absent"}
    assert {r.status for r in stores.SharedPool(spark, f"{tmp_path}/pool", "ns", bytes(32)).checked(wanted).collect()} == {"bad record", "absent"}
    for bad in ("", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            stores.SharedPool(spark, f"{tmp_path}/pool", bad, key)
    with pytest.raises(ValueError):
        shared.put(spark.createDataFrame([("no id", bytearray(b"x"))], "object_id string, bytes binary"))


def test_workers_get_and_give_bounded_batches(spark, monkeypatch):
    """200 objects of 300 kB in one partition; small ones that padding makes large; and large ones that pack small."""
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    rows_ = spark.range(0, 200, 1, 1).select("id", F.repeat(F.lit("some words "), 30_000).cast("binary").alias("data"))
    took = []
    with monkeypatch.context() as m:
        m.setattr(type(rows_), "mapInArrow", lambda self, run, schema: took.append(run))
        sealing.compress(rows_)
        sealing.decompress(rows_.withColumn("comp_type", F.lit(1)))
    sizes = rows_.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"]) for b in batches), "n long")
    assert sizes.agg(F.max("n")).first()[0] < 4 << 20
    pack, unpack = took
    few = pa.RecordBatch.from_pydict({"id": list(range(9000)), "data": [b"x"] * 9000})
    packed = list(pack([few]))
    assert max(b.nbytes for b in packed) < 4 << 20 and pa.Table.from_batches(packed).column("id").to_pylist() == list(range(9000))
    large = pa.RecordBatch.from_pydict({"id": list(range(50)), "data": [bytes(1 << 20)] * 50})
    opened = list(unpack(pack([large])))
    assert max(b.nbytes for b in opened) < 4 << 20 and {r["data"] for b in opened for r in b.to_pylist()} == {bytes(1 << 20)} and sum(map(len, opened)) == 50


def test_objects_apart_from_offers(spark, tmp_path):
    """Bytes are given once an object and move once, to one file a folder; offers that have no bytes anywhere raise."""
    key = bytes(range(32))
    shared = stores.SharedPool(spark, f"{tmp_path}/pool", "ns", key)
    plain = spark.createDataFrame([(sha(b"%d" % i), 3, bytearray(b"%d" % i)) for i in range(100, 1000)], "plaintext_hash string, plain_len long, data binary")
    sealed = pool.seal_shared(sealing.compress(plain), key, key, key_seed="s").cache()
    offers = sealed.select(F.col("plaintext_hash").alias("content_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("archive"), F.lit(0).alias("seq"), "object_id", F.col("shared_record").alias("record"), "plaintext_hash")
    out = shared.publish(offers, sealed.select("object_id", F.col("sealed").alias("bytes")))
    assert {tuple(r) for r in out.groupBy("archive", "outcome").count().collect()} == {(1, "published", 900), (2, "adopted", 900)}
    folders = [p for p in (tmp_path / "pool" / "ns" / "objects").iterdir() if p.is_dir()]
    assert len(folders) > 200 and all(len(list(p.glob("*.parquet"))) == 1 for p in folders)
    more = offers.withColumn("content_id", F.concat("content_id", F.lit("x")))
    none = sealed.limit(0).select("object_id", F.col("sealed").alias("bytes"))
    assert {r.outcome for r in shared.publish(more, none).collect()} == {"published", "adopted"}  # the objects are there
    with pytest.raises(ValueError, match="without bytes"):
        shared.publish(more.select(F.concat("content_id", F.lit("y")).alias("content_id"), "archive", "seq", F.sha2("object_id", 256).alias("object_id"), "record", "plaintext_hash"), none)
    a = stores.Store(spark, f"{tmp_path}/a")
    whole = sealed.select("object_id", F.col("sealed").alias("bytes"))
    a.upload(whole, whole.limit(10).select("object_id"))
    a.upload(whole, whole.limit(20).select("object_id"))
    assert a.read().count() == 20 and {r.status for r in a.check(whole).collect()} == {"ok", "missing"} and a.read().join(whole, ["object_id", "bytes"]).count() == 20


def test_more_changes(spark, tables):
    left = metadata.delete_inodes(tables, spark.createDataFrame([(10,)], "id long"))
    assert 10 not in {r.id for r in left["inodes"].collect()} and [r.inode for r in left["file_chunks"].collect()] == [12] and left["dentries"].count() == 7
    root = tables["inodes"].where("id = 1")
    empty = metadata.wipe(tables | {"config": spark.range(3)}, root)
    assert {k: t.count() for k, t in empty.items()} == {"inodes": 1, "dentries": 0, "file_chunks": 0, "config": 3}
    marks = metadata.mark_incomplete(metadata.mark_incomplete(spark.createDataFrame([], "inode long"), spark.range(2)), spark.range(1, 3))
    assert rows(marks) == [(0,), (1,), (2,)] and metadata.queue_length(marks).first().n == 3
    state = spark.createDataFrame([(1, 5, 7), (2, 5, 7), (3, 5, 7)], "inode long, size long, mtime long")
    after = spark.createDataFrame([(1, 5, 7), (2, 5, 8)], "inode long, size long, mtime long")
    seen = content.stable(state, after, spark.createDataFrame([(1, "verified"), (2, "changed"), (3, "verified")], "inode long, outcome string"))
    assert rows(seen) == [(1, "verified"), (2, "changed_during_read"), (3, "changed_during_read")] and content.tally(seen).first().asDict() == {"verified": 1, "missing_digest": 0, "changed": 0, "failed": 0, "changed_during_read": 2}
