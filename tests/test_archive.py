import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vaultlake.functions import digests, scalars
from vaultlake.operators import chunking, erasure, integrity, placement, relational, sealing, tree, versions, writes
from vaultlake.sources import archive


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dedup_stats_of_two_equal_files(spark):
    files = spark.createDataFrame([("a", 60_000), ("a", 60_000), ("t", 1100)], "object_id string, size long")
    got = relational.dedup_stats(files).first()
    assert (got.logical_bytes, got.unique_bytes, got.inline_bytes, got.unique_objects) == (121_100, 61_100, 1100, 2)
    assert got.savings_percent > 30
    assert relational.dedup_stats(files.limit(0)).first().savings_percent == 0


def test_diff_classes(spark):
    s = "path string, mode long, size long, object_id string"
    old = spark.createDataFrame([("d/f1", 1, 1, "a"), ("d/f2", 1, 1, "b"), ("old", 3, 0, "c"), ("same", 1, 1, "s")], s)
    new = spark.createDataFrame([("d/f1", 2, 1, "a"), ("d/f2", 1, 1, "x"), ("new", 3, 0, "c"), ("same", 1, 1, "s")], s)
    assert rows(versions.diff_entries(old, new)) == [("d/f1", "metadata_changed"), ("d/f2", "content_changed"), ("new", "added"), ("old", "removed")]
    assert ("d/f1", "modified") not in rows(versions.diff_paths(old, new))


def test_inventory_lists_unreferenced_only_if_complete(spark):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = spark.createDataFrame([(sha(b"good"),), (sha(b"missing"),)], "object_id string")
    have = spark.createDataFrame([(sha(b"good"), bytearray(b"good")), (sha(b"bad"), bytearray(b"bad"))], "object_id string, bytes binary")
    assert rows(relational.inventory(want, have)) == sorted([(sha(b"bad"), "unreferenced"), (sha(b"missing"), "missing")])
    assert rows(relational.inventory(want, have, complete=False)) == [(sha(b"missing"), "missing")]


def test_orphans_respect_grace_strictly_and_pins(spark):
    index = spark.createDataFrame([("h1", 1000), ("h2", 1000 - 3600), ("pin", 0)], "object_id string, created_at long")
    none = index.limit(0)
    pins = index.where("object_id = 'pin'")
    assert rows(relational.orphans(index, none, pins, 1000 + 3600, 1).select("object_id")) == [("h2",)]
    assert rows(relational.orphans(index, none, none, 1000 + 3600, 0).select("object_id")) == [("h1",), ("h2",), ("pin",)]


def test_retention_ties_go_opposite_ways(spark):
    day = 86_400
    snaps = spark.createDataFrame([(1, 1, 10 * day, False), (1, 2, 10 * day, False), (1, 3, 9 * day, False), (1, 4, 0, True)], "archive long, id long, timestamp long, protected boolean")
    assert [r.id for r in versions.retention(snaps, daily=1).where("kept").orderBy("id").collect()] == [1, 4]
    assert [r.id for r in versions.keep_newest(snaps, 1).where("kept").collect()] == [2]
    assert versions.retention(snaps).where("kept").count() == 4


def test_checkpoint_only_advances(spark):
    s = "archive long, seq long, root string"
    now = spark.createDataFrame([(1, 5, "a")], s)
    offers = spark.createDataFrame([(1, 5, "b"), (1, 4, "c"), (2, 1, "d"), (3, 9, None)], s)
    assert rows(versions.advance_checkpoint(now, offers)) == [(1, 5, "a"), (2, 1, "d")]


def test_tree_hash_is_null_above_a_missing_digest(spark):
    files = spark.createDataFrame([(10, "/d/f", "x"), (11, "/e/g", "y")], "inode long, path string, content string")
    full = files.select("inode", "path", F.lit(archive.FILE_MODE).cast("long").alias("mode"), F.lit(1).cast("long").alias("size"), digests.digest(F.col("content")).alias("object_id"), F.lit(0).cast("long").alias("mtime"))
    nodes, edges = archive.tree(full)
    root = lambda n: tree.tree_hashes(n, edges).where("depth = 0").first().hash
    assert root(nodes) == root(nodes) is not None
    assert root(nodes.withColumn("file_digest", F.when(F.col("id") != 10, F.col("file_digest")))) is None
    assert root(nodes.withColumn("file_digest", F.when(F.col("id") == 10, F.lit("z")).otherwise(F.col("file_digest")))) != root(nodes)
    assert tree.walk(edges).count() == 4
    assert tree.creates_cycle(tree.walk(edges), "/d", "/d") and not tree.creates_cycle(tree.walk(edges), "/d", "/e")


def test_walk_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "c", 2)], "parent_inode long, name string, inode_id long")
    assert [r.path for r in tree.walk(edges).orderBy("depth").collect()] == ["/a", "/a/b"]


def test_merkle_proofs(spark):
    leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(5)]
    root = digests.merkle_root_local(leaves)
    data = [(leaf, i, *digests.merkle_proof_local(leaves, i), root) for i, leaf in enumerate(leaves)] + [("0" * 64, 1, *digests.merkle_proof_local(leaves, 1), root)]
    df = spark.createDataFrame(data, "leaf string, i long, sib array<string>, levels int, root string")
    ok = df.select(digests.verify_inclusion(*[F.col(c) for c in ("leaf", "i", "sib", "levels", "root")]).alias("ok")).collect()
    assert [r.ok for r in ok] == [True] * 5 + [False]
    assert digests.merkle_root_local([]) == digests.EMPTY_ROOT


def test_folds_over_block_edges_need_few_joins(spark):
    sizes = (1, 2, 3, 1023, 1025, 2500)
    lists = {n: [hashlib.sha256(b"%d %d" % (n, i)).hexdigest() for i in range(n)] for n in sizes}
    leaves = spark.createDataFrame([(n, i, h) for n, xs in lists.items() for i, h in enumerate(xs)], "d long, at long, hash string")
    folds = tree.Folds(leaves, "d", "at")
    assert {r.dir: r.root for r in folds.roots().collect()} == {n: digests.merkle_root_local(xs) for n, xs in lists.items()}
    wanted = [(n, i) for n in sizes for i in {0, n // 2, n - 1, min(n - 1, 1023), min(n - 1, 1024)}]
    proofs = folds.proofs(spark.createDataFrame(wanted, "dir long, i long"))
    assert {(r.dir, r.i): (r.siblings, r.levels) for r in proofs.collect()} == {(n, i): digests.merkle_proof_local(lists[n], i) for n, i in wanted}
    assert proofs._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3


def test_keyed_digest_is_hmac(spark):
    got = spark.createDataFrame([("abc",)], "x string").select(digests.keyed(b"k" * 40, F.col("x"))).first()[0]
    assert got == digests.keyed_local(b"k" * 40, b"abc")


@pytest.mark.parametrize(("pattern", "path", "hit"), [("**/drop.txt", "/drop.txt", True), ("**/drop.txt", "/a/b/drop.txt", True), ("*.txt", "/a/b.txt", True), ("a?c", "/abc", True), ("[!x]b", "/xb", False), ("sub", "/sub/inner.txt", False)])
def test_globs(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(scalars.matches(F.col("p"), pattern)).first()[0] is hit


@pytest.mark.parametrize("sizes", [(16, 64, 256), (256, 1024, 4096)])
def test_chunks(sizes):
    rng = random.Random(1)
    for data in (b"", b"x", bytes(5000), rng.randbytes(20_000), rng.randbytes(sizes[2] + 1)):
        ends = chunking.cut_points(data, *sizes)
        lengths = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert sum(lengths) == len(data) and all(0 < n <= sizes[2] for n in lengths) and all(n >= sizes[0] for n in lengths[:-1])
    a = rng.randbytes(20_000)
    cut = lambda d: {d[x:y] for x, y in zip([0, *chunking.cut_points(d, *sizes)], chunking.cut_points(d, *sizes), strict=False)}
    assert len(cut(a) & cut(b"inserted" + a)) > 0.5 * len(cut(a))


def test_assemble_fills_holes(spark):
    ext = spark.createDataFrame([(1, 2, "o")], "inode long, offset long, object_id string")
    objects = spark.createDataFrame([("o", bytearray(b"ab"))], "object_id string, data binary")
    sizes = spark.createDataFrame([(1, 6), (2, 3), (3, 0)], "inode long, size long")
    assert {r.inode: bytes(r.content) for r in chunking.assemble(ext, objects, sizes).collect()} == {1: b"\0\0ab\0\0", 2: b"\0\0\0", 3: b""}


def test_seal_detects_damage(spark):
    data = b"some plain text " * 100
    rows_ = spark.createDataFrame([(hashlib.sha256(data).hexdigest(), len(data), bytearray(data))], "plaintext_hash string, plain_len long, data binary")
    key = bytes(32)
    sealed = sealing.seal(sealing.compress(rows_), key, key_seed="t")
    good = sealing.open_sealed(sealed, key).first()
    assert good.status == "ok" and bytes(good.data) == data
    assert sealing.open_sealed(sealed, bytes([1]) * 32).first().status == "bad record"
    assert sealing.open_sealed(sealed.withColumn("sealed", F.overlay("sealed", F.lit(bytearray(b"x")), F.lit(1))), key).first().status == "object hash"


@pytest.mark.parametrize(("mode", "n"), [("raid5", 2), ("raid5", 4), ("raid6", 3), ("raid6", 5)])
def test_erasure_survives_its_losses(mode, n):
    data = random.Random(2).randbytes(1000)
    oid, parity = hashlib.sha256(data).hexdigest(), erasure.PARITY[mode]
    full = erasure.encode(data, n, mode)
    for i in range(n):
        for j in range(i, n):
            lost = {i, j} if parity == 2 else {i}
            assert erasure.decode([None if k in lost else s for k, s in enumerate(full)], mode, oid)[0] == data
            bad = [bytes([s[0] ^ 1]) + s[1:] if k in lost else s for k, s in enumerate(full)]
            assert erasure.decode(bad, mode, oid) == (data, sorted(lost))
    assert erasure.decode([None] * (parity + 1) + full[parity + 1 :], mode, oid) == (None, [])


def test_placement_and_repair(spark):
    with pytest.raises(ValueError, match="even"):
        placement.targets(F.lit("x"), "raid10", 3)
    o1, o2 = (hashlib.sha256(x).hexdigest() for x in (b"1", b"2"))
    objects = spark.createDataFrame([(o1,), (o2,)], "object_id string")
    held = spark.createDataFrame([(o1, 0, bytearray(b"x")), (o1, 1, bytearray(b"1")), (o2, 0, bytearray(b"y"))], "object_id string, backend int, bytes binary")
    plan = placement.repair_plan(placement.audit(objects, held, "raid1", 2))
    assert rows(plan) == sorted([(o1, 0, 1), (o2, 0, None), (o2, 1, None)], key=repr)
    assert [(r.object_id, r.backend, bytes(r.bytes)) for r in placement.heal(plan, held).collect()] == [(o1, 0, b"1")]
    assert placement.default_mode(None, 3) == "raid0" and placement.default_mode(None, 1) == "none"
    for bad in (lambda: placement.default_mode("raid6", 2), lambda: placement.targets(F.lit("x"), "raid7", 3), lambda: placement.check_topology(2, 3)):
        with pytest.raises(ValueError):
            bad()


def test_extent_algebra(spark):
    ext = spark.createDataFrame([(1, 0, "a", 10), (1, 10, "b", 10), (1, 20, "c", 10)], "inode long, offset long, object_id string, plain_len long")
    assert rows(integrity.punch(ext, 5, 25).select("offset", "object_id", "plain_len", "skip")) == [(0, "a", 5, 0), (25, "c", 5, 5)]
    assert rows(integrity.drop_range(ext, 5, 20).select("offset", "plain_len")) == [(0, 5), (20, 10)]
    sizes = spark.createDataFrame([(1, 15)], "inode long, new_size long")
    assert rows(integrity.truncate(ext, sizes).select("offset", "plain_len")) == [(0, 10), (10, 5)]
    inner = integrity.punch(ext.where("offset = 0"), 2, 4)
    assert rows(inner.select("offset", "plain_len", "skip")) == [(0, 2, 0), (4, 6, 4)]


def test_writes_against_a_byte_model(spark):
    rng, ops, model = random.Random(3), [], {}
    for inode in range(20):
        buf = b""
        for seq in range(rng.randint(1, 12)):
            if rng.random() < 0.6:
                at, data = rng.randrange(300), rng.randbytes(rng.randint(1, 50))
                ops.append((inode, seq, "write", at, bytearray(data), 0))
                buf = buf.ljust(at, b"\0")[:at] + data + buf[at + len(data) :]
            else:
                n = rng.randrange(300)
                ops.append((inode, seq, "truncate", 0, None, n))
                buf = buf[:n].ljust(n, b"\0")
        model[inode] = buf
    rng.shuffle(ops)
    df = spark.createDataFrame(ops, "inode long, seq int, op string, offset long, data binary, size long")
    files = spark.createDataFrame([(i, bytearray()) for i in range(20)], "inode long, content binary")
    assert {r.inode: bytes(r.content) for r in writes.apply(files, df).collect()} == model
