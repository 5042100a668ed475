"""Sharding by extendible hashing. DataFrame operations only.

A directory is indexed by the leading bits of a row's hash. A bucket over the byte limit splits on its next bit, others
stay, until every shard fits. The directory is made from byte histograms of the next bits, over rows of buckets that
are still too large, so that the driver sees only counts and no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialize
from .mixing import hash60

LIMIT = 1 << 20
_BITS, _ROUNDS = 10, 12  # ten bits a round, six rounds in each of two 60-bit hashes


def _prefix(depth: Column | int, h: str = "h", g: str = "g") -> Column:
    """The first `depth` bits of a row's 120, as a string of 0 and 1."""
    bits = F.concat(F.lpad(F.bin(h), 60, "0"), F.lpad(F.bin(g), 60, "0"))
    return F.substring(bits, F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes) for each row of docs; other columns are ignored.

    n_bytes is the UTF-8 size of the text, 0 for a null one. shard is the hash prefix, depth bits long, of the
    shallowest bucket whose rows fit limit. A row over the limit cannot fit any shard: it has one of its own, named
    "large:" and its id's hash, with the row's own where rows are alike, with depth null, and takes no part in splits. The hash is of (id, n_bytes); rows alike in
    both, nulls among them, share 60 bits and then part by a row number, so that copies in any number split too.
    Empty input gives no rows.
    """
    n = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    key = hash60(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.col("n_bytes").cast("string")))
    rows = docs.select(F.col(id_col), n.alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.select(id_col, "n_bytes", key.alias("h"), hash60(F.concat(F.lit("row"), F.col("row"))).alias("g")))
    fits = rows.where(F.col("n_bytes") <= limit)
    open_, leaves, n_leaves = fits, [], 0
    for step in range(_ROUNDS):
        low, high = step * _BITS, (step + 1) * _BITS
        fine = open_.groupBy(_prefix(high).alias("p")).agg(F.sum("n_bytes").alias("b"))
        depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        tree = fine.select("b", "p", depths).groupBy(F.substring("p", F.lit(1), F.col("depth")).alias("shard"), "depth").agg(F.sum("b").alias("bytes"))
        tree = materialize(tree)
        full = tree.where((F.col("bytes") > limit) & (F.col("depth") < high))
        # a bucket is a leaf if it fits and the one above it does not
        above = full.select(F.col("shard").alias("over"))
        leaf = tree.where((F.col("bytes") <= limit) & (F.col("depth") > low)).join(above, F.expr("substring(shard, 1, depth - 1)") == F.col("over"), "left_semi")
        if step == 0:
            leaf = leaf.unionByName(tree.where((F.col("depth") == 0) & (F.col("bytes") <= limit)))
        leaf = materialize(leaf)
        leaves.append(leaf)
        n_leaves += leaf.count()
        over = materialize(tree.where((F.col("bytes") > limit) & (F.col("depth") == high)).select(F.col("shard").alias("over")))
        n_over = over.count()
        if not n_over:
            break
        open_ = open_.join(bounded_broadcast(over, n_over, 160), _prefix(high) == F.col("over"), "left_semi")
    else:
        raise ValueError(f"rows over the limit that {_ROUNDS * _BITS} bits do not part")
    directory = leaves[0]
    for leaf in leaves[1:]:
        directory = directory.unionByName(leaf)
    directory = materialize(directory)
    # the depths in use are few: a row looks itself up under each
    found = None
    depths = [r[0] for r in directory.select("depth").distinct().orderBy("depth").collect()]  # at most 121 numbers
    if depths:
        tries = fits.select(id_col, "n_bytes", F.explode(F.array(*[_prefix(d) for d in depths])).alias("shard"))
        found = tries.join(bounded_broadcast(directory, n_leaves, 200), "shard").select(id_col, "n_bytes", "shard", "depth", F.col("bytes").alias("shard_bytes"))
    large = rows.where(F.col("n_bytes") > limit)
    shared = large.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("twin"))
    own = F.concat(F.lit("large:"), F.col("h").cast("string"), F.when(F.col("twin").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("g").cast("string"))))
    large = large.join(shared, F.col("h") == F.col("twin"), "left").select(
        id_col, "n_bytes", own.alias("shard"), F.lit(None).cast("int").alias("depth"), F.col("n_bytes").alias("shard_bytes")
    )
    return large if found is None else found.unionByName(large)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT n_bytes FROM documents),
k AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || n_bytes), 1, 15))::BIGINT h FROM d),
b AS (SELECT *, lpad(bin(h), 60, '0') bits FROM k WHERE n_bytes <= 1048576),
p AS (SELECT doc_id, n_bytes, g.depth, substr(bits, 1, g.depth) shard FROM b, range(0, 31) g(depth)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, shard) shard_bytes FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n_bytes ORDER BY depth) i FROM s WHERE shard_bytes <= 1048576)
SELECT doc_id, n_bytes, shard, depth::INTEGER depth, shard_bytes::BIGINT shard_bytes FROM r WHERE i = 1
UNION ALL SELECT doc_id, n_bytes, 'large:' || h, NULL, n_bytes FROM k WHERE n_bytes > 1048576
"""
