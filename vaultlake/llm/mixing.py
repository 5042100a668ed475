"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket, the bucket in which a source's budget ends is refined on the next bits,
and a document is taken by comparing its hash with the threshold found. Nothing is sorted, and the driver sees only
totals, so the work is one pass over the texts and a few passes over (id, source, size, hash) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, bounded_broadcast, materialize

WEIGHTS = (5, 2, 1)
CAP = 3
_BITS, _DIGITS = 12, 5  # five digits of 12 bits in each of the 60-bit hashes
_PARTS = ("h", "g", "r")  # of (doc_id, size), of the row's content, and of a row number that parts equal rows


def hash60(value: Column) -> Column:
    """The first 60 bits of MD5, as SQL engines other than Spark can form them too."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(k, source, source_size, target) with one row a source.

    Sources in code-point order, null last, take the weights in turn. They share the sum of all sizes; what would pass
    cap times a source's size is shared again by weight. Ranks come from a range-partitioned sort and partition
    counts, and the sharing from scalar sums, so that any number of sources works.
    """
    found = sized.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    ordered = found.orderBy(F.col("source").asc_nulls_last())
    ordered = materialize(ordered.withColumns({"p": F.spark_partition_id(), "m": F.monotonically_increasing_id()}))
    start, starts = 0, {}
    for p, n in sorted(tuple(r) for r in ordered.groupBy("p").count().collect()):  # one row a shuffle partition
        starts[p], start = start, start + n
    if not starts:
        return ordered.select("k", "source", "source_size", F.lit(0.0).alias("target"))
    base = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    rank = base[F.col("p")] + F.col("m").bitwiseAND((1 << 33) - 1)
    weight = F.array(*map(F.lit, weights))[F.pmod(rank, F.lit(len(weights))).cast("int")]
    ranked = ordered.select("k", "source", "source_size", weight.alias("w"))
    size, w = F.col("source_size"), F.col("w")
    total, share = ranked.agg(F.sum(size), F.sum(w)).first()
    level = total / share
    while True:
        over = w * F.lit(level) > cap * size
        fixed, rest = ranked.agg(F.sum(F.when(over, cap * size).otherwise(0)), F.sum(F.when(over, 0).otherwise(w))).first()
        new = (total - fixed) / rest if rest else level
        if new == level:
            break
        level = new
    target = F.least(w * F.lit(level), (cap * size).cast("double"))
    return ranked.select("k", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source; others ignored).

    size is the number of words, 0 for a null text. Whole passes over a source are nested budgets: pass i has the
    threshold "all" while target >= i * source_size, and the last, partial pass takes the documents whose hash lies
    under its threshold; the document at the threshold is taken if that comes nearer to the target. So taken is size
    times the passes that reach the document, at most cap times its size. The hash is of (doc_id, size); rows alike
    in both are told apart by a digest of their text, and equal ones by a row number, which cannot change the rows
    returned. Null ids and sources are values like others; whole texts of any length count; empty input gives no rows.
    """
    return _passes(docs.select("doc_id", "text", "source", F.xxhash64("text").alias("mark__")), [], weights, cap).select("doc_id", "size", "source_size", "target", "taken")


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each row of docs as often as passes reach it, columns as given. Texts without words drop out.

    Rows are chosen by their content alone: reruns and other partitions of the input give the same rows, also where
    doc_id is null or repeated.
    """
    given = F.struct(*[F.col(c).alias(c) for c in docs.columns]).alias("given")
    mark = F.xxhash64(*[F.col(c) for c in sorted(docs.columns)]).alias("mark__")
    out = _passes(docs.select("doc_id", "text", "source", mark, given), ["given"], weights, cap)
    times = F.when(F.col("size") > 0, F.expr("int(taken div size)")).otherwise(0)
    rows = out.where("taken > 0").select("given", F.explode(F.sequence(F.lit(1), times)))
    return rows.select(*[F.col("given").getField(c).alias(c) for c in docs.columns])


def _passes(docs: DataFrame, more: list[str], weights: tuple[int, ...], cap: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", "mark__", *more, size.alias("size"), F.monotonically_increasing_id().alias("row"))
    sized = materialize(
        rows.select(
            "doc_id", "source", "size", *more, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("k"),
            hash60(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("size"))).alias("h"),
            hash60(F.concat(F.lit("mark"), F.col("mark__"))).alias("g"), hash60(F.concat(F.lit("row"), F.col("row"))).alias("r"),
        )
    )
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0)
    state = source_targets(sized, weights, cap).withColumn("full", full.cast("long"))
    zero = F.lit(0).cast("long")
    state = state.withColumns({"rest": F.when(F.col("full") >= cap, 0.0).otherwise(F.col("target") - F.col("full") * F.col("source_size")),
                               **{f"at_{x}": zero for x in _PARTS}, "edge": zero})
    state = materialize(state.withColumn("open", F.col("rest") > 0))
    n_sources, width = state.agg(F.count("*"), F.coalesce(F.max(F.length("k")), F.lit(0))).first()
    small = lambda df: bounded_broadcast(df, n_sources, 4 * width + 110)
    digits = [f"at_{x}" for x in _PARTS]

    def inside(level: int) -> Column:
        """The row's hashes begin with the digits found so far, level of them."""
        out = F.lit(True)
        for i, x in enumerate(_PARTS):
            n = min(max(level - i * _DIGITS, 0), _DIGITS) * _BITS
            if n:
                out = out & (F.shiftright(x, 60 - n) == F.shiftright(f"at_{x}", 60 - n))
        return out

    near = sized.where("size > 0").join(small(state.where("open").select("k")), "k").select("k", "size", *_PARTS)
    for level in range(len(_PARTS) * _DIGITS):
        part = _PARTS[level // _DIGITS]
        shift = 60 - _BITS * (level % _DIGITS + 1)
        digit = F.shiftright(F.col(part), shift).bitwiseAND((1 << _BITS) - 1)
        histogram = near.groupBy("k", digit.alias("digit")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        upto = F.sum("sum").over(Window.partitionBy("k").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        edge = histogram.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("sum"))
        found = edge.join(small(state.select("k", "rest")), "k").where("before <= rest and rest < upto").select("k", "digit", "before", "sum", "n")
        at = f"at_{part}"
        state = state.drop("n").join(small(found), "k", "left").withColumns({
            at: F.col(at) + F.coalesce(F.shiftleft("digit", shift), zero),
            "rest": F.col("rest") - F.coalesce("before", F.lit(0)), "edge": F.coalesce("sum", "edge"),
        }).select("k", "source", "source_size", "target", "full", "rest", *digits, "edge", "open", "n")
        state = materialize(state)
        if (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        # from here on only the rows of the boundary buckets are read, a small part of all
        bounds = small(state.where("n > 0").select("k", *digits))
        near = materialize(near.join(bounds, "k").where(inside(level + 1)).select("k", "size", *_PARTS))
    below, same = F.lit(False), F.lit(True)
    for x in _PARTS:
        below = below | (same & (F.col(x) < F.col(f"at_{x}")))
        same = same & (F.col(x) == F.col(f"at_{x}"))
    last = inside(level + 1) & (F.col("rest") * 2 >= F.col("edge"))
    extra = F.when((F.col("size") > 0) & F.col("n").isNotNull() & (below | last), 1).otherwise(0)
    out = sized.join(small(state.drop("source")), "k")
    return out.select("doc_id", *more, "size", "source_size", "target", (F.col("size") * (F.col("full") + extra)).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / w, source) i FROM s),
c AS (SELECT i, coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT fixed,
  (sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT rest_w, (sum(source_size) OVER ())::BIGINT total, w, source_size FROM o),
l AS (SELECT (total - fixed)::DOUBLE / rest_w level FROM c WHERE w * ((total - fixed)::DOUBLE / rest_w) <= 3 * source_size ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, least(w * level, 3.0::DOUBLE * source_size) target FROM s, l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END full_ FROM t),
b AS (SELECT *, CASE WHEN full_ >= 3 THEN 0.0::DOUBLE ELSE target - full_ * source_size END rest FROM f),
h AS (SELECT r, source, size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size), 1, 15))::BIGINT h FROM d WHERE size > 0),
u AS (SELECT r, source, size, sum(size) OVER (PARTITION BY source ORDER BY h, r ROWS UNBOUNDED PRECEDING) upto FROM h)
SELECT d.doc_id, d.size, b.source_size::BIGINT source_size, b.target, (d.size * (b.full_ + CASE WHEN b.rest <= 0 OR u.r IS NULL THEN 0 WHEN u.upto <= b.rest THEN 1
  WHEN u.upto - u.size <= b.rest AND 2 * (b.rest - (u.upto - u.size)) >= u.size THEN 1 ELSE 0 END))::BIGINT taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN u ON d.r = u.r
"""
