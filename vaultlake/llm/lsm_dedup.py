"""Exact dedup by a log-structured merge index of text digests. DataFrame operations only.

Rows go to memtables, each of which is flushed as a run: one entry a digest, sorted, with the number of rows and the
identifier that stays, and a filter, a bitmap of the digests' hashes. The runs of a full level are compacted into one of
the next: each entry is looked up in the filters of the other runs, only entries that may stand in another are shuffled
and merged, and the rest is passed on. Digests that occur more than once are hits, and their texts are compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LEAST_FILES, ROWS_A_FILE, bounded_broadcast, discard, materialize, shielded

#: Into how many memtables a table is dealt, and how many runs of a level are compacted into one.
MEMTABLES, FANOUT = 4, 4
#: Bits of a filter for each row of the table, and what one bucket of a bitmap holds.
BITS_A_ROW, BUCKET = 16, 1 << 15


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def body(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


@dataclass
class Run:
    """entries (digest, n, doc_id, row), sorted by digest in each file: its rows and the one that stays; bits
    (bucket, bits): the filter; size: how many entries."""

    entries: DataFrame
    bits: DataFrame
    size: int


class Index:
    """Levels of runs. keep: whether the largest ("max") or smallest ("min") doc_id of a digest stays; null ids lose.

    capacity is the number of rows for which the filters are made; with more rows they let more entries through to the
    merge, and results stay the same. reads counts the runs whose entries a lookup has read.
    """

    def __init__(self, capacity: int, keep: str = "max") -> None:
        if keep not in ("max", "min"):
            raise ValueError("keep is min or max")
        self.cells = BUCKET
        while self.cells < capacity * BITS_A_ROW:
            self.cells *= 2
        self.keep, self.levels, self.reads = keep, [[]], 0

    def _winner(self, n: Column) -> list[Column]:
        """n, doc_id and row of the entry that stays, over fixed-width buffers, so that hashing does."""
        best, by = (F.max, F.max_by) if self.keep == "max" else (F.min, F.min_by)
        return [n.alias("n"), best("doc_id").alias("doc_id"), F.coalesce(by("row", "doc_id"), best("row")).alias("row")]

    def _cell(self) -> Column:
        return F.xxhash64("digest").bitwiseAND(self.cells - 1) + 1

    def _filter(self, entries: DataFrame) -> DataFrame:
        cell = self._cell()
        bits = entries.select(F.bitmap_bucket_number(cell).alias("bucket"), F.bitmap_bit_position(cell).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
        return materialize(bits, self.cells // BUCKET)

    def _asked(self, entries: DataFrame, bits: DataFrame) -> DataFrame:
        """entries and maybe: whether the bit of the digest is set in a filter, as it is for all digests that went in."""
        cell = self._cell()
        asked = entries.withColumns({"bucket": F.bitmap_bucket_number(cell), "at": F.bitmap_bit_position(cell)})
        byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.expr("(shiftright(byte, cast(at % 8 AS int)) & 1) = 1")
        some = bounded_broadcast(bits, self.cells // BUCKET, BUCKET // 8 + 32)
        return asked.join(some, "bucket", "left").withColumn("byte", byte).select(*entries.columns, F.coalesce(is_set, F.lit(False)).alias("maybe"))

    def add(self, rows: DataFrame, n: int) -> None:
        """Flush a memtable of n rows (digest, doc_id, row) as a run of the first level, and compact levels that are full.

        The grouped maxima are combined in each task before the shuffle, so a digest that a third of all rows share
        moves one row a task.
        """
        entries = self._sorted(rows.groupBy("digest").agg(*self._winner(F.count("*"))), n)
        self._push(Run(entries, self._filter(entries), entries.count()), 0)

    def add_all(self, rows: DataFrame, n: int) -> None:
        """Flush several memtables of n rows (memtable, digest, doc_id, row) at once, one run each."""
        found = self._sorted(rows.groupBy("memtable", "digest").agg(*self._winner(F.count("*"))), n, "memtable")
        for r in sorted(tuple(r) for r in found.groupBy("memtable").count().collect()):  # one row a memtable
            entries = found.where(F.col("memtable") == r[0]).drop("memtable")
            self._push(Run(entries, self._filter(entries), r[1]), 0)

    def _sorted(self, entries: DataFrame, n: int, *first: str) -> DataFrame:
        return materialize(entries.coalesce(max(LEAST_FILES, -(-n // ROWS_A_FILE))).sortWithinPartitions(*first, "digest"))

    def _push(self, run: Run, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FANOUT:
            runs, self.levels[level] = self.levels[level], []
            self._push(self._compact(runs), level + 1)

    def shared(self, runs: list[Run]) -> DataFrame:
        """The entries of runs and maybe: whether another of them may hold the digest too, by its filter."""
        out = None
        for run in runs:
            bits = [r.bits for r in runs if r is not run]
            others = reduce(DataFrame.union, bits).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            own = self._asked(run.entries.select("digest", "n", "doc_id", "row"), others)
            out = own if out is None else out.union(own)
        return out

    def _compact(self, runs: list[Run]) -> Run:
        both, size = self.shared(runs), sum(r.size for r in runs)
        merged = both.where("maybe").groupBy("digest").agg(*self._winner(F.sum("n"))).select("digest", "n", "doc_id", "row")
        entries = self._sorted(both.where("NOT maybe").drop("maybe").union(merged), size)
        bits = materialize(reduce(DataFrame.union, (r.bits for r in runs)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")), self.cells // BUCKET)
        for old in runs:
            discard(old.entries)
            discard(old.bits)
        return Run(entries, bits, size)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, n, doc_id, row) of those digests that the index holds, merged over its runs. digests (digest) are
        distinct. A run whose filter has none of them is not read."""
        out = None
        for run in (r for level in self.levels for r in level):
            maybe = self._asked(digests.select("digest"), run.bits).where("maybe").select("digest")
            if not maybe.isEmpty():
                self.reads += 1
                found = run.entries.join(maybe, "digest", "left_semi").select("digest", "n", "doc_id", "row")
                out = found if out is None else out.union(found)
        if out is None:
            return digests.limit(0).selectExpr("digest", "0L AS n", "0L AS doc_id", "0L AS row")
        return out.groupBy("digest").agg(*self._winner(F.sum("n"))).select("digest", "n", "doc_id", "row")

    def whole(self) -> DataFrame:
        """(digest, n, doc_id, row) of all digests, after compacting what runs there are, one or more, into one."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            raise ValueError("an index without runs")
        if len(runs) > 1:
            runs = [self._compact(runs)]
            self.levels = [*([] for _ in self.levels), runs]
        return runs[0].entries.select("digest", "n", "doc_id", "row")


def hits_of(rows: DataFrame, total: int, keep: str = "max") -> DataFrame:
    """(digest, n, doc_id, row) for the digests that more than one of `total` rows (digest, doc_id, row) holds.

    Rows are dealt to MEMTABLES, whose runs are flushed by one job; the index then compacts them.
    """
    index = Index(total, keep)
    index.add_all(rows.withColumn("memtable", F.col("row") % MEMTABLES), total)
    return materialize(index.whole().where("n > 1"), total)


def rows_of_hits(docs: DataFrame, hits: DataFrame, n_hits: int, digest: Callable[[Column], Column]) -> DataFrame:
    """docs and the column digest, where it is among hits. Small hit lists are broadcast, others shuffled."""
    keyed = docs.withColumn("digest", digest(body()))
    return keyed.join(bounded_broadcast(hits.select("digest"), n_hits, 64), "digest", "left_semi")


def dedup(docs: DataFrame, keep: str = "max", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (doc_id, text; others ignored).

    Texts are equal when byte for byte identical; a null text counts as empty; texts of any length are compared whole.
    Of equal texts one row is kept: that with the largest doc_id (keep="max") or the smallest. Among repeated rows with
    this id exactly one has kept true. A null id is kept only where all of its group are null. Empty input gives no rows.

    The text column goes through hash aggregation only for hits, one text a task and group. Should different texts
    share a digest (with SHA-256 they do not), their groups are formed by the texts themselves.
    """
    docs = docs.select("doc_id", "text")
    rows = materialize(docs.select(digest(body()).alias("digest"), sha256(body()).alias("sha"), "doc_id", F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    hits = hits_of(rows.drop("sha"), total, keep) if total else rows
    n_hits = hits.count()
    if not n_hits:
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    texts = rows_of_hits(docs, hits, n_hits, digest).groupBy("digest", body().alias("body")).agg(F.count("*").alias("n"))
    clashes = texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
    clashes = materialize(clashes.select("digest"))
    n_clashes = clashes.count()
    won = hits.select("digest", "n", F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_row"))
    out = rows.join(bounded_broadcast(won, n_hits, 96), "digest", "left")
    if n_clashes:
        out = out.join(bounded_broadcast(clashes, n_clashes, 64), "digest", "left_anti")
    alone = F.col("kept_row").isNull()
    out = out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("kept_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("kept_row") == F.col("row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
    if not n_clashes:
        return out
    own = rows_of_hits(docs, clashes, n_clashes, digest).select("digest", body().alias("body"), "doc_id", F.monotonically_increasing_id().alias("row"))
    own = materialize(own)
    classes = own.groupBy("digest", "body").agg(*Index(1, keep)._winner(F.count("*"))).withColumnsRenamed({"doc_id": "kept_id", "row": "kept_row"})
    own = own.join(classes, ["digest", "body"])
    return out.union(own.select("doc_id", "kept_id", "n", F.col("kept_row") == F.col("row"), F.sha2("body", 256)))


def drop_copies(docs: DataFrame, keep: str = "max", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of docs, one of each group of equal texts, as `dedup` chooses it; columns as given, of any name.

    Rows with a digest of their own pass through; the others are grouped by digest and text, which verifies bytes. Null
    texts are empty; a null doc_id stays only where all of a group are null; of rows with the same doc_id the largest (or
    smallest) by the other columns stays. Empty input gives no rows.
    """
    return shielded(docs, ("doc_id", "text"), lambda d: _drop_copies(d, keep, digest))


def _drop_copies(docs: DataFrame, keep: str, digest: Callable[[Column], Column]) -> DataFrame:
    names = docs.columns
    total = docs.count()
    if not total:
        return docs
    rows = docs.select(digest(body()).alias("digest"), "doc_id", F.monotonically_increasing_id().alias("row"))
    hits = hits_of(rows, total, keep)
    n_hits = hits.count()
    if not n_hits:
        return docs
    keyed = docs.withColumn("digest__", digest(body()))
    some = bounded_broadcast(hits.select(F.col("digest").alias("digest__")), n_hits, 64)
    others = [c for c in names if c not in ("doc_id", "text")]
    known = F.col("doc_id").isNotNull() if keep == "max" else F.col("doc_id").isNull()
    best = (F.max if keep == "max" else F.min)(F.struct(known.alias("known__"), "doc_id", "text", *others))
    same = keyed.join(some, "digest__", "left_semi").groupBy("digest__", body().alias("body__")).agg(best.alias("row__"))
    return keyed.join(some, "digest__", "left_anti").select(*names).union(same.select(*[F.col("row__").getField(c).alias(c) for c in names]))


ORACLE = """
WITH g AS (SELECT coalesce(text, '') t, max(doc_id) keep_id, count(*) n FROM documents GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') t, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) i FROM documents)
SELECT d.doc_id, g.keep_id, g.n::BIGINT group_size, d.i = 1 kept, sha256(d.t) text_sha256 FROM d JOIN g ON d.t = g.t
"""
