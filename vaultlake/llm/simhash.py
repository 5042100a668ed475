"""SimHash near-dedup by an index on byte positions with count filtering.

Two 64-bit fingerprints with at most four differing bits agree in at least four of their eight bytes. The index holds
each distinct fingerprint under every choice of four byte positions and their values, so that candidates that reach
the guaranteed count meet under a key of 32 bits, and a pair that shares fewer bytes never meets by design. In a key's
list the shared bytes of a pair are tallied, and pairs that reach four are verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_broadcast, connected_components, materialize, shielded, small_batches

SHINGLE, DISTANCE, SEED, BYTES = 4, 4, 42, 8
MIN_SHARED = BYTES - DISTANCE
#: Lists up to this length are compared within one task; longer ones go by common midpoints instead.
LIST = 4096
#: A key that holds over 1 / HOT of all rows is joined by broadcast; there are fewer than HOT such keys.
HOT = 1000


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text: majority of each bit over the XXH64 of its shingles, 0 without words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six white-space bytes
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) + np.arange(len(parts))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - SHINGLE + 1)
    one = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):  # bounds the unpacked bits of a very long text
        to = min(n, at + (1 << 15))
        last = ends[at + SHINGLE - 1 : to + SHINGLE - 1] if len(parts) >= SHINGLE else ends[-1:]
        h = np.fromiter((one(joined[s:e], SEED) for s, e in zip(starts[at:to].tolist(), last.tolist(), strict=True)), np.uint64, to - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep_text: bool = False, name: str = "fp") -> DataFrame:
    """docs and `name` long (the fingerprint's bits), without text unless asked for. Every shingle of the whole text counts."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "text" or keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(marks)], [*names, name])

    schema = StructType([*(docs.schema[c] for c in names), StructField(name, LongType())])
    return docs.select(*names, *([] if keep_text else ["text"])).mapInArrow(run, schema)


def index(marks: DataFrame) -> DataFrame:
    """(key, fp): each fp under its 70 keys, one for each choice of four byte positions.

    key hashes the positions and their bytes; a collision only adds a candidate, which the tally rejects.
    """
    keys = []
    for c, places in enumerate(combinations(range(BYTES), MIN_SHARED)):
        mask = sum(255 << 8 * p for p in places)
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(mask - (mask >> 63 << 64)), F.lit(c)))
    return marks.select("fp", F.explode(F.array(*keys)).alias("key"))


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of each difference are zero: the tally of shared positional bytes."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, BYTES) == 0).sum(axis=-1)


def _linked(x: np.ndarray) -> np.ndarray:
    """Which differences pass the count filter and then the test on bits."""
    near = shared_bytes(x) >= MIN_SHARED
    near[near] = np.bitwise_count(x[near]) <= DISTANCE
    return near


def _star(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect what links connect within one list, a spanning star for each part. Space and time stay
    bounded by LIST: the frontier is compared in blocks with those not yet reached."""
    a, b, left = [], [], fps
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[:64], front[64:]
            hit = _linked(block[:, None] ^ left[None, :]).any(axis=0)
            new, left = left[hit], left[~hit]
            if len(new):
                a.append(np.full(len(new), root))
                b.append(new)
                front = np.concatenate([front, new])
    return a, b


class _Lists:
    """Walks rows sorted by key and links each key's list; holds at most one list of up to `limit` members."""

    def __init__(self, limit: int, star: bool) -> None:
        self.limit, self.star = limit, star

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        long_key, root = None, None  # the key whose list is over the limit, or is made a star as it comes
        for batch in batches:
            k = batch.column("key").to_numpy()
            f = batch.column("fp").to_numpy().view(np.uint64)
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            if long_key is not None:
                other = keys != long_key
                n = int(np.argmax(other)) if other.any() else len(keys)
                yield from self._long(fps[:n], root)
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                long_key = None
            cut = int(np.argmax(keys == keys[-1])) if len(keys) else 0  # the last list may go on
            yield from self._link(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
            if len(keys) > self.limit:
                long_key, root = keys[0], fps[0]
                yield from self._long(fps, root)
                keys, fps = keys[:0], fps[:0]
        yield from self._link(keys, fps)

    def _long(self, fps: np.ndarray, root: np.uint64) -> Iterator[pa.RecordBatch]:
        if self.star:
            yield self._out(np.full(len(fps), root), fps, False)
        else:
            yield self._out(fps, fps, True)

    def _out(self, a: np.ndarray, b: np.ndarray, long: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), long))], ["a", "b", "long"])

    def _link(self, keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        a, b = [], []
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = np.unique(fps[s : s + n])
            if self.star or n > self.limit:
                if self.star:
                    a.append(np.full(len(own) - 1, own[0]))
                    b.append(own[1:])
                else:
                    yield self._out(own, own, True)
                continue
            x, y = _star(own)
            a += x
            b += y
        pairs = starts[sizes == 2]
        x, y = fps[pairs], fps[pairs + 1]
        ok = np.ones(len(x), bool) if self.star else _linked(x ^ y)
        a.append(np.minimum(x, y)[ok])
        b.append(np.maximum(x, y)[ok])
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        if len(both):
            yield self._out(np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), False)


def links(marks: DataFrame, limit: int = LIST, total: int | None = None) -> DataFrame:
    """(a, b): edges among the distinct fp of marks, at most `total` if that is known, whose connected parts are those of all pairs at DISTANCE or less.

    A key's list is linked in one task by spanning stars, not by all its pairs. A list longer than `limit` is not held:
    its members go to a second index in which each is under every value at two or fewer flipped bits. Any two
    within four bits share such a midpoint, and all that share one are within four, so each list there is one star.
    """
    rows = index(marks)
    found = rows.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_Lists(limit, False), "a long, b long, long boolean")
    found = materialize(found, None if total is None else 70 * total)
    edges = found.where("not long").select("a", "b").distinct()
    crowd = found.where("long").select(F.col("a").alias("fp")).distinct()
    if crowd.isEmpty():
        return edges
    flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
    flips = F.array(*[F.lit(x - (x >> 63 << 64)) for x in flips])
    mids = crowd.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("key"))
    more = mids.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_Lists(limit, True), "a long, b long, long boolean")
    return edges.union(more.select("a", "b")).distinct()


def _join_hot(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined on key with found (key, n, value), without n; found has one row for each key of rows, n its count there.

    Keys with over 1 / HOT of the rows are fewer than HOT, so their part of found is broadcast and no task gets all
    rows of one of them. The other keys go by a shuffle join.
    """
    is_hot = F.col("n") * HOT > total
    value = next(c for c in found.columns if c not in (key, "n"))
    hot = F.broadcast(found.where(is_hot).select(key, F.struct(value).alias("hot__")))
    tagged = rows.join(hot, key, "left")
    at_hot = tagged.where(F.col("hot__").isNotNull()).select(*rows.columns, F.col(f"hot__.{value}").alias(value))
    others = tagged.where(F.col("hot__").isNull()).select(*rows.columns)
    at_others = others.join(found.where(~is_hot).select(key, value), key).select(*rows.columns, value)
    return at_hot.union(at_others)


def groups(marks: DataFrame, first: Column, total: int) -> DataFrame:
    """(fp, n, first): for each distinct fp of marks (of total rows) its rows, and the least `first` over all rows whose fp
    is reachable."""
    known = materialize(marks.groupBy("fp").agg(F.count("*").alias("n"), F.min(first).alias("first")), total)
    parts = materialize(connected_components(links(known.select("fp"), total=total), total).withColumnRenamed("node", "fp"), total)
    least = parts.join(known.select("fp", "first"), "fp").groupBy("component").agg(F.count("*").alias("n"), F.min("first").alias("least"))
    near = _join_hot(parts, materialize(least, total), "component", parts.count()).select("fp", "least")
    return materialize(known.join(near, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("first")), total)


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text; others ignored).

    Texts without words, null and empty ones among them, have the fingerprint zero and are linked like any other.
    component_id is the smallest doc_id of the rows reachable over links; null only if all of them are null.
    Repeated rows are in one component. Empty input gives no rows.
    """
    marks = materialize(fingerprints(docs.select("doc_id", "text")))
    total = marks.count()
    out = _join_hot(marks, groups(marks, _order(), total), "fp", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs from each component: that with the smallest doc_id, null last; where ids repeat, the one with
    the smallest XXH64 of all columns, so that other partitions of the input keep the same row. Columns as given, of any
    name; texts without words have the fingerprint zero; empty input gives no rows. Whole texts count."""
    return shielded(docs, ("doc_id", "text"), _keep_first)


def _keep_first(docs: DataFrame) -> DataFrame:
    names = docs.columns
    marked = docs.withColumns({"row__": F.monotonically_increasing_id(), "mark__": F.xxhash64(*[F.col(c) for c in sorted(names)])})
    marks = materialize(fingerprints(marked, True, "fp__"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col("mark__").alias("mark"), F.col("row__").alias("row"))
    own = marks.select("doc_id", F.col("fp__").alias("fp"), "row__", "mark__")
    total = marks.count()
    found = groups(own, order, total)
    gone = materialize(_join_hot(own.select("fp", "row__"), found, "fp", total).where(F.col("row__") != F.col("first.row")).select("row__"), total)
    rows = marks.join(bounded_broadcast(gone, gone.count(), 32), "row__", "left_anti")
    return rows.select(*names)
