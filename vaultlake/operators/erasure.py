"""Reed-Solomon parity over GF(2^8) for one or two lost or corrupt shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import small_batches

PARITY = {"raid5": 1, "raid6": 2}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(512, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (0x11D if x & 0x80 else 0)
    return exp, log


def _times(a: np.ndarray, k: int) -> np.ndarray:
    """a times 2^k, elementwise."""
    exp, log = _tables()
    out = exp[log[a] + k % 255]
    out[a == 0] = 0
    return out


def encode(data: bytes, n: int, mode: str) -> list[bytes]:
    """n shards: a length prefix and the bytes over n - parity shards, then P, the sum, and for raid6 Q, the sum
    weighted by powers of two."""
    k = n - PARITY[mode]
    if k < 1:
        raise ValueError("too few backends")
    whole = len(data).to_bytes(4, "little") + data
    size = -(-len(whole) // k)
    d = np.frombuffer(whole.ljust(size * k, b"\0"), np.uint8).reshape(k, size)
    parity = [np.bitwise_xor.reduce(d, axis=0)]
    if mode == "raid6":
        parity.append(np.bitwise_xor.reduce(np.stack([_times(x, i) for i, x in enumerate(d)]), axis=0))
    return [x.tobytes() for x in [*d, *parity]]


def _solve(shards: list[bytes | None], mode: str) -> list[np.ndarray] | None:
    """Data shards from what is present, or None where too many are lost."""
    k = len(shards) - PARITY[mode]
    size = next((len(s) for s in shards if s is not None), None)
    lost = [i for i in range(k) if shards[i] is None]
    have = [None if s is None or len(s) != size else np.frombuffer(s, np.uint8) for s in shards]
    p, q = have[k], have[k + 1] if mode == "raid6" else None
    if size is None or len(lost) > PARITY[mode]:
        return None
    known = [x if x is not None else np.zeros(size, np.uint8) for x in have[:k]]
    total = np.bitwise_xor.reduce(np.stack(known), axis=0)
    weighted = np.bitwise_xor.reduce(np.stack([_times(x, i) for i, x in enumerate(known)]), axis=0)
    if len(lost) == 1:
        i = lost[0]
        if p is not None:
            known[i] = total ^ p
        elif q is not None:
            known[i] = _times(weighted ^ q, 255 - i % 255)
        else:
            return None
    elif len(lost) == 2:
        if p is None or q is None:
            return None
        i, j = lost
        exp, log = _tables()
        scale = int(log[int(exp[i % 255]) ^ int(exp[j % 255])])
        known[i] = _times(weighted ^ q ^ _times(total ^ p, j), 255 - scale)
        known[j] = total ^ p ^ known[i]
    return known


def decode(shards: list[bytes | None], mode: str, object_id: str) -> tuple[bytes | None, list[int]]:
    """(bytes with that SHA-256, shards that were lost or corrupt), or (None, []). With nothing known to be lost it also
    tries each shard, and for raid6 each pair, as corrupt."""
    lost = [i for i, s in enumerate(shards) if s is None]
    for extra in range(PARITY[mode] - len(lost) + 1):
        for drop in combinations([i for i in range(len(shards)) if i not in lost], extra):
            solved = _solve([None if i in drop else s for i, s in enumerate(shards)], mode)
            if solved is None:
                continue
            whole = b"".join(x.tobytes() for x in solved)
            n = int.from_bytes(whole[:4], "little")
            if n <= len(whole) - 4 and hashlib.sha256(whole[4 : 4 + n]).hexdigest() == object_id:
                data = whole[4 : 4 + n]
                return data, [i for i, s in enumerate(encode(data, len(shards), mode)) if s != shards[i]]
    return None, []


def shards(objects: DataFrame, n: int, mode: str) -> DataFrame:
    """(object_id, backend, shard binary) of objects (object_id, data)."""
    small_batches(objects.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for oid, data in zip(batch.column("object_id").to_pylist(), batch.column("data"), strict=True):
                parts = encode(data.as_py() or b"", n, mode)
                yield pa.RecordBatch.from_arrays([pa.array([oid] * n), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], ["object_id", "backend", "shard"])

    return objects.select("object_id", "data").mapInArrow(run, "object_id string, backend int, shard binary")


def reconstruct(stored: DataFrame, n: int, mode: str) -> DataFrame:
    """(object_id, data, healed array<int>, status) from (object_id, backend, shard): n rows of an object at most meet."""
    small_batches(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for oid, parts in zip(batch.column("object_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                held: list[bytes | None] = [None] * n
                for p in parts:
                    held[p["backend"]] = p["shard"]
                data, healed = decode(held, mode, oid)
                rows.append((oid, data, healed, "ok" if data is not None else "lost"))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.list_(pa.int32()), pa.string()), strict=True)], ["object_id", "data", "healed", "status"])

    rows = stored.selectExpr("object_id", "struct(backend, shard) part").groupBy("object_id").agg({"part": "collect_list"}).toDF("object_id", "parts")
    return rows.mapInArrow(run, "object_id string, data binary, healed array<int>, status string")
