"""Identity functions: digests, keyed digests, Merkle nodes, placement hashes. Column expressions only."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(data: Column) -> Column:
    """Hex SHA-256 of a binary or string column; the identity of stored bytes."""
    return F.sha2(data.cast("binary"), 256)


def keyed(secret: bytes, data: Column) -> Column:
    """Hex HMAC-SHA-256: the identity of plaintext within one dedup domain."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data.cast("binary")), 256))), 256)


def keyed_local(secret: bytes, data: bytes) -> str:
    return hmac.new(secret, data, "sha256").hexdigest()


def content_id(secret: bytes | None, data: Column) -> Column:
    """Keyed identity, null where dedup is off. The secret must have 32 bytes or more."""
    if secret is None:
        return F.lit(None).cast("string")
    if len(secret) < 32:
        raise ValueError("a dedup secret has 32 bytes or more")
    return keyed(hashlib.sha256(b"content identity:" + secret).digest(), data)


def namespace(domain: str, secret: bytes) -> str:
    return f"{hashlib.sha256(domain.encode()).hexdigest()}-{hashlib.sha256(secret).hexdigest()[:32]}"


def name_key(secret: bytes | None, parent: Column, name: Column) -> Column:
    """How a directory entry is looked up: by name, or by a keyed hash of parent and name where names are hidden."""
    if secret is None:
        return name
    return keyed(secret, F.concat(F.lpad(F.hex(parent), 16, "0"), F.lit(":"), name))


def bucket_of(key: Column, n: Column | int) -> Column:
    """A stable index in 0..n-1 from the first 60 bits of a key's digest."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def _sized(x: Column) -> Column:
    return F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)


def entry_hash(path: Column, kind: Column, mode: Column, size: Column, content: Column) -> Column:
    """Hash of one snapshot entry: kind, mode, size, length-prefixed path, content hash."""
    return F.sha2(F.concat_ws("|", F.lit("entry"), kind, mode, size, _sized(path), content), 256)


def leaf_hash(name: Column, kind: Column, mode: Column, child: Column) -> Column:
    """Hash of one tree node under its parent; does not bind a size. Null if child is."""
    return F.when(child.isNotNull(), F.sha2(F.concat_ws("|", F.lit("node"), kind, mode, _sized(name), child), 256))


EMPTY_ROOT = hashlib.sha256(b"empty tree").hexdigest()


def merkle_node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("pair|"), left, right), 256)


def merkle_root_local(leaves: list[str]) -> str:
    """Pairs upwards; an odd node pairs with itself; no leaves give EMPTY_ROOT."""
    if not leaves:
        return EMPTY_ROOT
    while len(leaves) > 1:
        leaves = [hashlib.sha256(f"pair|{a}{b}".encode()).hexdigest() for a, b in zip(leaves[::2], [*leaves[1::2], *leaves[-1:]][: (len(leaves) + 1) // 2], strict=True)]
    return leaves[0]


def merkle_proof_local(leaves: list[str], index: int) -> tuple[list[str], int]:
    """(siblings upwards, number of levels) for one leaf."""
    siblings, levels = [], 1
    while len(leaves) > 1:
        other = index ^ 1
        siblings.append(leaves[other] if other < len(leaves) else leaves[index])
        leaves = [hashlib.sha256(f"pair|{a}{b}".encode()).hexdigest() for a, b in zip(leaves[::2], [*leaves[1::2], *leaves[-1:]][: (len(leaves) + 1) // 2], strict=True)]
        index, levels = index // 2, levels + 1
    return siblings, levels


def verify_inclusion(leaf: Column, index: Column, siblings: Column, levels: Column, root: Column) -> Column:
    """The leaf and its siblings fold to the root, and there is one sibling a level."""
    start = F.struct(leaf.alias("h"), index.cast("long").alias("i"))
    fold = F.aggregate(siblings, start, lambda s, x: F.struct(F.when(s["i"] % 2 == 0, merkle_node(s["h"], x)).otherwise(merkle_node(x, s["h"])).alias("h"), F.floor(s["i"] / 2).cast("long").alias("i")), lambda s: s["h"])
    return (fold == root) & (F.size(siblings) + 1 == levels)
