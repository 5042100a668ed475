"""Sealing across archives: fixed-layout records, records wrapped twice, routed opening, hidden names, inline containers,
sealed settings. Keys are driver-side parameters; everything else is column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import digest, keyed
from .sealing import decompress, unwrap, wrap

RECORD_MAGIC, INLINE_MAGIC, NAME_MAGIC, SETTING_MAGIC = b"VREC1", b"VINL1", b"\x01", "ENC:v1:"
CIPHERS = {"aes256gcm": 0, "chacha20poly1305": 1}
NAME_PAD = 64


def derived_key(secret: bytes, purpose: str) -> bytes:
    """A key of its own for each purpose."""
    return hashlib.sha256(purpose.encode() + b":" + secret).digest()


def shared_content_id(namespace: str, secret: bytes, data: Column) -> Column:
    """The identity of a plaintext within one namespace of the pool."""
    return keyed(derived_key(secret, "pool content"), F.concat(F.lit(f"{namespace}|").cast("binary"), data.cast("binary")))


def cipher_id(name: Column) -> Column:
    """The number of a cipher; hyphens, underscores and case do not matter, unknown names are null."""
    plain = F.lower(F.regexp_replace(name, "[-_]", ""))
    return F.element_at(F.create_map(*[F.lit(x) for kv in CIPHERS.items() for x in kv]), plain)


def cipher_pair_valid(name: Column, number: Column) -> Column:
    return F.coalesce(cipher_id(name) == number, F.lit(False))


def _le64(n: Column) -> Column:
    h = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]))


def _from_le64(b: Column) -> Column:
    h = F.hex(b)
    return F.conv(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]), 16, 10).cast("long")


def _part(b: Column, at: int, n: int) -> Column:
    return F.substring(b, at + 1, n)


def pack_record(dek: Column, comp_type: Column, cipher: Column, plain_len: Column, sealed_len: Column, object_hash: Column, plain_hash: Column) -> Column:
    """119 bytes: magic 5, data key 32, codec 1, cipher 1, both lengths little-endian 8, both digests 32 (given as hex)."""
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    return F.concat(F.lit(bytearray(RECORD_MAGIC)), dek, byte(comp_type), byte(cipher), _le64(plain_len), _le64(sealed_len), F.unhex(object_hash), F.unhex(plain_hash))


def parse_record(record: Column) -> Column:
    """The record's fields as a struct, null where length or magic are wrong."""
    number = lambda at: F.conv(F.hex(_part(record, at, 1)), 16, 10).cast("int")
    text = lambda at: F.lower(F.hex(_part(record, at, 32)))
    fields = F.struct(
        _part(record, 5, 32).alias("dek"), number(37).alias("comp_type"), number(38).alias("cipher"), _from_le64(_part(record, 39, 8)).alias("plain_len"),
        _from_le64(_part(record, 47, 8)).alias("sealed_len"), text(55).alias("object_id"), text(87).alias("plaintext_hash"),
    )
    return F.when((F.octet_length(record) == 119) & (_part(record, 0, 5) == F.lit(bytearray(RECORD_MAGIC))), fields)


def seal_shared(packed: DataFrame, archive_key: bytes, domain_key: bytes, key_seed: str | None = None) -> DataFrame:
    """packed (…, plaintext_hash, plain_len, comp_type, data) -> object_id, sealed, record, shared_record instead of data.

    The record is wrapped once under the archive's key and once under the domain's, so that either opens the object.
    Random keys differ between runs: write the result before using it twice.
    """
    fresh = F.concat(F.uuid().cast("string"), F.uuid().cast("string")) if key_seed is None else F.concat(F.lit(key_seed), "plaintext_hash")
    rows = packed.withColumn("dek", F.unhex(F.sha2(fresh, 256))).withColumn("sealed", F.aes_encrypt("data", "dek", F.lit("GCM"))).drop("data")
    rows = rows.withColumn("object_id", digest(F.col("sealed")))
    record = pack_record(F.col("dek"), F.col("comp_type"), F.lit(0), F.col("plain_len"), F.octet_length("sealed").cast("long"), F.col("object_id"), F.col("plaintext_hash"))
    rows = rows.withColumn("r", record)
    return rows.withColumns({"record": wrap(F.col("r"), archive_key), "shared_record": wrap(F.col("r"), domain_key)}).drop("dek", "r")


def open_auto(rows: DataFrame, archive_key: bytes, domain_key: bytes | None) -> DataFrame:
    """rows (object_id, sealed, record, shared_record, domain, …) -> (object_id, data, status).

    The flag domain says which record is used. The other one is never tried in its place: a wrong key is "bad record",
    and a domain object without a domain key "no domain key".
    """
    shared = unwrap(F.col("shared_record"), domain_key) if domain_key else F.lit(None).cast("binary")
    r = rows.withColumn("r", parse_record(F.when(F.col("domain"), shared).otherwise(unwrap(F.col("record"), archive_key))))
    early = (
        F.when(F.col("domain") & F.lit(domain_key is None), "no domain key").when(F.col("r").isNull(), "bad record").when(F.col("r.cipher") != 0, "unknown cipher")
        .when((digest(F.col("sealed")) != F.col("object_id")) | (F.col("r.object_id") != F.col("object_id")), "object hash").when(F.octet_length("sealed") != F.col("r.sealed_len"), "sealed length")
    )
    data = F.when(early.isNull(), F.try_aes_decrypt("sealed", F.col("r.dek"), F.lit("GCM")))
    out = decompress(r.select("object_id", early.alias("early"), data.alias("data"), F.coalesce("r.comp_type", F.lit(0)).alias("comp_type"), F.col("r.plain_len").alias("plain_len"), F.col("r.plaintext_hash").alias("plaintext_hash")))
    status = F.coalesce("early", F.when(F.col("status") != "ok", F.col("status")), F.when(F.octet_length("data") != F.col("plain_len"), "plain length"), F.when(digest(F.col("data")) != F.col("plaintext_hash"), "plaintext hash"), F.lit("ok"))
    return out.select("object_id", F.when(status == "ok", F.col("data")).alias("data"), status.alias("status"))


def hide_name(name: Column, key: bytes) -> Column:
    """A directory entry's name under a key: its length in two bytes, the name, and zeros up to a multiple of 64."""
    raw = name.cast("binary")
    h = F.lpad(F.hex(F.octet_length(raw)), 4, "0")
    body = F.concat(F.unhex(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), raw)
    pad = F.pmod(-F.octet_length(body), F.lit(NAME_PAD))
    return F.concat(F.lit(bytearray(NAME_MAGIC)), wrap(F.concat(body, F.unhex(F.repeat(F.lit("00"), pad))), key))


def show_name(hidden: Column, key: bytes) -> Column:
    """The name, or null where the key or the bytes are wrong."""
    body = unwrap(F.substring(hidden, F.lit(2), F.octet_length(hidden)), key)
    h = F.hex(_part(body, 0, 2))
    n = F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int")
    ok = (_part(hidden, 0, 1) == F.lit(bytearray(NAME_MAGIC))) & (n <= F.octet_length(body) - 2)
    return F.when(ok, F.substring(body, F.lit(3), n).cast("string"))


def wrap_inline(record: Column, sealed: Column) -> Column:
    """A container for a small file's row: magic, the record's length big-endian, the wrapped record, the ciphertext."""
    return F.concat(F.lit(bytearray(INLINE_MAGIC)), F.unhex(F.lpad(F.hex(F.octet_length(record)), 8, "0")), record, sealed)


def unwrap_inline(container: Column) -> Column:
    """struct(record, sealed), null where the container is not one."""
    n = F.conv(F.hex(_part(container, 5, 4)), 16, 10).cast("int")
    ok = (_part(container, 0, 5) == F.lit(bytearray(INLINE_MAGIC))) & (n <= F.octet_length(container) - 9)
    return F.when(ok, F.struct(F.substring(container, F.lit(10), n).alias("record"), F.substring(container, n + 10, F.octet_length(container)).alias("sealed")))


def seal_setting(value: Column, key: bytes) -> Column:
    return F.concat(F.lit(SETTING_MAGIC), F.lower(F.hex(wrap(value.cast("binary"), key))))


def open_setting(stored: Column, key: bytes) -> Column:
    """The setting; what is not sealed is returned as it is, and a wrong key gives null."""
    sealed = F.substring(stored, F.lit(len(SETTING_MAGIC) + 1), F.length(stored))
    return F.when(stored.startswith(SETTING_MAGIC), unwrap(F.unhex(sealed), key).cast("string")).otherwise(stored)
