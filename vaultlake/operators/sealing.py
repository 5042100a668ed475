"""Per-chunk transform: compress, pad, encrypt, bind metadata, and back with every check."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import digest
from ..shipping import BATCH_BYTES, small_batches

PAD, MAX_PLAIN = 4096, 128 << 20
ZSTD, PADDED = 1, 0x80


# A batch given back closes at BATCH_BYTES as well: packed chunks grow by what they hold, small ones by their padding.


def _rest(batch: pa.RecordBatch, names: list[str], upto: int, out: list[bytes]) -> list[pa.Array]:
    """The other columns of the rows that out was made of, the last of which is row number upto."""
    return [batch.column(c).slice(upto - len(out), len(out)) for c in names]


def compress(rows: DataFrame, level: int = 3, min_size: int = 64, min_percent: int = 5, pad: bool = True) -> DataFrame:
    """rows (…, data binary) with data packed and comp_type: zstd where that saves enough, then zero-padded.

    The padded form ends in the length before padding, four bytes big-endian, and sets the high bit of comp_type.
    """
    small_batches(rows.sparkSession)
    names = [c for c in rows.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            kinds, out, held = [], [], 0
            for n, x in enumerate(batch.column("data"), 1):
                data, kind = x.as_py() or b"", 0
                if len(data) > MAX_PLAIN:
                    raise ValueError("chunk too long")
                if len(data) >= min_size:
                    small = packer.compress(data)
                    if not min_percent or (len(data) - len(small)) * 100 >= len(data) * min_percent:
                        data, kind = small, ZSTD
                if pad:
                    data, kind = data + bytes(-len(data) % PAD) + len(data).to_bytes(4, "big"), kind | PADDED
                kinds.append(kind)
                out.append(data)
                held += len(data)
                if held > BATCH_BYTES or n == len(batch):
                    yield pa.RecordBatch.from_arrays([*_rest(batch, names, n, out), pa.array(kinds, pa.int32()), pa.array(out, pa.binary())], [*names, "comp_type", "data"])
                    kinds, out, held = [], [], 0

    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names]
    return rows.select(*names, "data").mapInArrow(run, ", ".join([*schema, "comp_type int", "data binary"]))


def decompress(rows: DataFrame) -> DataFrame:
    """rows with data unpacked and status: ok, bad padding, unknown codec, corrupt."""
    small_batches(rows.sparkSession)
    names = [c for c in rows.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            states, out, held = [], [], 0
            for n, (x, kind) in enumerate(zip(batch.column("data"), batch.column("comp_type").to_pylist(), strict=True), 1):
                data, state = x.as_py() or b"", "ok"
                if kind & PADDED:
                    size = int.from_bytes(data[-4:], "big") if len(data) >= 4 else -1
                    if 0 <= size <= min(len(data) - 4, MAX_PLAIN):
                        data = data[:size]
                    else:
                        data, state = b"", "bad padding"
                if state == "ok" and kind & 0x7F == ZSTD:
                    try:
                        if zstandard.frame_content_size(data) > MAX_PLAIN:
                            raise zstandard.ZstdError("too long")
                        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=MAX_PLAIN)
                    except zstandard.ZstdError:
                        data, state = b"", "corrupt"
                elif state == "ok" and kind & 0x7F:
                    data, state = b"", "unknown codec"
                states.append(state)
                out.append(data)
                held += len(data)
                if held > BATCH_BYTES or n == len(batch):
                    yield pa.RecordBatch.from_arrays([*_rest(batch, names, n, out), pa.array(out, pa.binary()), pa.array(states, pa.string())], [*names, "data", "status"])
                    states, out, held = [], [], 0

    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names]
    return rows.select(*names, "data").mapInArrow(run, ", ".join([*schema, "data binary", "status string"]))


def wrap(record: Column, key: bytes) -> Column:
    """A record under the archive key: a magic of our own, then nonce, ciphertext and tag of AES-256-GCM."""
    return F.concat(F.lit(bytearray(b"VKEY1")), F.aes_encrypt(record, F.lit(bytearray(key)), F.lit("GCM")))


def unwrap(wrapped: Column, key: bytes) -> Column:
    """The record, or null where magic, key or bytes are wrong."""
    body = F.try_aes_decrypt(F.substring(wrapped, F.lit(6), F.octet_length(wrapped)), F.lit(bytearray(key)), F.lit("GCM"))
    return F.when(F.substring(wrapped, 1, 5) == F.lit(bytearray(b"VKEY1")), body)


def seal(packed: DataFrame, key: bytes, key_seed: str | None = None) -> DataFrame:
    """packed (…, plaintext_hash, plain_len, comp_type, data) -> object_id, sealed, record instead of data.

    Each chunk has a data key of its own, random, or of key_seed in tests; the key, codec, lengths and hashes are the
    record, wrapped by the archive key. Random keys differ between runs: write the result before using it twice.
    """
    fresh = F.concat(F.uuid().cast("string"), F.uuid().cast("string")) if key_seed is None else F.concat(F.lit(key_seed), "plaintext_hash")
    rows = packed.withColumn("dek", F.unhex(F.sha2(fresh, 256)))
    rows = rows.withColumn("sealed", F.aes_encrypt("data", "dek", F.lit("GCM"))).drop("data")
    rows = rows.withColumn("object_id", digest(F.col("sealed")))
    record = F.to_json(F.struct(F.hex("dek").alias("dek"), "comp_type", "plain_len", F.octet_length("sealed").alias("sealed_len"), "object_id", "plaintext_hash"))
    return rows.withColumn("record", wrap(record.cast("binary"), key)).drop("dek")


def open_sealed(rows: DataFrame, key: bytes) -> DataFrame:
    """rows (object_id, sealed, record, …) with data and status; the first check that fails names the status."""
    fields = "dek string, comp_type int, plain_len long, sealed_len long, object_id string, plaintext_hash string"
    r = rows.withColumn("r", F.from_json(unwrap(F.col("record"), key).cast("string"), fields))
    early = (
        F.when(F.col("r").isNull(), "bad record").when(digest(F.col("sealed")) != F.col("r.object_id"), "object hash").when(F.octet_length("sealed") != F.col("r.sealed_len"), "sealed length")
    )
    data = F.when(early.isNull(), F.try_aes_decrypt("sealed", F.unhex("r.dek"), F.lit("GCM")))
    r = r.select("object_id", early.alias("early"), data.alias("data"), F.coalesce("r.comp_type", F.lit(0)).alias("comp_type"), F.col("r.plain_len").alias("plain_len"), F.col("r.plaintext_hash").alias("plaintext_hash"))
    out = decompress(r)
    status = F.coalesce("early", F.when(F.col("status") != "ok", F.col("status")), F.when(F.octet_length("data") != F.col("plain_len"), "plain length"), F.when(digest(F.col("data")) != F.col("plaintext_hash"), "plaintext hash"), F.lit("ok"))
    return out.select("object_id", "data", status.alias("status"))
