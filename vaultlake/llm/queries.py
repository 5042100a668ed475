"""One query an operator, over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, license_scan, line_quality, lsm_dedup, mixing, secret_scan, sharding, simhash, url_filter

BPE_FILE = "byte_bpe_50k.json"


def bpe_path() -> str:
    """The place of the default vocabulary file, of an installed package on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe_path())


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.examples(chat.with_probe(table(spark, sf_dir, "conversations"))), ordered=True)


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, repeated ones too. A null text is empty: no
    tokens and an empty decoded text. Whole texts of any length are encoded; empty input gives no rows."""
    coded = bpe.encode(docs.select("doc_id", "text"), bpe_path(), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def id_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256) for each row of docs; a null text has no tokens."""
    coded = bpe.encode(docs.select("doc_id", "text"), bpe_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE, "op4_license_scan": license_scan.ORACLE, "op5_url_filter": url_filter.ORACLE, "op6_chat_format": chat.ORACLE, "op7_shard": sharding.ORACLE, "op9_exact_dedup": lsm_dedup.ORACLE, "op10_quality_rules": line_quality.ORACLE}
