"""From raw documents to token ids: quality rules, exact dedup, near-dedup, source mix, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultlake.llm import line_quality, lsm_dedup, mixing, simhash
from vaultlake.llm.common import discard, materialize, scope
from vaultlake.llm.queries import id_digests

# Every stage takes nulls in any column, empty tables, repeated rows and further columns of any name, and reads whole
# texts of any length, one at a time. A null text is empty; null sources are one source.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above their host's limit go from those kept. Null and empty texts are rejected;
    repeated rows are judged alike, so all of them stay or go."""
    return line_quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a null doc_id only where all of a group are null, and of
    rows that share this doc_id the largest by its other columns."""
    return lsm_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays, of equal doc_ids the one with the
    smallest digest of all columns; a null doc_id only where all of a component are null. Texts without words are one
    component with what is near the fingerprint zero."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the source weights take it; texts without words drop out. Reruns agree, as ties of doc_id
    and size are broken by a digest of the row."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256) for each row, repeated ones too; a null text has no tokens."""
    return id_digests(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("bpe", tokens)]

#: BPE and SimHash are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents, each written as Parquet and read again as the next one's docs.

    What a stage writes on its way is deleted once its result is written, and so is that result once the next has read it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            kept = materialize(out, keep=True)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
