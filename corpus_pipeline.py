"""The training-data pipeline over documents: quality rules, near-dedup, suffix-array dedup, mixing, tokens.

Each stage works on all rows that the stage before kept. All but the last return the columns of documents.

* quality: documents that the quality rules reject go, and of the others the lines that too many documents hold;
* near_dedup: of documents whose five-word shingles are 0.8 or more alike, the one of the smallest doc_id stays (null
  ids last, rows of one id in the order of a hash);
* suffix_dedup: bytes that repeat an earlier 100-byte string are taken out of the texts;
* mix: rows are repeated or dropped so that the sources' words meet the target weights;
* tokens: texts become ids; the last stage's rows are (doc_id, n_tokens, ids_sha256, decoded_sha256).

Nulls, empty tables, repeated rows and further columns are handled as the operators' docstrings say. Texts decide, not
ids: rows that share a doc_id, or have none, are documents of their own to near_dedup and suffix_dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import bpe, mixing, quality, simhash, suffix_dedup
from voxloom.llm.common import materialize, read_table
from voxloom.llm.queries import vocabulary_path


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = quality.cleaned(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs, vocabulary_path())


STAGES = [
    ("quality", stage_quality),
    ("near_dedup", stage_near_dedup),
    ("suffix_dedup", stage_suffix_dedup),
    ("mix", stage_mix),
    ("tokens", stage_tokens),
]

#: Hash bands, suffix orders and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
