"""Speech-like tables derived from the generated ones: events become intervals of records, turns become pairs and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.operators import chunks

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_millis(seconds: Column) -> Column:
    """Seconds of three digits, rounded as SQL engines round doubles: the product by 1000 is, halves away from zero.

    F.round(x, 3) rounds the shortest decimal of a double instead, which differs where a time in microseconds ends in 500.
    """
    return F.round(seconds * 1000.0) / 1000.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, event_id, speaker, start_s, end_s): an event lasts its value in minutes."""
    rows = table(spark, sf_dir, "events")
    start = to_millis((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1e6)
    return rows.select(
        F.col("user_id").cast("string").alias("record_id"), "event_id", F.col("event_type").alias("speaker"), start.alias("start_s"),
        to_millis(start + F.col("value") * 60).alias("end_s"),
    )


EVENTS_SQL = f"""ev AS (SELECT user_id::VARCHAR AS record_id, event_id, event_type AS speaker,
  round((epoch_us(ts) - {EPOCH_US}) / 1e6, 3) AS start_s,
  round(round((epoch_us(ts) - {EPOCH_US}) / 1e6, 3) + value * 60, 3) AS end_s FROM events)"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, turn, role, ref, hyp): each turn's text and the next turn's of the conversation."""
    rows = table(spark, sf_dir, "conversations")
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    return rows.join(nxt, ["conv_id", "turn"]).select(F.col("conv_id").cast("string").alias("record_id"), "turn", "role", F.col("text").alias("ref"), "hyp")


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, turn, start_s, end_s, words): turn k of a conversation is spoken from 10k to 10k + 10 seconds, evenly."""
    rows = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 10.0
    return rows.select(
        F.col("conv_id").cast("string").alias("record_id"), "turn", start.alias("start_s"), (start + 10.0).alias("end_s"),
        chunks.even_spans(text.tokens(F.col("text")), start, start + 10.0).alias("words"),
    )


def nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, rank, text, score): a conversation's turns as each other's competing hypotheses."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("chunk_id"), F.col("turn").cast("int").alias("rank"), "text", (-0.05 * F.col("turn")).alias("score"))
