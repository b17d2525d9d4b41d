"""Streaming forms of timeline operators (an extension): event-time windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, key: str = "record_id", at: str = "ts", gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """(record, start, end, n): event-time sessions of a record, closed when the watermark passes."""
    window = F.session_window(F.col(at), gap)
    out = stream.withWatermark(at, late).groupBy(F.col(key), window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_rates(stream: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "10 minutes", by: str = "role") -> DataFrame:
    """(by, window start, errors, words, wer): error rates by tumbling window from scored rows."""
    out = stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), F.col(by)).agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"))
    return out.select(by, F.col("w.start").alias("start"), "errors", "words", (F.col("errors") / F.greatest("words", F.lit(1))).alias("wer"))
