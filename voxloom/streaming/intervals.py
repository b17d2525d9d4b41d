"""Interval operators over streams (an extension): the gap merge and the overlap join, equal to their batch forms.

Both take event time from an interval's start, as a timestamp. A row that starts before the watermark is late and is
left out; all others get the batch result, in whatever order they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voxloom.operators.intervals import MERGE_GAP_S, MIN_SEGMENT_S

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = "start_s double, end_s double, speaker string"


def event_time(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))


class GapMerge(StatefulProcessor):
    """State of one record: rows that the watermark hasn't passed yet, and the segment that may still grow.

    Rows wait until no earlier one can come; then they are merged in order. A segment is done when another speaker or a gap
    follows it, or when a timer says that the watermark has passed its end by the gap.
    """

    def __init__(self, gap_s: float = MERGE_GAP_S):
        self.gap_s = gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getValueState("open", f"{_WAITING}, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added = [tuple(r) for frame in rows for r in frame[["start_s", "end_s", "speaker"]].itertuples(index=False)]
        yield self._advance(key, added, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key, added: list[tuple], watermark_ms: int, gone: int | None = None) -> pd.DataFrame:
        """gone: the timer that has just run out. Each call to the state or the timers travels to the JVM and back."""
        before = [tuple(r) for r in self.waiting.get()]
        held = sorted(before + [(float(a), float(b), str(c)) for a, b, c in added])
        ready = [r for r in held if r[0] * 1000 < watermark_ms]
        kept, done = self.open.get(), []
        current, timer = (None if kept[0] is None else tuple(kept[:3]), kept[3]) if kept else (None, None)
        for start, end, speaker in ready:
            if current and current[2] == speaker and start - current[1] < self.gap_s:
                current = (current[0], max(current[1], end), speaker)
                continue
            if current:
                done.append(current)
            current = (start, end, speaker)
        if current and (current[1] + self.gap_s) * 1000 <= watermark_ms:
            done.append(current)
            current = None
        rest = held[len(ready) :]
        if rest != before:
            self.waiting.put(rest) if rest else self.waiting.clear()
        due = [r[0] * 1000 + 1 for r in rest[:1]] + ([(current[1] + self.gap_s) * 1000 + 1] if current else [])
        due = max(int(min(due)), watermark_ms + 1) if due else None
        if timer is not None and timer not in (due, gone):
            self.handle.deleteTimer(timer)
        if due is not None and due != timer:
            self.handle.registerTimer(due)
        if due is not None:
            self.open.update((*(current or (None, None, None)), due))
        elif kept:
            self.open.clear()
        return pd.DataFrame([(*key, w, s, e) for s, e, w in done], columns=["record_id", "speaker", "start_s", "end_s"])

    def close(self) -> None:
        pass


def merge_gaps(stream: DataFrame, late: str = "1 minute", min_s: float = MIN_SEGMENT_S, gap_s: float = MERGE_GAP_S) -> DataFrame:
    """(record_id, speaker, start_s, end_s) as ``operators.intervals.merge_gaps`` gives, a segment as soon as it can't grow.

    Starts are clamped to 0 and segments under min_s dropped before; a record's state is what lies within the watermark's delay.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = stream.select("record_id", F.greatest(F.col("start_s"), F.lit(0.0)).alias("start_s"), "end_s", "speaker").filter(F.col("end_s") - F.col("start_s") >= min_s)
    rows = rows.withColumn("at", event_time(F.col("start_s"))).withWatermark("at", late)
    schema = "record_id string, speaker string, start_s double, end_s double"
    return rows.groupBy("record_id").transformWithStateInPandas(GapMerge(gap_s), schema, "Append", "EventTime")


def overlaps(left: DataFrame, right: DataFrame, longest_s: float, late: str = "1 minute") -> DataFrame:
    """Pairs of overlapping intervals of a record, as ``operators.intervals.overlaps`` gives.

    Two intervals of at most longest_s that overlap start within longest_s of each other: with that bound in the join, both
    sides' state is what lies within it and the watermark's delay. Longer intervals are left out.
    """
    side = lambda df, p: df.filter(F.col("end_s") - F.col("start_s") <= longest_s).select(*(F.col(c).alias(f"{p}{c}") for c in df.columns), event_time(F.col("start_s")).alias(f"{p}at")).withWatermark(f"{p}at", late)
    bound = F.expr(f"INTERVAL {int(longest_s * 1_000_000) + 1} MICROSECONDS")
    near = (F.col("r_at") >= F.col("at") - bound) & (F.col("r_at") <= F.col("at") + bound)
    met = (F.col("record_id") == F.col("r_record_id")) & (F.col("start_s") < F.col("r_end_s")) & (F.col("r_start_s") < F.col("end_s"))
    found = side(left, "").join(side(right, "r_"), near & met)
    return found.drop("at", "r_at").withColumn("overlap_s", F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s"))


def replay(spark: SparkSession, rows: DataFrame, order: str, path: str, files: int = 8) -> DataFrame:
    """rows as a stream: written as about ``files`` files one after the other, by order, and read one a batch."""
    edges = [e for e in rows.agg(F.percentile_approx(order, [k / files for k in range(1, files)]).alias("e")).first()["e"] or []]
    edges = [None, *sorted(set(edges)), None]
    for low, high in zip(edges, edges[1:]):
        part = rows if low is None else rows.filter(F.col(order) >= low)
        part = part if high is None else part.filter(F.col(order) < high)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All rows that a stream gives for what is there now, written to path and read back."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
