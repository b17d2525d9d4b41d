"""Streams against the batch forms."""

import random

from pyspark.sql import functions as F

from voxloom.operators import intervals as batch
from voxloom.sources.shared import scratch
from voxloom.streaming import intervals as streams

SEG = "record_id string, speaker string, start_s double, end_s double"


def rows_of(seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.choice("pq"), rng.choice("ab"), round(rng.uniform(0, 300), 2), 0.0) for _ in range(n)]
    return [(r, w, s, round(s + rng.choice([0.1, 1.0, 5.0, 20.0]), 2)) for r, w, s, _ in rows]


def drained(spark, stream):
    return sorted(tuple(r) for r in streams.drained(stream, scratch(spark, "out"), scratch(spark, "checkpoint")).collect())


def files(spark, parts, schema=SEG):
    """A stream of one file a batch."""
    path = scratch(spark, "files")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_merge_equals_the_batch(spark):
    rows = rows_of(1)
    end = [(r, "~", 1e5, 1e5 + 1) for r in "pq"]
    want = sorted(tuple(r) for r in batch.merge_gaps(spark.createDataFrame(rows, SEG)).collect())
    in_order = sorted(rows, key=lambda r: r[2])
    shuffled = [in_order[k::3] for k in range(3)]  # out of order, but within the watermark's delay
    assert drained(spark, streams.merge_gaps(files(spark, [*shuffled, end]), late="10 minutes")) == want
    by_time = [in_order[k : k + 30] for k in range(0, len(rows), 30)]
    assert drained(spark, streams.merge_gaps(files(spark, [*by_time, end]), late="1 second")) == want


def test_late_rows_are_left_out_and_open_segments_wait(spark):
    early, late = [("p", "a", 100.0, 101.0), ("p", "a", 101.2, 103.0)], [("p", "a", 10.0, 20.0)]
    after = [("p", "a", 500.0, 501.0)]
    got = drained(spark, streams.merge_gaps(files(spark, [early, [("q", "b", 400.0, 401.0)], late, after]), late="10 seconds"))
    # the late row comes when the watermark stands at 390; the last segment may still grow at 490
    assert got == [("p", "a", 100.0, 103.0), ("q", "b", 400.0, 401.0)]


def test_overlaps_equal_the_batch(spark):
    a, b = rows_of(2, 60), rows_of(3, 60)
    want = batch.overlaps(spark.createDataFrame(a, SEG), spark.createDataFrame(b, SEG))
    want = sorted((*r[:2], r.r_speaker, r.start_s, r.r_start_s, round(r.overlap_s, 6)) for r in want.collect())
    split = lambda rows: [sorted(rows, key=lambda r: r[2])[k : k + 20] for k in range(0, 60, 20)]
    out = streams.overlaps(files(spark, split(a)), files(spark, split(b)), longest_s=21.0, late="10 minutes")
    got = streams.drained(out, scratch(spark, "out"), scratch(spark, "checkpoint"))
    assert sorted((*r[:2], r.r_speaker, r.start_s, r.r_start_s, round(r.overlap_s, 6)) for r in got.collect()) == want and want
    short = streams.overlaps(files(spark, [a]), files(spark, [b]), longest_s=2.0, late="10 minutes")
    few = streams.drained(short, scratch(spark, "out"), scratch(spark, "checkpoint"))
    assert few.filter((F.col("end_s") - F.col("start_s") > 2) | (F.col("r_end_s") - F.col("r_start_s") > 2)).isEmpty() and few.count() > 0
