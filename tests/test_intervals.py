import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import chunks, intervals

SEG = "record_id string, start_s double, end_s double, speaker string"


def rows(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect())


def fold(segments, end=None):
    out = []
    for s, e, who in sorted((max(0.0, s), e if end is None else min(e, end), w) for s, e, w in segments):
        if e - s < 0.2:
            continue
        if out and out[-1][2] == who and s - out[-1][1] < 0.5:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, who])
    return sorted(tuple(map(lambda v: round(v, 6) if isinstance(v, float) else v, x)) for x in out)


def test_merge_equals_fold(spark):
    rng = random.Random(5)
    cases = {str(k): [(round(rng.uniform(0, 20), 2), 0.0, rng.choice("ab")) for _ in range(rng.randint(0, 9))] for k in range(60)}
    cases = {k: [(s, round(s + rng.uniform(0.1, 3), 2), w) for s, _, w in v] for k, v in cases.items()}
    df = spark.createDataFrame([(k, *x) for k, v in cases.items() for x in v], SEG)
    got = {}
    for r in intervals.merge_gaps(df).collect():
        got.setdefault(r.record_id, []).append((round(r.start_s, 6), round(r.end_s, 6), r.speaker))
    for k, v in cases.items():
        assert sorted(got.get(k, [])) == fold(v)


def test_merge_clamps_and_drops(spark):
    df = spark.createDataFrame([("r", -1.0, 1.0, "a"), ("r", 1.3, 1.4, "a"), ("r", 1.45, 99.0, "a"), ("r", 0.0, 0.1, "b")], SEG)
    assert rows(intervals.merge_gaps(df, max_end=F.lit(5.0)), "start_s", "end_s", "speaker") == [(0.0, 5.0, "a")]
    assert intervals.merge_gaps(df.limit(0)).count() == 0


def test_snap(spark):
    edges = lambda *t: spark.createDataFrame([("r", x) for x in t], "record_id string, time_s double")
    one = lambda s, e: spark.createDataFrame([("r", s, e, "a")], SEG)
    assert rows(intervals.snap(one(1.05, 3.10), edges(1.0, 2.0, 3.0)), "start_s", "end_s") == [(1.0, 3.0)]
    assert rows(intervals.snap(one(1.5, 3.5), edges(1.0, 4.0)), "start_s", "end_s") == [(1.5, 3.5)]
    assert rows(intervals.snap(one(1.5, 3.5), edges(1.25, 1.75), radius=0.25), "start_s", "end_s") == [(1.75, 3.5)]
    assert rows(intervals.snap(one(1.0, 1.1), edges(1.05)), "start_s", "end_s") == [(1.05, 1.25)]
    assert chunks.snap_to_edges([1.25, 1.75], 1.5, 0.25) == 1.75 and chunks.snap_to_edges([], 1.5, 0.2) == 1.5


def test_outside(spark):
    points = spark.createDataFrame([("r", 15.0), ("r", 45.0), ("r", 75.0), ("r", 60.0), ("q", 45.0)], "record_id string, at double")
    music = spark.createDataFrame([("r", 40.0, 60.0)], "record_id string, start_s double, end_s double")
    for widths in (None, intervals.Widths(7.0, 70.0), intervals.Widths(0.5, 3.0)):
        assert rows(intervals.outside(points, music, F.col("at"), widths=widths), "record_id", "at") == [("q", 45.0), ("r", 15.0), ("r", 60.0), ("r", 75.0)]


def test_lengths(spark):
    df = spark.createDataFrame([("r", 0.0, 5.0, "a"), ("r", 3.0, 8.0, "b"), ("r", 3.0, 4.0, "c"), ("r", 10.0, 12.0, "a")], SEG)
    assert rows(intervals.union_seconds(df), "speech_s") == [(10.0,)]
    assert rows(intervals.union_seconds(df, cap_s=F.lit(11.0)), "speech_s") == [(9.0,)]
    assert rows(intervals.overlap_seconds(df), "overlap_s") == [(2.0,)]
    assert rows(intervals.overshoot(df, F.lit(11.0)), "overshoot_s") == [(1.0,)]


def test_chunks(spark):
    seg = lambda *x: spark.createDataFrame([("r", *s) for s in x], "record_id string, start_s double, end_s double")
    assert rows(intervals.chunk_intervals(seg((0.0, 10.0))), "chunk_id", "start_s", "end_s") == [("r_c00000", 0.0, 10.0)]
    got = rows(intervals.chunk_intervals(seg((0.0, 60.0))), "start_s", "end_s")
    assert got[0] == (0.0, 30.0) and got[-1][1] == 60.0 and len(got) >= 2
    got = rows(intervals.chunk_intervals(seg((0.0, 90.0)), 30.0, 5.0), "start_s", "end_s")
    assert all(a[1] - b[0] == pytest.approx(5) for a, b in zip(got, got[1:]))
    assert rows(intervals.chunk_intervals(seg((0.0, 0.2), (5.0, 6.0))), "start_s") == [(5.0,)]
    with pytest.raises(ValueError):
        intervals.chunk_intervals(seg((0.0, 1.0)), 5.0, 5.0)


def test_labels_and_coverage(spark):
    c = spark.createDataFrame([("c1", "r", 0.0, 10.0), ("c2", "q", 0.0, 10.0), ("c3", "r", 50.0, 60.0)], "chunk_id string, record_id string, start_s double, end_s double")
    lab = spark.createDataFrame([("r", 0.0, 3.0, "x"), ("r", 3.0, 6.0, "y")], "record_id string, start_s double, end_s double, label string")
    assert rows(intervals.main_label(c, lab), "chunk_id", "label", "label_share") == [("c1", "x", 0.3), ("c2", "speech", 1.0), ("c3", "speech", 0.0)]
    assert rows(intervals.coverage_ratio(c, lab), "chunk_id", "speech_ratio") == [("c1", 0.6), ("c2", 0.0), ("c3", 0.0)]


def test_frame_error_counts_confusion_twice(spark):
    ref = spark.createDataFrame([("r", 0.0, 1.0, "a")], SEG)
    hyp = spark.createDataFrame([("r", 0.0, 1.0, "b")], SEG)
    assert rows(intervals.frame_error(ref, hyp, F.lit(1.0)), "error_frames", "reference_frames", "rate") == [(200, 100, 2.0)]


def test_overlap_assignment(spark):
    primary = spark.createDataFrame([("r", 0.0, 5.0, "A")], SEG)
    events = spark.createDataFrame([("r", 1.0, 2.0, 0, 1), ("r", 3.0, 4.0, 0, 2)], "record_id string, start_s double, end_s double, primary_index int, secondary_index int")
    labels = spark.createDataFrame([("r", 0, "A"), ("r", 1, "B"), ("r", 2, "A")], "record_id string, index int, speaker string")
    assert rows(intervals.assign_overlap(primary, events, labels), "start_s", "speaker") == [(0.0, "A"), (1.0, "B")]


def test_runs(spark):
    df = spark.createDataFrame([("r", i, i in range(5, 30) or i in range(40, 45)) for i in range(50)], "record_id string, frame int, flag boolean")
    assert rows(intervals.runs(df, 0.01), "start_s", "end_s") == [(0.05, 0.3)]


def random_intervals(rng, n, records):
    """Mostly short ones, some long, some empty or inverted; most of them in one record."""
    out = []
    for i in range(n):
        record = "hot" if rng.random() < 0.9 else rng.choice(records)
        start = round(rng.uniform(-50, 500), 2)
        length = rng.choice([rng.uniform(0, 2), rng.uniform(0, 2), rng.uniform(0, 2), 0.0, -1.0, rng.uniform(50, 400), 1000.0])
        out.append((record, i, start, round(start + length, 2)))
    return out


@pytest.mark.parametrize("widths", [None, intervals.Widths(0.3, 4.0), intervals.Widths(1000.0, 5000.0)])
def test_pairs_and_points_equal_all_pairs(spark, widths):
    rng = random.Random(11)
    a, b = random_intervals(rng, 120, "xyz"), random_intervals(rng, 150, "xyz")
    a += [("hot", 900, None, 3.0), (None, 901, 1.0, 2.0)]
    schema = "record_id string, id int, start_s double, end_s double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = [(r.id, r.r_id, round(r.overlap_s, 6)) for r in intervals.overlaps(left, right, widths=widths).collect()]
    want = [(i, j, round(min(e, f) - max(s, t), 6)) for k, i, s, e in a for m, j, t, f in b if k == m and s is not None and s < f and t < e]
    assert sorted(got) == sorted(want) and len(want) > 1000
    free = intervals.outside(left.filter("start_s is not null"), right, F.col("start_s"), widths=widths)
    assert sorted(r.id for r in free.collect()) == [i for k, i, s, _ in a if s is not None and not any(k == m and t <= s < f for m, _, t, f in b)]
    assert intervals.overlaps(left.limit(0), right).count() == 0 and intervals.outside(left, right.limit(0), F.col("start_s")).count() == len(a)


def test_intervals_are_listed_a_bounded_number_of_times(spark):
    """A few intervals of a million seconds among many of one second."""
    rows_ = [("r", float(i), i + 1.0) for i in range(2000)] + [("r", 0.0, 1e6)] * 3
    df = spark.createDataFrame(rows_, "record_id string, start_s double, end_s double")
    widths = intervals.Widths.of(df)
    for left in (True, False):
        n = df.select(F.sum(F.size(widths.listed(F.col("start_s"), F.col("end_s"), left)))).first()[0]
        assert n <= 6 * len(rows_)
    assert intervals.Widths.of(df.limit(0)) == intervals.Widths() and widths.fine == 1.0


def test_frames_are_counted_not_listed(spark):
    rng = random.Random(12)
    side = lambda: [(rng.choice("pq"), round(rng.uniform(-1, 6), 3), 0.0, rng.choice("ab")) for _ in range(25)]
    ref, hyp = ([(k, s, round(s + rng.uniform(-0.1, 2), 3), w) for k, s, _, w in side()] for _ in range(2))
    frames = lambda seg, k, w: {f for x, s, e, y in seg if (x, y) == (k, w) for f in range(max(0, min(500, round(s / 0.01))), max(0, min(500, round(e / 0.01))))}
    want = []
    for k in "pq":
        error = sum(len(frames(ref, k, w) ^ frames(hyp, k, w)) for w in "ab")
        size = sum(len(frames(ref, k, w)) for w in "ab")
        want.append((k, error, size))
    df = lambda x: spark.createDataFrame(x, SEG)
    assert rows(intervals.frame_error(df(ref), df(hyp), F.lit(5.0)), "record_id", "error_frames", "reference_frames") == want
    days = df([("r", 0.0, 1e9, "a")])
    assert rows(intervals.frame_error(days, days.withColumn("end_s", F.lit(1e9 - 5)), F.lit(1e9)), "error_frames", "reference_frames") == [(500, 100_000_000_000)]
