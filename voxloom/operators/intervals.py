"""Interval algebra over timelines: half-open intervals [start_s, end_s) keyed by a record.

Every join carries the record key and a bin of time (``interval_join``), so that a record with most of all intervals is
dealt over tasks like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import interval_join
from voxloom.operators.interval_join import Widths

MIN_SEGMENT_S = 0.20
MERGE_GAP_S = 0.50
SNAP_RADIUS_S = 0.20


def midpoint(start: str = "start_s", end: str = "end_s") -> Column:
    return 0.5 * (F.col(start) + F.col(end))


def outside(points: DataFrame, intervals: DataFrame, at: Column, key: str = "record_id", widths: Widths | None = None) -> DataFrame:
    """Rows of points whose time lies in no interval of their record (point-in-interval anti join)."""
    return interval_join.outside(points, intervals, at, key, widths)


def mask_words(words: Column, intervals: Column) -> Column:
    """Words (array of structs) whose midpoint lies in none of the intervals (array of structs); order stays."""
    return F.filter(words, lambda w: ~F.exists(intervals, lambda i: (0.5 * (w.start_s + w.end_s) >= i.start_s) & (0.5 * (w.start_s + w.end_s) < i.end_s)))


def overlaps(left: DataFrame, right: DataFrame, key: str = "record_id", widths: Widths | None = None) -> DataFrame:
    """Pairs of overlapping intervals with ``overlap_s``; right's columns get the prefix ``r_``."""
    pairs = interval_join.overlapping(left, right, key, widths=widths)
    return pairs.withColumn("overlap_s", F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s"))


def coverage_ratio(chunks: DataFrame, spans: DataFrame, id_col: str = "chunk_id", key: str = "record_id", out: str = "speech_ratio") -> DataFrame:
    """chunks with the share of each that spans cover (overlaps summed); 0 for an empty chunk."""
    covered = overlaps(chunks.select(id_col, key, "start_s", "end_s"), spans.select(key, "start_s", "end_s"), key).groupBy(id_col).agg(F.sum("overlap_s").alias("__c"))
    size = F.col("end_s") - F.col("start_s")
    return chunks.join(covered, id_col, "left").withColumn(out, F.when(size > 0, F.coalesce("__c", F.lit(0.0)) / size).otherwise(0.0)).drop("__c")


def main_label(chunks: DataFrame, labelled: DataFrame, id_col: str = "chunk_id", key: str = "record_id", default: str = "speech") -> DataFrame:
    """chunks with the label that covers most of each (ties: the one that starts first) and its share.

    Without an overlapping label: the default with share 0; in a record without any label: the default with share 1. A chunk
    without a length that lies inside a label has that label, and NaN for its share.
    """
    hits = overlaps(chunks.select(id_col, key, "start_s", "end_s"), labelled.select(key, "start_s", "end_s", "label"), key)
    per = hits.groupBy(id_col, "r_label").agg(
        F.sum("overlap_s").alias("covered"), F.min("r_start_s").alias("first"), F.first(F.col("end_s") - F.col("start_s")).alias("size")
    )
    part = F.when(F.col("size") != 0, F.col("covered") / F.col("size")).otherwise(float("nan"))
    best = per.groupBy(id_col).agg(F.max_by(F.struct("r_label", part.alias("share")), F.struct("covered", -F.col("first"))).alias("b"))
    known = labelled.select(F.col(key).alias("__k")).distinct().withColumn("__any", F.lit(True))
    out = chunks.join(best, id_col, "left").join(known, F.col(key) == F.col("__k"), "left")
    share = F.when(F.col("__any").isNull(), 1.0).otherwise(F.coalesce("b.share", F.lit(0.0)))
    return out.withColumn("label", F.coalesce("b.r_label", F.lit(default))).withColumn("label_share", share).drop("b", "__k", "__any")


def nearest(edges: Column, target: Column, radius: float) -> Column:
    """The edge (array<double>) nearest to the target within the radius, ends included (ties: the later); null if none."""
    near = F.filter(edges, lambda e: F.abs(e - target) <= radius)
    best = F.array_min(F.transform(near, lambda e: F.struct(F.abs(e - target).alias("gap"), (-e).alias("back"))))
    return -best["back"]


def snap(segments: DataFrame, edges: DataFrame, key: str = "record_id", radius: float = SNAP_RADIUS_S) -> DataFrame:
    """Segment starts and ends moved to the nearest edge of their record within the radius (edges: (record, time_s)).

    An end that would come before its start becomes start + MIN_SEGMENT_S, or stays if that is later. Edges are matched in
    bins of the radius's width, probing a target's bin and both neighbours.
    """
    width = max(radius, 1e-9)
    listed = edges.select(F.col(key).alias("__k"), F.col("time_s").alias("__t"), F.floor(F.col("time_s") / width).alias("__b"))
    rows = segments

    def moved(col: str) -> DataFrame:
        probe = segments.select(key, col).distinct().withColumn("__bin", F.explode(F.array(*(F.floor(F.col(col) / width) + d for d in (-1, 0, 1)))))
        hits = probe.join(listed, (F.col(key) == F.col("__k")) & (F.col("__bin") == F.col("__b")) & (F.abs(F.col("__t") - F.col(col)) <= radius))
        best = hits.groupBy(key, col).agg(F.min(F.struct(F.abs(F.col("__t") - F.col(col)).alias("gap"), (-F.col("__t")).alias("back"))).alias("m"))
        return best.select(F.col(key).alias(f"__k_{col}"), F.col(col).alias(f"__v_{col}"), (-F.col("m.back")).alias(f"__{col}"))

    for col in ("start_s", "end_s"):
        rows = rows.join(moved(col), (F.col(key) == F.col(f"__k_{col}")) & (F.col(col) == F.col(f"__v_{col}")), "left")
    start, end = F.coalesce("__start_s", "start_s"), F.coalesce("__end_s", "end_s")
    fixed = F.when(end <= start, F.greatest(start + MIN_SEGMENT_S, end)).otherwise(end)
    values = {"start_s": start, "end_s": fixed}
    return rows.select(*(values.get(c, F.col(c)).alias(c) for c in segments.columns))


def merge_gaps(
    segments: DataFrame, key: str = "record_id", label: str = "speaker", max_end: Column | None = None,
    min_s: float = MIN_SEGMENT_S, gap_s: float = MERGE_GAP_S,
) -> DataFrame:
    """Same-label neighbours with a gap under gap_s become one; another label in between keeps them apart.

    Times are clamped to [0, max_end] first, and segments under min_s are dropped. (record, label, start_s, end_s).
    """
    start = F.greatest(F.col("start_s"), F.lit(0.0))
    end = F.least(F.col("end_s"), max_end) if max_end is not None else F.col("end_s")
    rows = segments.select(key, label, start.alias("start_s"), end.alias("end_s")).filter(F.col("end_s") - F.col("start_s") >= min_s)
    order = Window.partitionBy(key).orderBy("start_s", "end_s", label)
    other = (~F.col(label).eqNullSafe(F.lag(label).over(order))) | (F.row_number().over(order) == 1)
    run = F.sum(other.cast("int")).over(order)
    rows = rows.withColumn("__run", run)
    inside = Window.partitionBy(key, "__run").orderBy("start_s", "end_s")
    reach = F.max("end_s").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__island", F.sum(F.coalesce((F.col("start_s") - reach >= gap_s).cast("int"), F.lit(0))).over(inside))
    merged = rows.groupBy(key, "__run", "__island", label).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return merged.select(key, label, "start_s", "end_s")


def union_seconds(spans: DataFrame, key: str = "record_id", cap_s: Column | None = None, out: str = "speech_s") -> DataFrame:
    """(record, seconds covered by at least one span); ends are clipped to cap_s, empty spans dropped."""
    end = F.least(F.col("end_s"), cap_s) if cap_s is not None else F.col("end_s")
    rows = spans.select(key, "start_s", end.alias("end_s")).filter("end_s > start_s")
    order = Window.partitionBy(key).orderBy("start_s", "end_s").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0.0), F.col("end_s") - F.greatest(F.col("start_s"), F.coalesce(F.max("end_s").over(order), F.col("start_s"))))
    return rows.withColumn("__new", fresh).groupBy(key).agg(F.sum("__new").alias(out))


def overlap_seconds(spans: DataFrame, key: str = "record_id", out: str = "overlap_s") -> DataFrame:
    """(record, seconds with two or more spans at once), by a sweep over starts and ends."""
    events = spans.select(key, F.col("start_s").alias("t"), F.lit(1).alias("d")).unionAll(spans.select(key, F.col("end_s").alias("t"), F.lit(-1).alias("d")))
    events = events.groupBy(key, "t").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(key).orderBy("t")
    active = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    step = events.withColumn("__n", active).withColumn("__next", F.lead("t").over(order))
    return step.groupBy(key).agg(F.sum(F.when(F.col("__n") >= 2, F.col("__next") - F.col("t")).otherwise(0.0)).alias(out))


def overshoot(spans: DataFrame, duration_s: Column, key: str = "record_id") -> DataFrame:
    """(record, seconds by which the last end exceeds the duration)."""
    return spans.groupBy(key).agg(F.max("end_s").alias("__e"), F.max(duration_s).alias("__d")).select(key, F.greatest(F.lit(0.0), F.col("__e") - F.col("__d")).alias("overshoot_s"))


def chunk_intervals(segments: DataFrame, chunk_s: float = 30.0, overlap_s: float = 1.0, key: str = "record_id", min_s: float = 0.25) -> DataFrame:
    """Sliding chunks of each segment: (record, chunk_id, start_s, end_s); ids count on through a record's segments.

    Segments under min_s are skipped. A remainder of half a chunk or more is a chunk of its own that begins overlap_s before
    the last end; a smaller one is added to the last chunk.
    """
    if chunk_s <= overlap_s:
        raise ValueError("a chunk must be longer than the overlap")
    step = chunk_s - overlap_s
    rows = segments.select(key, "start_s", "end_s").filter(F.col("end_s") - F.col("start_s") >= min_s)
    length = F.col("end_s") - F.col("start_s")
    full = F.when(length <= chunk_s, 0).otherwise(F.floor((length - chunk_s) / step + F.lit(1e-9)) + 1).cast("int")
    rows = rows.withColumn("__full", full)
    last = F.col("start_s") + (F.col("__full") - 1) * step + chunk_s
    rest = F.when(F.col("__full") > 0, F.greatest(F.lit(0.0), F.col("end_s") - last)).otherwise(0.0)
    rows = rows.withColumn("__last", last).withColumn("__rest", rest).withColumn("__extra", (F.col("__rest") >= chunk_s / 2).cast("int"))
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("__full") + F.col("__extra")) - 1)))
    start = F.when(F.col("__full") == 0, F.col("start_s")).when(F.col("__i") < F.col("__full"), F.col("start_s") + F.col("__i") * step).otherwise(F.col("__last") - overlap_s)
    is_last = F.col("__i") == F.col("__full") + F.col("__extra") - 1
    end = F.when((F.col("__full") == 0) | is_last, F.col("end_s")).otherwise(F.col("start_s") + F.col("__i") * step + chunk_s)
    number = F.row_number().over(Window.partitionBy(key).orderBy("__s", "__e", "__i")) - 1
    rows = rows.select(key, F.col("start_s").alias("__s"), F.col("end_s").alias("__e"), "__i", F.round(start, 3).alias("start_s"), F.round(end, 3).alias("end_s"))
    return rows.withColumn("chunk_id", F.format_string("%s_c%05d", F.col(key), number)).select(key, "chunk_id", "start_s", "end_s")


def runs(flags: DataFrame, hop_s: float, min_s: float = MIN_SEGMENT_S, key: str = "record_id") -> DataFrame:
    """(record, start_s, end_s) of runs of true frames, from (record, frame, flag); runs under min_s are dropped."""
    order = Window.partitionBy(key).orderBy("frame")
    rows = flags.filter("flag").withColumn("__g", F.col("frame") - F.row_number().over(order))
    out = rows.groupBy(key, "__g").agg((F.min("frame") * hop_s).alias("start_s"), ((F.max("frame") + 1) * hop_s).alias("end_s"))
    return out.filter(F.col("end_s") - F.col("start_s") >= min_s - 1e-9).select(key, "start_s", "end_s")


def assign_overlap(primary: DataFrame, events: DataFrame, labels: DataFrame, key: str = "record_id") -> DataFrame:
    """primary segments, and a second speaker's segment for each overlap event whose two embeddings have unlike labels.

    events: (record, start_s, end_s, primary_index, secondary_index); labels: (record, index, speaker).
    """
    of = lambda n: labels.select(F.col(key).alias(f"__{n}k"), F.col("index").alias(f"__{n}i"), F.col("speaker").alias(f"__{n}"))
    found = events.join(of("p"), (F.col(key) == F.col("__pk")) & (F.col("primary_index") == F.col("__pi")))
    found = found.join(of("q"), (F.col(key) == F.col("__qk")) & (F.col("secondary_index") == F.col("__qi"))).filter("__p <> __q")
    return primary.select(key, "start_s", "end_s", "speaker").unionByName(found.select(key, "start_s", "end_s", F.col("__q").alias("speaker")))


def frame_error(reference: DataFrame, hypothesis: DataFrame, duration_s: Column, key: str = "record_id", frame_s: float = 0.01) -> DataFrame:
    """(record, error_frames, reference_frames, rate): frames and speakers that one side has alone, by the reference's.

    A confused frame counts twice. Bounds round half to even; frames lie within the record's duration. Nothing is mapped.
    Frames are counted between the bounds of a speaker's segments, so that rows grow with segments and not with time.
    """

    def steps(df: DataFrame, side: str) -> DataFrame:
        n = F.rint(duration_s / frame_s).cast("long")
        first, last = (F.least(F.greatest(F.rint(F.col(c) / frame_s).cast("long"), F.lit(0).cast("long")), n) for c in ("start_s", "end_s"))
        rows = df.select(F.col(key).alias("k"), F.col("speaker").alias("who"), first.alias("a"), last.alias("b")).filter("b > a")
        rows = rows.select("k", "who", F.explode(F.array(F.struct(F.col("a").alias("f"), F.lit(1).alias("d")), F.struct(F.col("b").alias("f"), F.lit(-1).alias("d")))).alias("x"))
        return rows.select("k", "who", "x.f", *(F.col("x.d").alias(c) if c == side else F.lit(0).alias(c) for c in ("r", "h")))

    both = steps(reference, "r").unionByName(steps(hypothesis, "h")).groupBy("k", "who", "f").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    order = Window.partitionBy("k", "who").orderBy("f")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    between = both.select("k", (F.lead("f").over(order) - F.col("f")).alias("n"), (F.sum("r").over(upto) > 0).alias("r"), (F.sum("h").over(upto) > 0).alias("h"))
    count = lambda some: F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).cast("long")
    out = between.groupBy(F.col("k").alias(key)).agg(count(F.col("r") != F.col("h")).alias("error_frames"), count(F.col("r")).alias("reference_frames"))
    return out.withColumn("rate", F.when(F.col("reference_frames") == 0, 0.0).otherwise(F.col("error_frames") / F.col("reference_frames")))


def tagged_intervals(chunks: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(record_id, start_s, end_s, tag) for each of a chunk's tags that is among ``tags``."""
    return chunks.select("record_id", "start_s", "end_s", F.explode("tags").alias("tag")).filter(F.lower("tag").isin(*tags))


def music_intervals(chunks: DataFrame, labels: tuple[str, ...] = ("music", "noenergy"), tags: tuple[str, ...] = ("music", "singing")) -> DataFrame:
    """(record_id, start_s, end_s) of chunks that their label or a tag marks as music."""
    tagged = F.coalesce(F.exists("tags", lambda t: F.lower(t).isin(*tags)), F.lit(False))
    return chunks.filter(F.coalesce(F.lower("label").isin(*labels), F.lit(False)) | tagged).select("record_id", "start_s", "end_s")
