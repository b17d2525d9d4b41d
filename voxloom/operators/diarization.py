"""Diarization error with the best mapping of speakers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.sources.shared import bounded_batches

SECONDS = ("miss_s", "false_alarm_s", "confusion_s", "reference_s")


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total gain: shortest augmenting paths with potentials."""
    rows, cols = gain.shape
    if rows > cols:
        return [(r, c) for c, r in best_assignment(gain.T)]
    cost = gain.max(initial=0) - gain
    u, v = np.zeros(rows + 1), np.zeros(cols + 1)
    owner = np.zeros(cols + 1, int)
    for r in range(1, rows + 1):
        owner[0], at = r, 0
        least, back, used = np.full(cols + 1, np.inf), np.zeros(cols + 1, int), np.zeros(cols + 1, bool)
        while owner[at]:
            used[at] = True
            free = np.flatnonzero(~used)
            slack = cost[owner[at] - 1, free - 1] - u[owner[at]] - v[free]
            nearer = slack < least[free]
            least[free[nearer]], back[free[nearer]] = slack[nearer], at
            nxt = free[least[free].argmin()]
            step = least[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = nxt
        while at:
            owner[at], at = owner[back[at]], back[at]
    return [(owner[c] - 1, c - 1) for c in range(1, cols + 1) if owner[c] and gain[owner[c] - 1, c - 1] > 0]


def record_error(reference: list[tuple[float, float, str]], hypothesis: list[tuple[float, float, str]]) -> dict[str, float]:
    """Seconds of miss, false alarm, confusion and reference of one record; overlap counts, no collar."""
    cuts = np.unique([t for s, e, _ in [*reference, *hypothesis] for t in (s, e)])
    size = np.diff(cuts)

    def active(side: list[tuple[float, float, str]]) -> np.ndarray:
        names = {who: k for k, who in enumerate(sorted({who for _, _, who in side}))}
        on = np.zeros((len(names), len(size)), bool)
        first, last = (np.searchsorted(cuts, [row[k] for row in side]).tolist() for k in (0, 1))
        for a, b, (_, _, who) in zip(first, last, side):
            on[names[who], a:b] = True
        return on

    ref, hyp = active(reference), active(hypothesis)
    n_ref, n_hyp = ref.sum(axis=0), hyp.sum(axis=0)
    together = (ref * size) @ hyp.T.astype(float) if len(ref) and len(hyp) else np.zeros((len(ref), len(hyp)))
    right = np.zeros(len(size))
    for r, h in best_assignment(together) if together.size else []:
        right += ref[r] & hyp[h]
    return {
        "miss_s": float((np.maximum(n_ref - n_hyp, 0) * size).sum()),
        "false_alarm_s": float((np.maximum(n_hyp - n_ref, 0) * size).sum()),
        "confusion_s": float(((np.minimum(n_ref, n_hyp) - right) * size).sum()),
        "reference_s": float((n_ref * size).sum()),
    }


def _segments(rows: pa.Array) -> list[list[tuple]]:
    """Of each row its segments (start, end, speaker), from arrays of structs."""
    flat = rows.flatten()
    found = list(zip(*(flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("s", "e")), flat.field("w").to_pylist()))
    ends = np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False)).tolist()
    return [found[a:b] for a, b in zip([0, *ends], ends)]


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in SECONDS]))
def _errors_udf(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """record_error of each row: as records are small as a rule, many go to Python at once."""
    found = [record_error(r, h) for r, h in zip(_segments(reference), _segments(hypothesis))]
    return pa.StructArray.from_arrays([pa.array([x[n] for x in found], pa.float64()) for n in SECONDS], list(SECONDS))


def error_by_record(reference: DataFrame, hypothesis: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, miss_s, false_alarm_s, confusion_s, reference_s, der) of records that both sides have; records run in parallel."""
    bounded_batches(reference.sparkSession)

    def side(df: DataFrame, mark: str) -> DataFrame:
        # fresh column names: both sides may come from one table
        segment = F.struct(F.col("start_s").cast("double").alias("s"), F.col("end_s").cast("double").alias("e"), F.col("speaker").cast("string").alias("w"))
        return df.select(F.col(key).cast("string").alias(f"{mark}k"), segment.alias(mark)).groupBy(f"{mark}k").agg(F.collect_list(mark).alias(mark))

    both = side(reference, "a").join(side(hypothesis, "b").hint("merge"), F.col("ak").eqNullSafe(F.col("bk")))
    out = both.select(F.col("ak").alias(key), _errors_udf("a", "b").alias("x")).select(key, "x.*")
    error = F.col("miss_s") + F.col("false_alarm_s") + F.col("confusion_s")
    return out.withColumn("der", F.when(F.col("reference_s") > 0, error / F.col("reference_s")).otherwise(0.0))


def total_error(by_record: DataFrame) -> DataFrame:
    """One row: accumulated seconds and their rates by reference seconds."""
    names = ("miss", "false_alarm", "confusion")
    sums = by_record.agg(F.sum("reference_s").alias("reference_s"), *(F.sum(f"{n}_s").alias(f"{n}_s") for n in names))
    ref = F.greatest("reference_s", F.lit(1e-12))
    return sums.select("*", *((F.col(f"{n}_s") / ref).alias(f"{n}_rate") for n in names), ((F.col("miss_s") + F.col("false_alarm_s") + F.col("confusion_s")) / ref).alias("der"))


def label_zip(segments: DataFrame, labels: DataFrame, key: str = "record_id") -> DataFrame:
    """segments (record, ordinal, ..) with the speaker of the same ordinal's cluster label."""
    return segments.join(labels.select(key, "ordinal", "label"), [key, "ordinal"]).withColumn("speaker", F.format_string("SPEAKER_%02d", "label")).drop("label")


def error_change(before: DataFrame, after: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, der, der_snapped, change) of records on both sides."""
    a, b = before.select(key, "der"), after.select(key, F.col("der").alias("der_snapped"))
    return a.join(b, key).withColumn("change", F.col("der_snapped") - F.col("der"))
