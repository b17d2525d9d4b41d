"""Grading of evaluation runs against fixed expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.operators import intervals

#: Expectations: what is measured, how it compares, and with what.
EXPECTATIONS = (
    ("H1", "single-language error rate", "<=", 0.25),
    ("H2", "error rate that code switching adds", ">=", 0.05),
    ("H3", "spread of error rates over accents", ">=", 0.02),
    ("H4", "share of long recordings completed", ">=", 1.0),
    ("H5", "error rate that music routing saves", ">=", 0.02),
    ("H6", "error rate that voice activity detection saves", ">=", 0.0),
    ("H_SD", "diarization error", "<=", 0.35),
    ("H_SNAP", "diarization error that snapping saves", ">=", 0.02),
)
_OPTIONAL = {
    "accent_majority": "string", "duration_s": "double", "hyp_text": "string", "has_music_interlude": "boolean", "der": "double", "der_snapped": "double",
    "route_music_wer": "double", "no_route_music_wer": "double", "vad_wer": "double", "no_vad_wer": "double",
}


def grade(records: DataFrame) -> DataFrame:
    """(name, what, threshold, measured, passed) of each expectation that the records have data for, in one pass and a small
    aggregate by accent."""
    rows = records
    for name, kind in _OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    single, long = F.col("code_switch_count") == 0, F.coalesce("duration_s", F.lit(0.0)) >= 60
    mean = lambda value, where: F.avg(F.when(where, value))
    wer, music = F.col("normalized_wer"), F.coalesce("has_music_interlude", F.lit(False))
    done = long & (F.coalesce("hyp_text", F.lit("")) != "") & (wer < 1)
    usable = single & F.col("accent_majority").isNotNull() & ~F.col("accent_majority").isin("", "_")
    accents = rows.filter(usable).groupBy("accent_majority").agg(F.avg("normalized_wer").alias("m")).agg(
        F.when(F.count(F.lit(1)) >= 2, F.max("m") - F.min("m")).alias("spread")
    )
    all_ = F.lit(True)
    measured = rows.agg(
        mean(wer, single).alias("H1"),
        (mean(wer, ~single) - mean(wer, single)).alias("H2"),
        (F.sum(done.cast("int")) / F.nullif(F.sum(long.cast("int")), F.lit(0))).alias("H4"),
        F.when(F.count(F.when(music, F.col("route_music_wer"))) > 0, F.coalesce(mean(F.col("no_route_music_wer") - F.col("route_music_wer"), music), F.lit(0.0))).alias("H5"),
        F.when(F.count("vad_wer") > 0, F.coalesce(mean(F.col("no_vad_wer") - F.col("vad_wer"), all_), F.lit(0.0))).alias("H6"),
        F.avg("der").alias("H_SD"),
        F.when(F.count("der_snapped") > 0, F.coalesce(F.avg(F.col("der") - F.col("der_snapped")), F.lit(0.0))).alias("H_SNAP"),
    ).withColumn("H3", accents.scalar())
    each = [
        F.struct(F.lit(n).alias("name"), F.lit(what).alias("what"), F.lit(limit).alias("threshold"), F.col(n).cast("double").alias("measured"),
                 ((F.col(n) <= limit) if sign == "<=" else (F.col(n) >= limit)).alias("passed"))
        for n, what, sign, limit in EXPECTATIONS
    ]
    return measured.select(F.explode(F.array(*each)).alias("e")).select("e.*").filter("measured is not null")


def render(rows: DataFrame, digits: int = 4) -> str:
    """A small result as a Markdown table."""
    found = rows.collect()
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in found)])


def record_profile(turns: DataFrame, audio: DataFrame, groups: dict[str, str] | None = None) -> DataFrame:
    """A row a record of audio (record_id, duration_s): its turns and speakers, how long they speak, alone or at once, and the
    turns' lengths. turns: record_id, start_s, end_s, speaker. ``groups`` counts speakers by the start of their name."""
    groups = {"n_e": "E", "n_i": "I"} if groups is None else groups
    known = turns.join(audio.select("record_id", "duration_s"), "record_id")
    size = F.col("end_s") - F.col("start_s")
    starts = lambda p: F.count_distinct(F.when(F.col("speaker").startswith(p), F.col("speaker")))
    per = known.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_distinct("speaker").alias("n_speakers"), *(starts(p).alias(n) for n, p in groups.items()),
        F.avg(size).alias("mean_turn_s"), F.median(size).alias("median_turn_s"), F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"),
    )
    spans = known.select("record_id", "start_s", "end_s", "duration_s")
    out = audio.join(per, "record_id", "left").join(intervals.union_seconds(spans, cap_s=F.col("duration_s")), "record_id", "left")
    out = out.join(intervals.overlap_seconds(spans), "record_id", "left").join(intervals.overshoot(spans, F.col("duration_s")), "record_id", "left")
    zeros = ["n_turns", "n_speakers", *groups, "mean_turn_s", "median_turn_s", "speech_s", "overlap_s", "overshoot_s"]
    out = out.na.fill(0, zeros).na.fill("", ["speakers"]).withColumn("n_other", F.col("n_speakers") - sum((F.col(g) for g in groups), F.lit(0)))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumn("speech_ratio", share("speech_s", "duration_s")).withColumn("overlap_ratio", share("overlap_s", "speech_s"))


def data_report(title: str, profile: DataFrame, tables: dict[str, DataFrame]) -> str:
    """A corpus as a Markdown report: totals over the profile's records, the records themselves, and further small tables."""
    total = profile.agg(
        F.count(F.lit(1)).alias("records"), text.duration_text(F.sum("duration_s")).alias("audio"), text.duration_text(F.sum("speech_s")).alias("speech"),
        F.sum("n_turns").alias("turns"), (F.sum("speech_s") / F.nullif(F.sum("duration_s"), F.lit(0.0))).alias("speech_ratio"),
        (F.sum("overlap_s") / F.nullif(F.sum("speech_s"), F.lit(0.0))).alias("overlap_ratio"),
    )
    parts = {"Totals": total, "Records": profile.orderBy("record_id"), **tables}
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{render(rows)}" for name, rows in parts.items())]) + "\n"


def language_mix(turns: DataFrame, key: str = "record_id", primary: str = "es") -> DataFrame:
    """(record, n_languages, code_switch_count): the primary language always counts."""
    langs = F.array_union(F.collect_set("language"), F.array(F.lit(primary)))
    return turns.groupBy(key).agg(F.size(langs).alias("n_languages"), F.count_if(F.col("language") != primary).alias("code_switch_count"))
