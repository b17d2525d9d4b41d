"""Baseline runs with injected models, and the choice of training rows.

Models come as loaders (see operators.models): called once a task, they give a callable for one row.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.operators import chunks, diarization, intervals, models, score, select
from voxloom.operators.report import grade
from voxloom.sources.shared import materialize

Loader = Callable[[], Callable[[dict], str]]


def said_by(manifest: DataFrame, load: Loader, out: str, key: str = "segment_id", clock: bool = False) -> DataFrame:
    """(key, out[, elapsed_s]): what a recognizer makes of each row of the manifest, with the seconds it took."""

    def loaded() -> Callable[[dict], dict]:
        model = load()

        def one(row: dict) -> dict:
            began = time.perf_counter()
            heard = model(row)
            return {key: row[key], out: heard} | ({"elapsed_s": time.perf_counter() - began} if clock else {})

        return one

    kind = manifest.schema[key].dataType.simpleString()
    return models.apply_model(manifest, loaded, f"{key} {kind}, {out} string" + ", elapsed_s double" * clock)


def recognition_baseline(manifest: DataFrame, load: Loader, second: Loader | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, one summary row): each clip's reference and hypotheses, and corpus rates of the first system and of both fused.

    manifest: segment_id, transcript and what the models need. Rates are micro averages, raw and normalized.
    """
    rows = manifest.select("segment_id", F.col("transcript").alias("ref")).join(said_by(manifest, load, "hyp"), "segment_id")
    if second is None:
        rows = rows.withColumn("hyp_second", F.lit(None).cast("string")).withColumn("hyp_fused", F.lit(None).cast("string"))
    else:
        rows = rows.join(said_by(manifest, second, "hyp_second"), "segment_id")
        token = lambda c: F.transform(text.tokens(text.post_edit_raw(F.col(c))), lambda w: F.struct(w.alias("word"), F.lit(1.0).alias("confidence")))
        both = rows.select("segment_id", F.explode(F.array(*(F.struct(F.lit(k).alias("system"), token(c).alias("words")) for k, c in enumerate(("hyp", "hyp_second"))))).alias("x"))
        fused = chunks.fuse(both.select("segment_id", "x.system", "x.words"), key="segment_id")
        rows = rows.join(fused.select("segment_id", F.array_join("words", " ").alias("hyp_fused")), "segment_id")
    # models and votes run once a clip: what they give is written, and one pass over it makes all rates
    rows = materialize(rows, "recognized")
    scored = rows
    for name, said, track in (("raw", "hyp", "raw"), ("normalized", "hyp", "normalized"), ("fused", "hyp_fused", "normalized")):
        scored = score.scored_pairs(scored, hypothesis=said, track=track).withColumnsRenamed({"errors": f"{name}_errors", "words": f"{name}_words"})
    some = lambda c: F.when(F.col("hyp_fused").isNotNull(), F.col(c))
    summary = scored.agg(
        F.count(F.lit(1)).alias("records"), score.rate("raw_errors", "raw_words").alias("raw_wer"), score.rate("normalized_errors", "normalized_words").alias("normalized_wer"),
        score.rate(some("fused_errors"), some("fused_words")).alias("fused_wer"),
    )
    return rows, summary


def diarization_baseline(manifest: DataFrame, reference: DataFrame, hypothesis: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(record_id, der, der_snapped, change): segments cleaned up within the record's duration, then snapped to word edges and
    cleaned up again; records without edges have nulls in the last two.

    manifest: record_id, duration_s; reference and hypothesis: record_id, start_s, end_s, speaker; edges: record_id, time_s.
    """
    known = F.col("duration_s")

    def cleaned(rows: DataFrame) -> DataFrame:
        return intervals.merge_gaps(rows.join(manifest.select("record_id", "duration_s"), "record_id"), max_end=known).select("record_id", "start_s", "end_s", "speaker")

    base = cleaned(hypothesis)
    before = diarization.error_by_record(reference, base).select("record_id", "der")
    if edges is None:
        return before.withColumn("der_snapped", F.lit(None).cast("double")).withColumn("change", F.lit(None).cast("double"))
    some = base.join(edges.select("record_id").distinct(), "record_id", "left_semi")
    after = diarization.error_by_record(reference, cleaned(intervals.snap(some, edges)))
    return before.join(diarization.error_change(before, after), ["record_id", "der"], "left")


def synthetic_validation(manifest: DataFrame, load: Loader, diarized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, grades): error rates of each synthetic recording on both tracks, and the expectations graded on them.

    manifest: record_id, transcript and the columns that report.grade knows; diarized: record_id, der, der_snapped.
    """
    said = manifest.join(said_by(manifest, load, "hyp_text", "record_id"), "record_id")
    scored = score.dual_track(said, "transcript", "hyp_text", tuple(said.columns)).drop("raw_errors", "raw_words", "errors", "words")
    if diarized is not None:
        scored = scored.join(diarized.select("record_id", "der", "der_snapped"), "record_id", "left")
    return scored, grade(scored)


def corpus_run(manifest: DataFrame, load: Loader, record_ids: list[str] | None = None) -> DataFrame:
    """(record_id, hyp, duration_s, elapsed_s, real_time_factor, errors, words, wer) of long recordings, all or some."""
    rows = select.allow_records(manifest, record_ids)
    heard = rows.join(said_by(rows, load, "hyp", "record_id", clock=True), "record_id")
    scored = score.scored_pairs(heard, "transcript", "hyp")
    factor = F.when(F.col("duration_s") > 0, F.col("elapsed_s") / F.col("duration_s"))
    return scored.select("record_id", "hyp", "duration_s", "elapsed_s", factor.alias("real_time_factor"), "errors", "words", (F.col("errors") / F.greatest("words", F.lit(1))).alias("wer"))


def training_rows(manifest: DataFrame, pseudo: DataFrame | None = None) -> DataFrame:
    """(audio_path, transcript, split): train and dev rows of the manifest, and pseudo-labelled rows as train; rows of evaluation
    sources fail the run."""
    rows = select.guard_sources(manifest)
    out = rows.filter(F.col("split").isin("train", "dev")).select("audio_path", "transcript", "split")
    if pseudo is None:
        return out
    return out.unionByName(select.guard_sources(pseudo).select("audio_path", "transcript", F.lit("train").alias("split")))
