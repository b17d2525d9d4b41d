"""Composite pipelines: recognition of long recordings, diarization, fusion ablation."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import align, text
from voxloom.operators import chunks, diarization, intervals, models, select
from voxloom.plans import fixtures
from voxloom.sources.shared import bounded_batches, materialize


def transcribe(chunk_rows: DataFrame, recognizer, music: DataFrame | None = None, nonspeech: DataFrame | None = None) -> DataFrame:
    """(record_id, words): chunks without music are recognized, merged by record and masked.

    recognizer: a loader for models.recognize. The record is the only shuffle key.
    """
    rows = chunk_rows if music is None else intervals.outside(chunk_rows, music, intervals.midpoint())
    return masked_transcripts(models.recognize(rows, recognizer), nonspeech)


def masked_transcripts(recognized: DataFrame, nonspeech: DataFrame | None = None) -> DataFrame:
    """(record_id, words) of recognized chunks, merged by record, without the words inside of nonspeech intervals."""
    return without_masked(chunks.merge_chunks(recognized), nonspeech)


def without_masked(merged: DataFrame, nonspeech: DataFrame | None) -> DataFrame:
    """(record_id, words) without the words inside of nonspeech intervals, if there are any."""
    if nonspeech is None:
        return merged
    spans = nonspeech.groupBy("record_id").agg(F.collect_list(F.struct("start_s", "end_s")).alias("__spans"))
    none = F.array().cast("array<struct<start_s:double,end_s:double>>")
    return merged.join(spans, "record_id", "left").withColumn("words", intervals.mask_words(F.col("words"), F.coalesce("__spans", none))).drop("__spans")


def diarize(segments: DataFrame, labels: DataFrame, edges: DataFrame, overlap_events: DataFrame | None = None, event_labels: DataFrame | None = None) -> DataFrame:
    """(record_id, speaker, start_s, end_s): labelled segments, overlaps added, snapped to word edges and cleaned up."""
    named = diarization.label_zip(segments, labels).select("record_id", "start_s", "end_s", "speaker")
    if overlap_events is not None:
        named = intervals.assign_overlap(named, overlap_events, event_labels)
    return intervals.merge_gaps(intervals.snap(named, edges))


def enrich(chunk_rows: DataFrame, voiced: DataFrame, labelled: DataFrame) -> DataFrame:
    """chunks with speech_ratio, label, label_share, era_bucket, the record's 25th percentile of the ratio and a flag.

    chunk_rows: chunk_id, record_id, start_s, end_s, wada_snr_db, year.
    """
    rows = intervals.main_label(intervals.coverage_ratio(chunk_rows, voiced), labelled)
    p25 = rows.groupBy("record_id").agg(F.percentile("wada_snr_db", F.lit(0.25)).alias("snr_p25"))
    rows = rows.join(p25, "record_id").withColumn("era_bucket", select.era_bucket(F.col("year")))
    return rows.withColumn("flagged", select.flag_chunk(F.col("label"), F.col("label_share"), F.col("wada_snr_db"), F.col("snr_p25"), F.col("era_bucket")))


def enrich_audio(files: DataFrame, labelled: DataFrame, chunk_s: float = 30.0, overlap_s: float = 1.0, clusters: int = 5) -> DataFrame:
    """Chunks of recordings with all that is known of them, from (record_id, content, year) and (record_id, start_s, end_s, label).

    Speech is found by energy (a recording without any is one stretch), cut into chunks, and each chunk measured; the audio
    is decoded once for speech and once for the chunks: both results are written. Audio is sorted by record, never broadcast,
    as its compressed bytes say little of what it takes in memory. Features are grouped by k-means over all chunks.
    """
    from voxloom.operators import signal
    from voxloom.sources import wav

    bounded_batches(files.sparkSession)
    heard = files.select("record_id", signal.voice_udf("content").alias("v"), wav.probe("content").alias("p"))
    whole = F.array(F.struct(F.lit(0.0).alias("start_s"), F.col("p.duration_s").alias("end_s")))
    voiced = heard.select("record_id", F.explode(F.when(F.size("v") > 0, F.col("v")).otherwise(whole)).alias("s")).select("record_id", "s.*")
    voiced = materialize(voiced, "voiced")
    cut = intervals.chunk_intervals(voiced, chunk_s, overlap_s)
    listed = cut.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "start_s", "end_s"))).alias("chunks"))
    found = files.join(listed.hint("merge"), "record_id").select("record_id", "year", F.explode(signal.chunk_features_udf("content", "chunks")).alias("c")).select("record_id", "year", "c.*")
    found = materialize(found, "chunk-features")
    rows = signal.spectral_clusters(found.withColumnRenamed("snr_db", "wada_snr_db"), k=clusters)
    return enrich(rows, voiced, labelled)


@dataclass(frozen=True)
class Knobs:
    mbr: bool = True
    rover: bool = True
    mask: bool = True
    snap: bool = True

    @property
    def name(self) -> str:
        return "+".join(n if on else "—" for n, on in zip(("MBR", "ROVER", "MASK", "SNAP"), astuple(self), strict=True))


STEPS = (Knobs(False, False, False, False), Knobs(True, False, False, False), Knobs(True, True, False, False), Knobs(True, True, True, False), Knobs())


@dataclass(frozen=True)
class Recognitions:
    """What an ablation needs of any number of records: chunks (chunk_id, record_id, start_s, end_s), the first system's nbest
    (chunk_id, rank, text, score), others' words (chunk_id, system from 1, text), masks (record_id, start_s, end_s), references
    (record_id, ref), and the speakers of reference and hypothesis (record_id, start_s, end_s, speaker; ends (record_id, end_s))."""

    chunks: DataFrame
    nbest: DataFrame
    others: DataFrame
    masks: DataFrame
    references: DataFrame
    speakers: DataFrame
    hypothesis: DataFrame
    ends: DataFrame


def fused_words(data: Recognitions, knobs: Knobs) -> DataFrame:
    """(record_id, words) of each record, picked and fused by the steps that are on; masks come after it."""
    if knobs.mbr:
        picked = chunks.minimum_risk(data.nbest).select("chunk_id", "text")
    else:
        picked = data.nbest.groupBy("chunk_id").agg(F.max_by("text", F.struct("score", -F.col("rank"))).alias("text"))
    if knobs.rover:
        systems = picked.select("chunk_id", F.lit(0).alias("system"), "text").unionByName(data.others.select("chunk_id", "system", "text"))
        token = F.transform(text.tokens(F.col("text")), lambda w: F.struct(w.alias("word"), F.lit(1.0).alias("confidence")))
        said = chunks.fuse(systems.select("chunk_id", "system", token.alias("words")))
    else:
        said = picked.select("chunk_id", text.tokens(F.col("text")).alias("words"))
    rows = said.join(data.chunks, "chunk_id").select("record_id", "start_s", "end_s", chunks.even_spans(F.col("words"), F.col("start_s"), F.col("end_s")).alias("words"))
    return chunks.merge_chunks(rows)


def speaker_error(data: Recognitions, edges: DataFrame | None) -> DataFrame:
    """One row (der): frame errors of all records by their reference frames; the hypothesis is snapped and cleaned up if edges are given."""
    hyp = data.hypothesis
    if edges is not None:
        snapped = intervals.snap(hyp, edges).join(data.ends.withColumnRenamed("end_s", "record_end"), "record_id")
        hyp = intervals.merge_gaps(snapped, max_end=F.col("record_end"))
    last = data.ends.select("record_id", F.col("end_s").alias("record_end"))
    sides = [df.join(last, "record_id") for df in (data.speakers, hyp)]
    found = intervals.frame_error(*sides, F.col("record_end"))
    return found.agg((F.sum("error_frames") / F.greatest(F.sum("reference_frames"), F.lit(1))).alias("der"))


def rates(data: Recognitions, said: DataFrame, name: str) -> DataFrame:
    """One row (config, raw_wer, normalized_wer) of all records' words."""
    pairs = said.select("record_id", chunks.transcript(F.col("words")).alias("hyp")).join(data.references, "record_id")
    # words are made once, and then compared
    tracks = {"raw_wer": lambda c: c, "normalized_wer": text.normalize_for_eval}
    words = pairs.select(*(text.tokens(prepare(F.col(c))).alias(f"{track}_{c}") for track, prepare in tracks.items() for c in ("ref", "hyp")))
    sums = [(F.sum(align.wer_errors(F.col(f"{t}_ref"), F.col(f"{t}_hyp"))) / F.greatest(F.sum(F.size(f"{t}_ref")), F.lit(1))).alias(t) for t in tracks]
    return words.agg(*sums).select(F.lit(name).alias("config"), "raw_wer", "normalized_wer")


def fusion_ablation(data: Recognitions, steps: tuple[Knobs, ...] = STEPS) -> DataFrame:
    """(config, raw_wer, normalized_wer, der): one row a setting over all records; word edges always come from the full pipeline.

    Settings share what they have in common: words are fused once for each way to do it, and speakers are scored once with
    edges and once without.
    """
    fused = {(k.mbr, k.rover): k for k in (*steps, Knobs())}
    fused = {key: materialize(fused_words(data, knobs), "ablation-words") for key, knobs in fused.items()}
    edges = without_masked(fused[True, True], data.masks).select("record_id", F.explode(chunks.word_edges(F.col("words"))).alias("time_s")).distinct()
    der = {snap: materialize(speaker_error(data, edges if snap else None), "ablation-speakers") for snap in {k.snap for k in steps}}
    out = None
    for knobs in steps:
        said = without_masked(fused[knobs.mbr, knobs.rover], data.masks if knobs.mask else None)
        row = rates(data, said, knobs.name).withColumn("der", der[knobs.snap].scalar())
        out = row if out is None else out.unionByName(row)
    return out


def fixed_recognitions(spark: SparkSession, cases: list[tuple], mask: tuple[float, float], reference: str, speakers: list[tuple], misaligned: list[tuple], end_s: float) -> Recognitions:
    """One record of the fixtures."""
    table = spark.createDataFrame
    turns = lambda rows: table([("r", *r) for r in rows], "record_id string, start_s double, end_s double, speaker string")
    return Recognitions(
        table([(c, "r", a, b) for c, a, b, _, _ in cases], "chunk_id string, record_id string, start_s double, end_s double"),
        table([(c, k, t, s) for c, _, _, nbest, _ in cases for k, (t, s) in enumerate(nbest)], "chunk_id string, rank int, text string, score double"),
        table([(c, k + 1, t) for c, _, _, _, more in cases for k, t in enumerate(more)], "chunk_id string, system int, text string"),
        table([("r", *mask)], "record_id string, start_s double, end_s double"), table([("r", reference)], "record_id string, ref string"),
        turns(speakers), turns(misaligned), table([("r", end_s)], "record_id string, end_s double"),
    )


def fixed_fusion(spark: SparkSession) -> Recognitions:
    f = fixtures
    return fixed_recognitions(spark, f.FUSION_CHUNKS, f.FUSION_MASK, f.REFERENCE, f.FUSION_SPEAKERS, f.FUSION_MISALIGNED, f.FUSION_END)


def synthetic_run(spark: SparkSession) -> DataFrame:
    """One row: error rates of the overlapping fixture, and its diarization error before and after snapping."""
    f = fixtures
    data = fixed_recognitions(spark, f.SYNTHETIC_CHUNKS, f.SYNTHETIC_MASK, f.REFERENCE, f.SYNTHETIC_SPEAKERS, f.SYNTHETIC_MISALIGNED, f.SYNTHETIC_END)
    return fusion_ablation(data, (Knobs(),)).withColumn("der_before", speaker_error(data, None).scalar())


def fixed_words(chunk_rows: DataFrame) -> DataFrame:
    """chunk_rows with ``words``, as a recognizer with fixed habits gives them: in speech the fixture's words (and a laugh) whose
    midpoints lie in the chunk, in silence and music what it invents, spread over the chunk. A chunk is of the section at its midpoint."""
    f = fixtures
    timed = [(w, a + k * (b - a) / len(f.SAID[a]), a + (k + 1) * (b - a) / len(f.SAID[a])) for kind, a, b in f.SECTIONS if kind == "speech" for k, w in enumerate(f.SAID[a])]
    timed = sorted([*timed, ("[risas]", *f.LAUGHTER)], key=lambda w: w[1])
    cell = lambda w, a, b: F.struct(F.lit(w).alias("word"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s"), F.lit(1.0).alias("confidence"))
    said = F.filter(F.array(*(cell(*w) for w in timed)), lambda w: ((w["start_s"] + w["end_s"]) / 2 >= F.col("start_s")) & ((w["start_s"] + w["end_s"]) / 2 < F.col("end_s")))
    made_up = {kind: chunks.even_spans(F.array(*map(F.lit, words)), F.col("start_s"), F.col("end_s")) for kind, words in f.INVENTED.items()}
    middle, words = intervals.midpoint(), made_up["silence"]
    for kind, a, b in f.SECTIONS:
        words = F.when((middle >= a) & (middle < b), said if kind == "speech" else made_up[kind]).otherwise(words)
    return chunk_rows.withColumn("words", words)


def front_end_ablation(spark: SparkSession) -> DataFrame:
    """(config, raw_wer, normalized_wer, chunks, skipped) of the fixed minute: nothing, voice activity, music routing, masking."""
    from voxloom.operators import signal

    f = fixtures
    voiced = signal.voice_segments(f.minute(), 16000) or [(0.0, 60.0)]
    one = lambda rows, *more: spark.createDataFrame([("r", *r) for r in rows], "record_id string, start_s double, end_s double" + "".join(more))
    reference = " ".join(w for words in f.SAID.values() for w in words)
    out = None
    for vad, route, mask in ((False, False, False), (True, False, False), (True, True, False), (True, True, True)):
        rows = intervals.chunk_intervals(one(voiced if vad else [(0.0, 60.0)]), 10.0, 0.0)
        kept = intervals.outside(rows, one([f.MUSIC]), intervals.midpoint()) if route else rows
        said = masked_transcripts(fixed_words(kept), one([f.LAUGHTER]) if mask else None)
        words = said.select(chunks.transcript(F.col("words")).alias("hyp"), F.lit(reference).alias("ref"))
        rates = [align.wer(text.tokens(g(F.col("ref"))), text.tokens(g(F.col("hyp")))).alias(n) for n, g in (("raw_wer", lambda c: c), ("normalized_wer", text.normalize_for_eval))]
        n_all, n_kept = rows.agg(F.count(F.lit(1)).alias("n")), kept.agg(F.count(F.lit(1)).alias("n"))
        name = "+".join(n if on else "—" for n, on in zip(("VAD", "MUSIC-ROUTE", "MASK"), (vad, route, mask), strict=True))
        row = words.select(F.lit(name).alias("config"), *rates).withColumn("chunks", n_kept.scalar()).withColumn("skipped", n_all.scalar() - F.col("chunks"))
        out = row if out is None else out.unionByName(row)
    return out
