"""Row selection: stratified splits, quality gates, quotas and guards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import align, text
from voxloom.operators import ranks

# Tags of evaluation sources.
BENCH_SOURCES = ("cv_es", "cv_multilingual", "voxconverse", "synthetic", "synth_coser")


@dataclass(frozen=True)
class GateConfig:
    """Buckets of signal-to-noise ratio [low, high) with the log-probability that each asks for."""

    agreement: float = 0.85
    max_z: float = 2.0
    buckets: tuple[tuple[float, float, float], ...] = ((-1e9, 5.0, -0.55), (5.0, 15.0, -0.45), (15.0, 1e9, -0.35))


@dataclass(frozen=True)
class LanguageConfig:
    primary: str = "es"
    allowed: tuple[str, ...] = ("es", "ca", "gl", "eu")
    threshold: float = 0.70


def stratum(province: Column, age: Column, topic: Column) -> Column:
    """``province|decade|topic``; a null or NaN age is NA, null texts are None."""
    known = age.isNotNull() & ~F.isnan(age.cast("double"))
    decade = F.when(known, F.concat(F.lit("d"), (F.floor(age.cast("double") / 10) * 10).cast("int").cast("string"))).otherwise("NA")
    return F.concat_ws("|", F.coalesce(province, F.lit("None")), decade, F.coalesce(topic, F.lit("None")))


def stratified_split(rows: DataFrame, key: str, by: Column, fraction: float = 0.1, seed: int = 20260501, least: int = 5) -> DataFrame:
    """rows with ``split``: in strata of ``least`` rows or more, the ceil(fraction * n) of lowest hash are dev, at least one.

    A stratum of any size is dealt over tasks (``ranks.numbered``).
    """
    keyed = rows.withColumn("__stratum", by).withColumn("__hash", text.stable_fraction(F.col(key).cast("string"), seed))
    sizes = keyed.groupBy("__stratum").agg(F.count(F.lit(1)).alias("__size")).withColumnRenamed("__stratum", "__s")
    keyed = keyed.join(sizes, F.col("__stratum").eqNullSafe(F.col("__s"))).drop("__s")
    ranked = ranks.numbered(keyed, [F.col("__hash"), F.col(key)], ["__stratum"], "__rank")
    dev = (F.col("__size") >= least) & (F.col("__rank") <= F.greatest(F.lit(1), F.ceil(F.lit(float(fraction)) * F.col("__size"))))
    return ranked.withColumn("split", F.when(dev, "dev").otherwise("train")).drop("__stratum", "__hash", "__size", "__rank")


def snr_bucket(snr: Column, config: GateConfig = GateConfig()) -> Column:
    """Number of the half-open bucket; whatever fits none (NaN and infinities too) is in the last."""
    out = F.lit(len(config.buckets) - 1)
    for k, (low, high, _) in reversed(list(enumerate(config.buckets))):
        out = F.when(~F.isnan(snr) & (snr >= low) & (snr < high), k).otherwise(out)
    return F.coalesce(out, F.lit(len(config.buckets) - 1))


def length_z(words: Column, duration_s: Column, mean: Column, std: Column) -> Column:
    """Standard score of words a second; 0 without a duration or a spread."""
    return F.when((duration_s <= 0) | (std <= 0), 0.0).otherwise((words / duration_s - mean) / std)


def gate(rows: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """rows with agreement, bucket, z and keep.

    Needs first_words, second_words, logprob, snr_db, duration_s, mean_wps, std_wps. Comparisons with NaN are false.
    """
    out = rows.withColumn("agreement", align.agreement(F.col("first_words"), F.col("second_words")))
    out = out.withColumn("bucket", snr_bucket(F.col("snr_db"), config))
    out = out.withColumn("z", length_z(F.size("first_words"), F.col("duration_s"), F.col("mean_wps"), F.col("std_wps")))
    least = F.get(F.array(*(F.lit(b[2]) for b in config.buckets)), F.col("bucket"))
    sure = ~F.isnan("logprob") & (F.col("logprob") > least)
    usual = F.coalesce(~F.isnan("z") & (F.abs("z") < config.max_z), F.lit(False))
    return out.withColumn("keep", F.coalesce((F.col("agreement") >= config.agreement) & sure & usual, F.lit(False)))


def pseudo_labels(hypotheses: DataFrame, chunks: DataFrame, config: GateConfig = GateConfig()) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one summary row): hypotheses joined with their chunk's ratio, gated against the whole table's pace.

    hypotheses: chunk_id, record_id, audio_path, start_s, end_s, first_words, second_words, logprob. The mean and spread of
    words a second are one aggregate row, joined by a broadcast of that row.
    """
    rows = hypotheses.join(chunks.select("chunk_id", "wada_snr_db"), "chunk_id", "left")
    rows = rows.withColumn("snr_db", F.coalesce("wada_snr_db", F.lit(float("nan")))).withColumn("duration_s", F.col("end_s") - F.col("start_s"))
    pace = F.size("first_words") / F.greatest("duration_s", F.lit(0.1))
    stats = rows.agg(F.avg(pace).alias("mean_wps"), F.stddev_samp(pace).alias("__s")).select("mean_wps", F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s")).alias("std_wps"))
    rows = rows.select("*", stats.select("mean_wps").scalar().alias("mean_wps"), stats.select("std_wps").scalar().alias("std_wps"))
    gated = gate(rows, config)
    kept = gated.filter("keep").select(
        "chunk_id", "record_id", "audio_path", "start_s", "end_s", F.array_join("first_words", " ").alias("transcript"), "snr_db", "agreement"
    )
    summary = gated.agg(
        F.count(F.lit(1)).alias("n_input"), F.count_if("keep").alias("n_kept"), F.sum(F.when(F.col("keep"), F.col("duration_s")).otherwise(0.0)).alias("yield_seconds"),
        F.first("mean_wps").alias("mean_wps"), F.first("std_wps").alias("std_wps"),
    )
    return kept, summary


def era_bucket(year: Column) -> Column:
    """Recording era by year; NaN counts as null."""
    y = F.when(~F.isnan(year.cast("double")), year.cast("int"))
    # fixed values: eras by their first year after
    names = ((1995, "cassette-1990s-early"), (2002, "cassette-1990s-late"), (2010, "MD-2000s"), (2018, "digital-2010s"))
    out = F.lit("digital-2020s")
    for limit, name in reversed(names):
        out = F.when(y < limit, name).otherwise(out)
    return F.when(y.isNull(), "unknown").otherwise(out)


def flag_chunk(label: Column, coverage: Column, snr: Column, snr_p25: Column, era: Column) -> Column:
    """Whether a chunk needs a closer look: no speech, thinly covered, noisy, or of the earliest era."""
    noisy = ~F.isnan(snr) & ~F.isnan(snr_p25) & (snr < snr_p25)
    return (label != "speech") | (coverage < 0.70) | noisy | era.startswith("cassette-1990s-early")


def allowed_tags(tags: Column, scores: Column, allowed: tuple[str, ...], threshold: float = 0.30) -> Column:
    """Pairs (tag in lower case, score) of at least the threshold among the allowed tags."""
    pairs = F.filter(F.arrays_zip(tags.alias("tag"), scores.alias("score")), lambda p: (p["score"] >= threshold) & F.lower(p["tag"]).isin(*allowed))
    return F.transform(pairs, lambda p: F.struct(F.lower(p["tag"]).alias("tag"), p["score"].alias("score")))


def resolve_language(detected: Column, confidence: Column, config: LanguageConfig = LanguageConfig()) -> Column:
    """struct(language, reason): the detected one if sure and allowed, else the primary; sureness is asked first."""
    unsure = (F.coalesce(detected, F.lit("")) == "") | F.coalesce(confidence < config.threshold, F.lit(True))
    pick = lambda language, reason: F.struct(language.alias("language"), F.lit(reason).alias("reason"))
    return (
        F.when(unsure, pick(F.lit(config.primary), "primary_low_confidence"))
        .when(~detected.isin(*config.allowed), pick(F.lit(config.primary), "primary_disallowed"))
        .otherwise(pick(detected, "detected"))
    )


def guard_sources(rows: DataFrame, banned: tuple[str, ...] = BENCH_SOURCES, source: str = "source") -> DataFrame:
    """rows unchanged; ValueError with the count and the tags if any row comes from a banned source."""
    if source not in rows.columns:
        return rows
    found = rows.filter(F.col(source).isin(*banned)).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(source)).alias("tags")).first()
    if found["n"]:
        raise ValueError(f"{found['n']} rows come from evaluation sources: {', '.join(found['tags'])}")
    return rows


def quota(rows: DataFrame, by: Column, order: Column, listed: tuple[str, ...], each: int, other: str = "other", other_cap: int | None = None) -> DataFrame:
    """The first ``each`` rows of every listed value; all other values (and null) share one group, of which the first
    ``other_cap`` rows stay (default: as many as of a listed value)."""
    grouped = rows.withColumn("quota_group", F.when(by.isin(*listed), by).otherwise(other))
    place = F.row_number().over(Window.partitionBy("quota_group").orderBy(order))
    rest = each if other_cap is None else other_cap
    most = F.when(F.col("quota_group") == other, rest).otherwise(each)
    # the plain limit is one that each task can apply before rows are shuffled
    return grouped.withColumn("__place", place).filter(F.col("__place") <= max(each, rest)).filter(F.col("__place") <= most).drop("__place")


def min_count(rows: DataFrame, by: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    groups = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(by)
    return rows.join(groups, by, "left_semi")


def stride_sample(rows: DataFrame, order: Column, most: int = 200) -> DataFrame:
    """Every k-th row, k = max(1, n // most), at most ``most`` rows."""
    placed = ranks.numbered(rows, [order], out="__i")
    step = max(1, placed.count() // most)
    return placed.filter((F.col("__i") - 1) % step == 0).orderBy("__i").limit(most).drop("__i")


def id_differences(have: DataFrame, want: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, kind): ids that are missing from ``have`` or that it has beyond ``want``."""
    a, b = have.select(key).distinct(), want.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("kind", F.lit("missing")).unionByName(a.join(b, key, "left_anti").withColumn("kind", F.lit("extra")))


def of_kind(rows: DataFrame, kind: str | None = None, split: str | None = None) -> DataFrame:
    """Rows of a manifest of one kind, one split, or both."""
    for column, value in (("kind", kind), ("split", split)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def allow_records(rows: DataFrame, record_ids: list[str] | None, key: str = "record_id") -> DataFrame:
    """Rows of the given records; none given: all rows."""
    return rows.filter(F.col(key).isin(*record_ids)) if record_ids else rows


def with_manifest(results: DataFrame, manifest: DataFrame, columns: list[str], key: str = "segment_id") -> DataFrame:
    """results with columns of the manifest; nulls where it doesn't have the row."""
    return results.join(manifest.select(key, *columns), key, "left")


def with_metadata(rows: DataFrame, metadata: DataFrame, columns: list[str], key: str = "record_id", default: str = "?") -> DataFrame:
    """rows with text columns of the metadata; the default where a record or a value is missing."""
    joined = rows.join(metadata.select(key, *columns), key, "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c) for c in columns))


def top_tags(tags: Column, scores: Column, most: int = 50) -> Column:
    """The pairs (tag, score) of highest score, highest first (ties: the earlier one)."""
    pairs = F.transform(F.arrays_zip(tags.alias("tag"), scores.alias("score")), lambda p, i: F.struct((-p["score"]).alias("by"), i.alias("at"), p["tag"].alias("tag"), p["score"].alias("score")))
    return F.transform(F.slice(F.array_sort(pairs), 1, most), lambda p: F.struct(p["tag"].alias("tag"), p["score"].alias("score")))


def bench_rows(rows: DataFrame, source: str, **renamed: str) -> DataFrame:
    """Evaluation rows: columns renamed (new=old), the source's tag and the split ``bench`` added."""
    picked = [F.col(old).alias(new) for new, old in renamed.items()]
    return rows.select(*picked, F.lit(source).alias("source"), F.lit("bench").alias("split"))
