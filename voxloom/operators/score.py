"""Corpus error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import align, text


def scored_pairs(pairs: DataFrame, reference: str = "ref", hypothesis: str = "hyp", track: str = "normalized") -> DataFrame:
    """pairs with ``errors`` and ``words`` (reference length) on the raw or the normalized track."""
    prepare = {
        "plain": lambda c: c,
        "raw": text.post_edit_raw,
        "normalized": lambda c: text.normalize_for_eval(text.post_edit_raw(c)),
    }[track]
    rows = pairs.withColumn("__r", text.tokens(prepare(F.col(reference)))).withColumn("__h", text.tokens(prepare(F.col(hypothesis))))
    return rows.withColumn("errors", align.wer_errors(F.col("__r"), F.col("__h"))).withColumn("words", F.size("__r")).drop("__r", "__h")


def rate(errors: str | Column = "errors", words: str | Column = "words") -> Column:
    """Micro average over a group."""
    return F.sum(errors) / F.greatest(F.sum(words), F.lit(1))


def corpus_wer(pairs: DataFrame, by: list[str] | None = None, track: str = "normalized", **names) -> DataFrame:
    """(by.., errors, words, wer); texts without a reference count one error if they have words."""
    rows = scored_pairs(pairs, track=track, **names)
    return rows.groupBy(*(by or [])).agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"), rate().alias("wer"))


def source_wer(pairs: DataFrame, source: str = "source", **names) -> DataFrame:
    """(source, n, raw_errors, raw_words, raw_wer, errors, words, wer) of each source, and of all in a row without one.

    On either track a pair without a reference adds neither errors nor words.
    """
    rows = dual_track(pairs, keep=(source,), **names)
    counted = lambda e, w: F.when(F.col(w) > 0, F.col(e)).otherwise(0)
    rows = rows.select(F.struct(source).alias("__s"), counted("raw_errors", "raw_words").alias("raw_errors"), "raw_words", counted("errors", "words").alias("errors"), "words")
    sums = [F.sum(c).alias(c) for c in ("raw_errors", "raw_words", "errors", "words")]
    both = rows.rollup("__s").agg(F.count(F.lit(1)).alias("n"), *sums, F.grouping("__s").alias("total"))
    per = lambda e, w: F.col(e) / F.greatest(w, F.lit(1))
    # a null source is a source of its own: the total is told by its mark
    return both.select(
        F.col(f"__s.{source}").alias(source), (F.col("total") == 1).alias("total"), "n", "raw_errors", "raw_words", per("raw_errors", "raw_words").alias("raw_wer"),
        "errors", "words", per("errors", "words").alias("wer"),
    )


def micro_wer(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accumulated insertions, deletions and substitutions by reference words; rows with neither side are left out."""
    total = F.col("insertions") + F.col("deletions") + F.col("substitutions")
    rows = counts.filter((F.col("words") > 0) | (total > 0))
    return rows.groupBy(*(by or [])).agg(F.sum(total).alias("errors"), F.sum("words").alias("words"), (F.sum(total) / F.greatest(F.sum("words"), F.lit(1))).alias("wer"))


def dual_track(pairs: DataFrame, reference: str = "ref", hypothesis: str = "hyp", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """A row a pair: the columns ``keep``, raw_errors, raw_words, raw_wer, and errors, words, normalized_wer."""
    raw = [text.tokens(text.post_edit_raw(F.col(c))).alias(f"__raw_{k}") for k, c in enumerate((reference, hypothesis))]
    norm = [text.tokens(text.normalize_for_eval(text.post_edit_raw(F.col(c)))).alias(f"__norm_{k}") for k, c in enumerate((reference, hypothesis))]
    rows = pairs.select(*keep, *raw, *norm).select(
        *keep, align.wer_errors(F.col("__raw_0"), F.col("__raw_1")).alias("raw_errors"), F.size("__raw_0").alias("raw_words"),
        align.wer_errors(F.col("__norm_0"), F.col("__norm_1")).alias("errors"), F.size("__norm_0").alias("words"),
    )
    per = lambda e, w: F.col(e) / F.greatest(w, F.lit(1))
    return rows.select(*keep, "raw_errors", "raw_words", per("raw_errors", "raw_words").alias("raw_wer"), "errors", "words", per("errors", "words").alias("normalized_wer"))


def score_folder(hypotheses: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, total) of two tables of (name, text) files: both tracks of each paired record, and of the corpus (one row)."""
    rows = dual_track(paired_files(hypotheses, references))
    total = rows.agg(rate("raw_errors", "raw_words").alias("raw_wer"), rate().alias("normalized_wer"), F.count(F.lit(1)).alias("records"))
    return rows, total.select(F.coalesce("raw_wer", F.lit(0.0)).alias("raw_wer"), F.coalesce("normalized_wer", F.lit(0.0)).alias("normalized_wer"), "records")


def true_micro_wer(pairs: DataFrame, by: list[str] | None = None, reference: str = "ref", hypothesis: str = "hyp") -> DataFrame:
    """(by.., errors, words, wer) with every inserted word counted, also where a record has no reference (no words: 0)."""
    sides = pairs.select(*(by or []), text.tokens(F.col(reference)).alias("__r"), text.tokens(F.col(hypothesis)).alias("__h"))
    rows = sides.select(*(by or []), align.word_edit_distance(F.col("__r"), F.col("__h")).alias("errors"), F.size("__r").alias("words"))
    sums = rows.groupBy(*(by or [])).agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"))
    return sums.withColumn("wer", F.when(F.col("words") > 0, F.col("errors") / F.col("words")).otherwise(0.0))


def stratified_wer(rows: DataFrame, language: str = "language", accent: str = "accent", accent_language: str = "es") -> DataFrame:
    """Rates by language, and by accent within one language, from (language, accent, raw_errors, errors, words).

    Both rates divide by the normalized length; accents that are null are in their language's row only.
    """
    keyed = rows.select(F.col(language).alias("language"), F.when(F.col(language) == accent_language, F.col(accent)).alias("accent"), "raw_errors", "errors", "words")
    out = keyed.groupingSets([[F.col("language"), F.col("accent")], [F.col("language")]], "language", "accent").agg(
        F.grouping("accent").alias("__all"), F.count(F.lit(1)).alias("n"), rate("raw_errors").alias("raw_wer"), rate().alias("normalized_wer")
    )
    return out.filter((F.col("__all") == 1) | F.col("accent").isNotNull()).drop("__all")


def paired_files(hypotheses: DataFrame, references: DataFrame) -> DataFrame:
    """(record_id, hyp, ref): a reference of the same file name, else of the record's own name; inner.

    Both sides: (name, text); record ids are names without extension and without what follows ``__``.
    """
    record = text.stem_prefix(F.col("name"))
    hyp = hypotheses.select("name", record.alias("record_id"), F.col("text").alias("hyp"))
    ref = references.select(F.col("name").alias("r_name"), F.col("text").alias("r_text"))
    same = hyp.join(ref, F.col("name") == F.col("r_name"), "left").withColumnRenamed("r_text", "same").drop("r_name")
    both = same.join(ref, F.concat("record_id", F.lit(".txt")) == F.col("r_name"), "left")
    return both.select("record_id", "hyp", F.coalesce("same", "r_text").alias("ref")).filter("ref is not null")
