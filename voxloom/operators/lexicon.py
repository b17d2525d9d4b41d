"""Term lexicons and corpus profiles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import text
from voxloom.sources.shared import materialize


def appearance(docs: DataFrame, order: str, doc: Column, pos: Column) -> Column:
    """A value that comes in the order of (doc, pos), null documents first.

    Of whole numbers it is one number: the least of a pair can't be held in a hash table, so that all words would be sorted.
    """
    if not isinstance(docs.schema[order].dataType, T.IntegralType):
        return F.struct(doc, pos)
    number = F.coalesce(doc.cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)).cast("decimal(20,0)"))
    return number * F.lit(Decimal(2**31)).cast("decimal(10,0)") + pos


def bucket(name: str) -> Column:
    return F.coalesce(F.when(F.col(name).cast("string") != "", F.col(name).cast("string")), F.lit("_")).alias(name)


def word_counts(docs: DataFrame, by: list[str], text_col: str = "text", order: str = "doc_id") -> DataFrame:
    """(by.., word, tf, df, first): occurrences, documents and first appearance of each word in each bucket, written once."""
    base = docs.select(*map(bucket, by), F.col(order).alias("__doc"), text.word_tokens(F.col(text_col)).alias("__words"))
    # a document's words, and then its distinct ones again: all counts come from one reading and one exchange
    listed = F.posexplode(F.concat("__words", F.array_distinct("__words"))).alias("__pos", "word")
    rows = base.select(*by, "__doc", F.size("__words").alias("__n"), listed)
    said, held = F.col("__pos") < F.col("__n"), F.col("__pos") >= F.col("__n")
    found = rows.groupBy(*by, "word").agg(
        F.count(F.when(said, 1)).alias("tf"), F.count(F.when(held, 1)).alias("df"), F.min(F.when(said, appearance(docs, order, F.col("__doc"), F.col("__pos")))).alias("first")
    )
    return materialize(found, "word-counts")


def build_lexicon(docs: DataFrame, by: list[str], text_col: str = "text", order: str = "doc_id", top_n: int = 64, min_doc_freq: int = 2, counts: DataFrame | None = None) -> DataFrame:
    """(by.., rank, word, score): the words of highest tf-idf in each bucket (null keys are ``_``; ties: first appearance).

    tf is occurrences by the bucket's documents; idf is ln((1 + documents) / (1 + occurrences in the corpus)), so it can be
    negative. A word needs min_doc_freq documents of its bucket. counts: the buckets' word_counts, if they are there already.
    """
    per = word_counts(docs, by, text_col, order) if counts is None else counts
    totals = per.groupBy("word").agg(F.sum("tf").alias("everywhere"))
    n_docs = docs.groupBy(*map(bucket, by)).agg(F.count(F.lit(1)).alias("docs"))
    n_all = docs.agg(F.count(F.lit(1)).alias("n"))
    scored = per.join(totals, "word").join(n_docs, by).withColumn("__all", n_all.scalar())
    score = F.col("tf") / F.greatest(F.lit(1), F.col("docs")) * F.ln((1 + F.col("__all")) / (1 + F.col("everywhere")))
    scored = scored.filter(F.col("df") >= min_doc_freq).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "first", "word"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top_n).select(*by, "rank", "word", "score")


def _said(docs: DataFrame, text_col: str, order: str) -> DataFrame:
    """(word, n, f): occurrences and first appearance of each word."""
    rows = docs.select(F.col(order).alias("__doc"), F.posexplode(text.word_tokens(F.col(text_col))).alias("__pos", "word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(appearance(docs, order, F.col("__doc"), F.col("__pos"))).alias("f"))


def universal_words(docs: DataFrame, text_col: str = "text", order: str = "doc_id", least: int = 50, top_n: int = 32, counts: DataFrame | None = None) -> DataFrame:
    """(rank, word, n): the most frequent words of the corpus with at least ``least`` occurrences (ties: first appearance).

    counts: word_counts of any buckets, if they are there already.
    """
    each = _said(docs, text_col, order) if counts is None else counts.groupBy("word").agg(F.sum("tf").alias("n"), F.min("first").alias("f"))
    top = each.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "f").limit(top_n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "f"))).select("rank", "word", "n")


def words_for(lexicon: DataFrame, universal: DataFrame, province: str | None, topic: str | None) -> DataFrame:
    """(word, place): universal words, then those of the bucket or, without a topic, of all buckets of the province."""
    first = universal.select("word", F.lit(0).alias("a"), F.col("rank").cast("int").alias("b"), F.lit("").alias("t"))
    if province is None:
        found = first
    else:
        some = lexicon.filter(F.col("province") == province)
        if topic is not None:
            some = some.filter(F.col("topic") == topic)
        found = first.unionByName(some.select("word", F.lit(1).alias("a"), F.col("rank").cast("int").alias("b"), F.col("topic").alias("t")))
    placed = found.groupBy("word").agg(F.min(F.struct("a", "t", "b")).alias("p"))
    return placed.select("word", (F.row_number().over(Window.orderBy("p", "word")) - 1).alias("place"))


def markup_counts(docs: DataFrame, text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """(by.., markup, n): matches of each markup pattern."""
    sums = [F.sum(F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(p))).alias(f"m{k}") for k, p in enumerate(text.MARKUP.values())]
    wide = docs.groupBy(*(by or [])).agg(*sums)
    pairs = F.array(*(F.struct(F.lit(name).alias("markup"), F.col(f"m{k}").alias("n")) for k, name in enumerate(text.MARKUP)))
    return wide.select(*(by or []), F.explode(pairs).alias("x")).select(*(by or []), "x.markup", "x.n")


def substring_counts(docs: DataFrame, hints: list[str], text_col: str = "text") -> DataFrame:
    """(hint, n): non-overlapping occurrences of lower-cased substrings in the texts."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    wide = docs.agg(*(F.sum(F.regexp_count(low, F.lit(rf"\Q{h.lower()}\E"))).alias(f"h{k}") for k, h in enumerate(hints)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(h).alias("hint"), F.col(f"h{k}").alias("n")) for k, h in enumerate(hints)))).alias("x")).select("x.*")


def most_common(docs: DataFrame, text_col: str = "text", order: str = "doc_id", top_n: int = 25) -> DataFrame:
    """(word, n): the most frequent words (ties: first appearance)."""
    return _said(docs, text_col, order).orderBy(F.col("n").desc(), "f").limit(top_n).select("word", "n")


def describe(rows: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """(by.., n, mean, median, low, high)."""
    return rows.groupBy(*(by or [])).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def char_vocab(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(char, id): [PAD] 0, [UNK] 1, the word delimiter | 2, then the lower-cased characters without blanks in order."""
    spark = docs.sparkSession
    chars = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), ""))).alias("char")).distinct().filter(~F.col("char").rlike(r"(?U)^\s*$") & (F.col("char") != "|"))
    ids = chars.withColumn("id", (F.row_number().over(Window.orderBy(F.encode("char", "UTF-8"))) + 2).cast("int"))
    return spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("|", 2)], "char string, id int").unionByName(ids)
