"""Interpolated Kneser-Ney language models of words, as tables.

With a discount D the highest order takes D off each count and gives it to the next order; lower orders count in how many
contexts a string occurs instead of how often. Unknown words share what order one gives away with the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.sources.shared import materialize

BEGIN, END = "<s>", "</s>"
#: Rows of a table that may be held by the driver and every executor.
BROADCAST_ROWS = 20_000


def _small(df: DataFrame) -> DataFrame:
    """A table that was written, with its join: broadcast by its rows, as its compressed bytes say little of what it takes in memory."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def padded(words: Column) -> Column:
    return F.concat(F.array(F.lit(BEGIN), F.lit(BEGIN)), words, F.array(F.lit(END)))


def trigrams(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(u, v, w) of each word and the end of each text; two marks stand before the first word."""
    rows = texts.select(padded(text.tokens(F.col(text_col))).alias("p"))
    each = F.transform(F.sequence(F.lit(1), F.size("p") - 2), lambda i: F.struct(F.get("p", i - 1).alias("u"), F.get("p", i).alias("v"), F.get("p", i + 1).alias("w")))
    return rows.select(F.explode(each).alias("g")).select("g.*")


class KneserNey:
    """Tables of a trigram model: full counts at order three, continuation counts below. Each is written once and read by all that need it."""

    def __init__(self, texts: DataFrame, text_col: str = "text", discount: float = 0.75):
        self.d = discount
        self.three = materialize(trigrams(texts, text_col).groupBy("u", "v", "w").agg(F.count(F.lit(1)).alias("c3")), "lm-three")
        self.two = materialize(self.three.groupBy("v", "w").agg(F.count(F.lit(1)).alias("c2")), "lm-two")
        self.one = materialize(self.two.groupBy("w").agg(F.count(F.lit(1)).alias("c1")), "lm-one")
        self.context3 = materialize(self.three.groupBy("u", "v").agg(F.sum("c3").alias("n3"), F.count(F.lit(1)).alias("t3")), "lm-context3")
        self.context2 = materialize(self.two.groupBy("v").agg(F.sum("c2").alias("n2"), F.count(F.lit(1)).alias("t2")), "lm-context2")
        self.context1 = self.one.agg(F.sum("c1").alias("n1"), F.count(F.lit(1)).alias("t1"))

    def log10(self, grams: DataFrame) -> DataFrame:
        """grams (with u, v, w) and ``lp``, the log10 of w's probability after u and v."""
        d = F.lit(self.d)
        keys = grams.select("u", "v", "w").distinct()
        rows = keys.join(_small(self.three), ["u", "v", "w"], "left").join(_small(self.context3), ["u", "v"], "left")
        rows = rows.join(_small(self.two), ["v", "w"], "left").join(_small(self.context2), ["v"], "left").join(_small(self.one), ["w"], "left")
        whole = self.context1.first()
        rows = rows.select("*", F.lit(whole["n1"]).cast("long").alias("n1"), F.lit(whole["t1"]).alias("t1"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        p = (F.greatest(zero("c1") - d, F.lit(0.0)) + d * F.col("t1") / (F.col("t1") + 1)) / F.col("n1")
        for k in ("2", "3"):
            inner = (F.greatest(zero(f"c{k}") - d, F.lit(0.0)) + d * F.col(f"t{k}") * p) / F.col(f"n{k}")
            p = F.when(F.col(f"n{k}").isNull(), p).otherwise(inner)
        scored = rows.select("u", "v", "w", F.log10(p).alias("lp"))
        return grams.join(scored.hint("merge"), ["u", "v", "w"])

    def score(self, texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
        """(key, lm): log10 of each text's probability, its end included."""
        rows = texts.select(F.col(key), padded(text.tokens(F.col(text_col))).alias("p"))
        each = F.transform(F.sequence(F.lit(1), F.size("p") - 2), lambda i: F.struct(F.get("p", i - 1).alias("u"), F.get("p", i).alias("v"), F.get("p", i + 1).alias("w")))
        grams = rows.select(key, F.explode(each).alias("g")).select(key, "g.*")
        return self.log10(grams).groupBy(key).agg(F.sum("lp").alias("lm"))

    def arpa(self) -> DataFrame:
        """(n, line) of the model in ARPA form: log10 probability, string, and log10 of what its context gives to the next order."""
        d = F.lit(self.d)
        one = self.log10(self.one.select(F.lit("\0").alias("u"), F.lit("\0").alias("v"), "w"))
        two = self.log10(self.two.select(F.lit("\0").alias("u"), "v", "w"))
        back2 = self.context2.select(F.col("v").alias("w"), F.log10(d * F.col("t2") / F.col("n2")).alias("b"))
        back3 = self.context3.select(F.col("u").alias("v"), F.col("v").alias("w"), F.log10(d * F.col("t3") / F.col("n3")).alias("b"))
        line = lambda p, s, b: F.concat_ws("\t", F.format_string("%.6f", p), s, F.when(b.isNotNull(), F.format_string("%.6f", b)))
        lines = one.join(back2, ["w"], "left").select(F.lit(1).alias("n"), line(F.col("lp"), F.col("w"), F.col("b")).alias("line"))
        lines = lines.unionByName(two.join(back3, ["v", "w"], "left").select(F.lit(2).alias("n"), line(F.col("lp"), F.concat_ws(" ", "v", "w"), F.col("b")).alias("line")))
        three = self.log10(self.three.select("u", "v", "w"))
        return lines.unionByName(three.select(F.lit(3).alias("n"), line(F.col("lp"), F.concat_ws(" ", "u", "v", "w"), F.lit(None).cast("double")).alias("line")))
