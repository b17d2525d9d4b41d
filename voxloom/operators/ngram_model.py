"""Back-off language models of words, of any order: modified Kneser-Ney estimates as tables, ARPA files, and scores by joins.

Counts: a string of the highest order counts as often as it occurs; a shorter one by how many words come before it, or, where
it begins a text and nothing can, as often as it does. Each order has three discounts (for counts of 1, 2 and more), found from
how many strings have counts of 1 to 4; where these don't allow it, fixed ones stand in. What discounts take from a context goes
to the next shorter one, and from the empty context to all words alike, the unknown word among them.

A model is a table (n, gram, logp, backoff): a string of n words, log10 of its last word's probability after the others, and
log10 of what the string as a context leaves to the next order (null where nothing follows it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import text
from voxloom.sources.shared import materialize

#: Fixed values of the file format: marks of beginning, end and unknown words, the log-probability of what is never said.
BEGIN, END, UNKNOWN, NEVER = "<s>", "</s>", "<unk>", -99.0
#: Discounts for counts of 1, 2 and more where counts of counts don't give any.
FALLBACK = (0.5, 1.0, 1.5)
DIGITS = 8


def marked(words: Column) -> Column:
    return F.concat(F.array(F.lit(BEGIN)), words, F.array(F.lit(END)))


def context_of(gram: Column, n: int) -> Column:
    return F.substring_index(gram, " ", n - 1)


def suffix_of(gram: Column, n: int) -> Column:
    return F.substring_index(gram, " ", 1 - n)


def adjusted_counts(texts: DataFrame, order: int, text_col: str = "text") -> list[DataFrame]:
    """Tables (gram, c) for orders 1 to ``order``, from one pass over the texts."""
    rows = texts.filter(F.col(text_col).isNotNull()).select(marked(text.tokens(F.col(text_col))).alias("w"))
    gram = lambda n, words: F.struct(F.lit(n).alias("n"), F.array_join(words, " ").alias("gram"))
    none = F.array().cast("array<struct<n:int,gram:string>>")
    whole = F.when(F.size("w") >= order, F.transform(F.sequence(F.lit(1), F.size("w") - order + 1), lambda i: gram(order, F.slice("w", i, F.lit(order))))).otherwise(none)
    opening = [F.when(F.size("w") >= n, F.array(gram(n, F.slice("w", 1, n)))).otherwise(none) for n in range(2, order)]
    found = rows.select(F.explode(F.concat(whole, *opening)).alias("g")).groupBy("g.n", "g.gram").agg(F.count(F.lit(1)).alias("c"))
    found = materialize(found, "ngrams")
    tables = [found.filter(F.col("n") == order).select("gram", "c")]
    for n in range(order - 1, 0, -1):
        counted = tables[0].groupBy(suffix_of(F.col("gram"), n + 1).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        tables.insert(0, materialize(counted.unionByName(found.filter(F.col("n") == n).select("gram", "c")), f"counts-{n}"))
    return tables


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """For counts of 1, 2 and at least 3, from the numbers of strings of counts 1 to 4."""
    n = table.agg(*(F.count_if(F.col("c") == k) for k in range(1, 5))).first()
    if not all(n):
        return FALLBACK
    share = n[0] / (n[0] + 2 * n[1])
    found = tuple(k - (k + 1) * share * n[k] / n[k - 1] for k in (1, 2, 3))
    return found if all(0 <= d <= k for k, d in enumerate(found, 1)) else FALLBACK


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def train(texts: DataFrame, order: int = 5, text_col: str = "text") -> DataFrame:
    """(n, gram, logp, backoff) of a model of the texts (null ones are left out)."""
    tables = adjusted_counts(texts, order, text_col)
    cuts = [discounts(t) for t in tables]
    contexts = [
        t.groupBy(context_of(F.col("gram"), n).alias("context")).agg(F.sum("c").alias("total"), F.sum(_discount(F.col("c"), cuts[n - 1])).alias("left")) for n, t in enumerate(tables, 1)
    ]
    base = contexts[0].first() or (None, 1, 0.0)
    words = tables[0].count() + 1
    rest = base[2] / base[1] / words if words > 1 else 1.0
    p = tables[0].select("gram", ((F.col("c") - _discount(F.col("c"), cuts[0])) / base[1] + rest).alias("p"))
    spark = texts.sparkSession
    p = p.unionByName(spark.createDataFrame([(UNKNOWN, rest), (BEGIN, 0.0)], "gram string, p double"))
    parts = []
    for n in range(1, order + 1):
        if n > 1:
            shorter = p.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
            rows = tables[n - 1].select("gram", "c", context_of(F.col("gram"), n).alias("context"), suffix_of(F.col("gram"), n).alias("suffix"))
            own = (F.col("c") - _discount(F.col("c"), cuts[n - 1])) / F.col("total")
            p = rows.join(contexts[n - 1], "context").join(shorter, "suffix").select("gram", (own + F.col("left") / F.col("total") * F.col("q")).alias("p"))
        p = materialize(p, f"model-{n}")
        if n < order:
            leaves = contexts[n].select(F.col("context").alias("gram"), F.log10(F.col("left") / F.col("total")).alias("backoff"))
            part = p.join(leaves, "gram", "left")
        else:
            part = p.withColumn("backoff", F.lit(None).cast("double"))
        logp = F.when(F.col("p") > 0, F.log10("p")).otherwise(NEVER)
        parts.append(part.select(F.lit(n).alias("n"), "gram", logp.alias("logp"), "backoff"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return materialize(whole, "model")


# files


def write_arpa(model: DataFrame, path: str) -> None:
    """The model as an ARPA file in parts: their concatenation by name is one, sections and strings in order."""
    spark = model.sparkSession
    sizes = {r["n"]: r["count"] for r in model.groupBy("n").count().collect()}
    order = max(sizes, default=0)
    head = [(0, 0, "", "\\data\\")] + [(0, n, "", f"ngram {n}={sizes[n]}") for n in sorted(sizes)] + [(0, order + 1, "", "")]
    frame = [row for n in sorted(sizes) for row in ((n, 0, "", f"\\{n}-grams:"), (n, 2, "", ""))]
    fixed = spark.createDataFrame([*head, *frame, (order + 1, 0, "", "\\end\\")], "section int, place int, gram string, value string")
    number = lambda c: F.format_string(f"%.{DIGITS}f", F.col(c))
    lines = model.select(
        F.col("n").alias("section"), F.lit(1).alias("place"), "gram", F.concat_ws("\t", number("logp"), "gram", F.when(F.col("backoff").isNotNull(), number("backoff"))).alias("value")
    )
    rows = fixed.unionByName(lines)
    rows.repartitionByRange("section", "place", "gram").sortWithinPartitions("section", "place", "gram").select("value").write.text(path)


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """(n, gram, logp, backoff) of an ARPA file, whole or in parts; lines that are no entries are passed over."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(parts) >= 2).select(F.trim(F.get(parts, F.lit(1))).alias("gram"), F.get(parts, F.lit(0)).try_cast("double").alias("logp"), F.get(parts, F.lit(2)).try_cast("double").alias("backoff"))
    return rows.filter("logp is not null").select(F.size(F.split("gram", " ")).alias("n"), "gram", "logp", "backoff")


# scores


def score(model: DataFrame, texts: DataFrame, key: str, text_col: str = "text", order: int | None = None) -> DataFrame:
    """(key, lm, unknown): log10 of each text's probability, its end included, and its number of unknown words; null texts have none.

    A word's weight depends on the words before it up to the order, so each such window is looked up once, however often it
    occurs: its strings (a row each) meet the model in one join. The longest string that is known counts, and what the
    longer contexts leave.
    """
    order = order or model.agg(F.max("n")).first()[0] or 1
    rows = texts.filter(F.col(text_col).isNotNull()).select(F.col(key).alias("key"), marked(text.tokens(F.col(text_col))).alias("w"))
    ends = F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.slice("w", F.greatest(i - order + 1, F.lit(1)), F.least(i, F.lit(order))))
    seen = rows.select("key", F.explode(ends).alias("window")).groupBy("key", "window").agg(F.count(F.lit(1)).alias("times"))
    seen = materialize(seen, "windows")
    size = F.size("window")
    strings = F.transform(F.sequence(F.lit(1), size), lambda n: F.struct(n.alias("n"), F.lit(False).alias("before"), F.array_join(F.slice("window", size - n + 1, n), " ").alias("gram")))
    befores = F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda n: F.struct(n.alias("n"), F.lit(True).alias("before"), F.array_join(F.slice("window", size - n, n), " ").alias("gram")))).otherwise(
        F.array().cast("array<struct<n:int,before:boolean,gram:string>>")
    )
    asked = seen.select("window").distinct().select("window", F.explode(F.concat(strings, befores)).alias("s")).select("window", "s.*")
    found = asked.join(model.select("gram", "logp", "backoff"), "gram")
    own = ~F.col("before")
    per = found.groupBy("window").agg(
        F.max(F.when(own, F.struct("n", "logp"))).alias("best"),
        F.collect_list(F.when(F.col("before") & F.col("backoff").isNotNull(), F.struct("n", "backoff"))).alias("left"),
    )
    lost = model.filter(F.col("gram") == UNKNOWN).select(F.max("logp")).scalar()
    n = F.coalesce("best.n", F.lit(1))
    left = F.aggregate(F.filter(F.coalesce("left", F.array().cast("array<struct<n:int,backoff:double>>")), lambda x: x["n"] >= n), F.lit(0.0), lambda a, x: a + x["backoff"])
    weighed = seen.select("window").distinct().join(per, "window", "left").select("window", (F.coalesce("best.logp", lost) + left).alias("lp"), F.col("best").isNull().cast("int").alias("lost"))
    return seen.join(weighed, "window").groupBy("key").agg(F.sum(F.col("lp") * F.col("times")).alias("lm"), F.sum(F.col("lost") * F.col("times")).alias("unknown")).withColumnRenamed("key", key)
