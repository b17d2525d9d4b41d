"""Document quality rules with cross-document line frequency. DataFrame functions only.

Base rules look at one text: too few words, or too many words inside repeated three-word windows. The
cross-document rule finds boilerplate: every line is normalised and hashed, whatever its length, and the distinct documents
that hold it are counted per host (exact copies of a text count once). A line is above its limit when over
``max_docs`` documents of the host hold it, or over ``max_share`` of them (and at least ``min_docs``). Such lines are
removed (``clean_text``); a document that keeps less than ``min_kept`` of its words is depleted and rejected.

Texts are read twice: once for a table of line hashes, from which all counts come, and once to be judged.

Edge cases: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows
get equal results; an empty table gives an empty result; further columns are passed on, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import free_name, materialize, maybe_broadcast

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_share: float = 0.1
    min_docs: int = 5
    max_docs: int = 5000
    min_kept: float = 0.5
    #: A frequent line takes under 100 bytes in a broadcast, a text's frequent lines take some more.
    broadcast_lines: int = 200_000
    broadcast_texts: int = 50_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _with_repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words inside windows of three words that the text holds twice or more, the first included.

    The upper bits of a window's hash and its position are packed in one long, so that a sort of primitive longs brings
    equal windows together; neighbours are then compared by the hashes of all three words. The sort stands outside of
    any lambda: only there it is compiled.
    """
    n = F.size(words) - 2
    right = lambda x, by: F.call_function("shiftrightunsigned", x, by)
    df = df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("__b", F.coalesce(F.ceil(F.log2(F.size(words) + F.lit(2))).cast("int"), F.lit(31)))
    packed = _let(
        F.struct(F.col("__h").alias("h"), F.col("__b").alias("b")),
        lambda v: F.transform(
            F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
            lambda i: F.coalesce(
                F.call_function("shiftleft", right(F.xxhash64(F.get(v["h"], i), F.get(v["h"], i + 1), F.get(v["h"], i + 2)), v["b"] + 1), v["b"])
                .bitwiseOR(i.cast("long")),
                F.lit(0).cast("long"),
            ),
        ),
    )
    df = df.withColumn("__p", F.sort_array(packed))

    def covered(v: Column) -> Column:
        h, p, b = v["h"], v["p"], v["b"]
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
        place = lambda i: F.get(p, i).bitwiseAND(mask).cast("int")
        near = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: right(F.get(p, i).bitwiseXOR(F.get(p, i + 1)), b) == 0)
        same = lambda i, k: F.get(h, place(i) + k) == F.get(h, place(i + 1) + k)
        twins = F.filter(near, lambda i: same(i, 0) & same(i, 1) & same(i, 2))
        starts = F.sort_array(F.array_distinct(F.flatten(F.transform(twins, lambda i: F.array(place(i), place(i + 1))))))
        each = lambda s: F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1), x + 3) - x))
        return _let(starts, lambda s: F.aggregate(each(s), F.lit(0), lambda a, x: a + x))

    found = _let(F.struct(F.col("__h").alias("h"), F.col("__p").alias("p"), F.col("__b").alias("b")), covered)
    return df.withColumn(out, F.when(n < 1, F.lit(0)).otherwise(found).cast("long")).drop("__h", "__b", "__p")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def with_base_measures(df: DataFrame, text: str, config: QualityConfig) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    df = _with_repeat_words(df.withColumn("__words", words_of(F.col(text))), "__words", "__repeat")
    df = df.select(
        "*",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
    ).drop("__words", "__repeat")
    failed = (F.col("n_words") < config.min_words) | (100 * F.col("n_repeat_words") > config.max_repeat_percent * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def normalized_line(line: Column) -> Column:
    """Lower-cased, white space collapsed, digits made equal."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")), r"[0-9]+", "0")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose normalised form has one of the hashes."""
    gone = lambda x: (normalized_line(x) != "") & F.array_contains(hashes, F.xxhash64(normalized_line(x)))
    return F.array_join(F.filter(lines_of(text), lambda x: ~gone(x)), "\n")


def document_lines(df: DataFrame, text: str, host: str) -> DataFrame:
    """(content, host, pos, line, words): a row for each line of each text (line is null where it has no word), with the words it has."""
    content = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    each = df.select(content.alias("content"), F.col(host).cast("string").alias("host"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    each = each.withColumn("line", normalized_line(F.col("line")))
    some = F.col("line") != ""
    # of the lines without a word only the first is kept, which stands for its text
    each = each.filter(some | (F.col("pos") == 0))
    return each.select("content", "host", "pos", F.when(some, F.xxhash64("line")).alias("line"), F.size(F.split("line", " ")).alias("words"))


def frequent_lines(lines: DataFrame, config: QualityConfig) -> DataFrame:
    """(f_host, f_line): lines that too many distinct documents of the host hold."""
    host_docs = lines.filter("pos = 0").select("host", "content").distinct().groupBy(F.col("host").alias("h_host")).agg(F.count(F.lit(1)).alias("docs"))
    held = lines.filter("line IS NOT NULL").select("host", "line", "content").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    held = held.filter(F.col("n") >= config.min_docs)
    limit = F.least(F.lit(float(config.max_docs)), config.max_share * F.col("docs"))
    return held.join(host_docs, F.col("host").eqNullSafe(F.col("h_host"))).filter(F.col("n") > limit).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))


def removed_lines(lines: DataFrame, config: QualityConfig) -> DataFrame:
    """(r_content, r_host, removed_words, r_lines): the frequent lines of each text that has some, and the words in all of their occurrences."""
    found = materialize(frequent_lines(lines, config), "frequent-lines")
    found = maybe_broadcast(found, found.count(), config.broadcast_lines)
    held = lines.join(found, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")), "left")
    # rows of one text and host count its lines as often as there are rows
    texts = held.groupBy(F.col("content").alias("r_content"), F.col("host").alias("r_host")).agg(
        F.count_if(F.col("pos") == 0).alias("rows"),
        F.sum(F.when(F.col("f_line").isNotNull(), F.col("words"))).alias("words"),
        F.collect_set("f_line").alias("r_lines"),
    )
    some = texts.filter(F.size("r_lines") > 0)
    return materialize(some.select("r_content", "r_host", (F.col("words") / F.col("rows")).cast("long").alias("removed_words"), "r_lines"), "removed-lines")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def judge(df: DataFrame, text: str = "text", host: str = "source", config: QualityConfig = QualityConfig()) -> tuple[DataFrame, dict[str, str]]:
    """(rows, names): df with the base measures, base_failed, removed_words (of frequent lines), kept, and clean_text, the text
    without those lines. names gives what these are called in rows: names that df doesn't have."""
    names = {c: c if c not in {x.lower() for x in df.columns} else free_name(df, c) for c in (*MEASURES, "removed_words", "kept", "clean_text")}
    inner = [f"c{k}" for k in range(len(df.columns))]
    rows = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(df.columns, inner, strict=True)), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{host}`").cast("string").alias("h"))
    lines = materialize(document_lines(rows, "t", "h"), "document-lines")
    removed = removed_lines(lines, config)
    removed = maybe_broadcast(removed, removed.count(), config.broadcast_texts)
    out = (
        with_base_measures(rows, "t", config)
        .withColumn("content", F.xxhash64(F.coalesce(F.col("t"), F.lit(""))))
        .join(removed, (F.col("content") == F.col("r_content")) & F.col("h").eqNullSafe(F.col("r_host")), "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("clean_text", F.when(F.col("r_lines").isNull(), F.col("t")).otherwise(without_lines(F.col("t"), F.col("r_lines"))))
    )
    depleted = (F.col("removed_words") > 0) & (F.col("n_words") - F.col("removed_words") < config.min_kept * F.col("n_words"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~depleted)
    return out.select(*(F.col(k).alias(c) for c, k in zip(df.columns, inner, strict=True)), *(F.col(c).alias(n) for c, n in names.items())), names


def cleaned(docs: DataFrame, text: str = "text", host: str = "source", config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of docs that are kept, their texts without frequent lines."""
    rows, names = judge(docs, text, host, config)
    rows = rows.filter(F.col(names["kept"]))
    return rows.select(*((F.col(names["clean_text"]) if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns))
