"""Line dedup: a long line that many documents hold stays in one of them only. DataFrame functions only.

Texts are split at line feeds. A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines, except in the largest id
that holds the key. What stays keeps its order and its form.

How: every long line becomes a row (its text's key, its position, two hashes of its key: 128 bits). Documents are
counted by hash, with the usual two steps of a distinct count, so that a line of a third of all documents is combined
before it is shuffled. Lines above the limit give each text the positions it loses, and a text is put together again from
the other positions. Lines travel as hashes; texts are shuffled once at most, and not at all while what is to be dropped
is small enough to be broadcast (counted first).

Edge cases: a null or empty text is one empty line; documents are told apart by id, so rows that repeat an id count once
and lose or keep their lines alike; a null id is one document, smaller than all others; ids of any type that can be
ordered; an empty table gives an empty result; further columns are passed on, whatever their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from voxloom.llm.common import free_name, materialize, maybe_broadcast

SPACE_CHARS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineConfig:
    min_chars: int = 40
    min_docs: int = 5
    #: A frequent line takes under 100 bytes in a broadcast; of dropped positions the bytes are counted.
    broadcast_lines: int = 300_000
    broadcast_bytes: int = 16 << 20


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped of white space, A-Z lower-cased; other letters stay as they are."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), string.ascii_uppercase, string.ascii_lowercase)


def _hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def long_lines(rows: DataFrame, config: LineConfig) -> DataFrame:
    """(id, t0, t1, pos, h0, h1): a row for each long line of (id, text, t0, t1)."""
    each = rows.select("id", "t0", "t1", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    each = each.filter(F.length(F.btrim("line", F.lit(SPACE_CHARS))) >= config.min_chars)
    h0, h1 = _hashes(line_key(F.col("line")))
    return each.select("id", "t0", "t1", "pos", h0.alias("h0"), h1.alias("h1"))


def repeated_lines(lines: DataFrame, config: LineConfig) -> DataFrame:
    """(h0, h1, last): the keys that enough documents hold, with the largest id among them."""
    docs = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    return lines.groupBy("h0", "h1").agg(docs.alias("docs"), F.max("id").alias("last")).filter(F.col("docs") >= config.min_docs).drop("docs")


def _dropped(lines: DataFrame, config: LineConfig) -> DataFrame:
    """(id, t0, t1, gone): the positions that each text loses."""
    found = materialize(repeated_lines(lines, config), "repeated-lines")
    if isinstance(lines.schema["id"].dataType, NumericType):
        found = maybe_broadcast(found, found.count(), config.broadcast_lines)
    gone = lines.join(found, ["h0", "h1"]).filter(~F.col("id").eqNullSafe(F.col("last")))
    return materialize(gone.groupBy("id", "t0", "t1").agg(F.collect_set("pos").alias("gone")), "dropped-lines")


def _without(text: Column, gone: Column) -> Column:
    """The text put together from the positions that are not gone."""
    whole = F.transform(
        F.array(F.struct(lines_of(text).alias("lines"), gone.alias("gone"))),
        lambda v: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(v["lines"]) - 1), v["gone"]), lambda i: F.get(v["lines"], i)), "\n"
        ),
    )
    return F.get(whole, 0)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: LineConfig = LineConfig()) -> tuple[DataFrame, dict[str, str]]:
    """(rows, names): docs with n_lines (before dropping), n_dropped and clean_text; names gives what these are called in rows."""
    names = {c: c if c not in {x.lower() for x in docs.columns} else free_name(docs, c) for c in ("n_lines", "n_dropped", "clean_text")}
    inner = [f"c{k}" for k in range(len(docs.columns))]
    text = F.col(f"`{text_col}`").cast("string")
    t0, t1 = _hashes(F.coalesce(text, F.lit("")))
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, inner, strict=True)), F.col(f"`{id_col}`").alias("id"), text.alias("text"), t0.alias("t0"), t1.alias("t1"))
    gone = _dropped(materialize(long_lines(rows, config), "long-lines"), config)
    texts, places = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    numeric = isinstance(rows.schema["id"].dataType, NumericType)
    held = F.broadcast(gone) if numeric and 100 * texts + 4 * places <= config.broadcast_bytes else gone
    held = held.select(F.col("id").alias("g_id"), F.col("t0").alias("g_t0"), F.col("t1").alias("g_t1"), "gone")
    joined = rows.join(held, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("t0") == F.col("g_t0")) & (F.col("t1") == F.col("g_t1")), "left")
    out = joined.select(
        *(F.col(k).alias(c) for c, k in zip(docs.columns, inner, strict=True)),
        F.size(lines_of(F.col("text"))).cast("long").alias(names["n_lines"]),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(names["n_dropped"]),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone"))).alias(names["clean_text"]),
    )
    return out, names


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: LineConfig = LineConfig()) -> DataFrame:
    """docs with the repeated lines taken out of their texts."""
    rows, names = judge(docs, id_col, text_col, config)
    return rows.select(*((F.col(names["clean_text"]) if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: LineConfig = LineConfig()) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every document."""
    rows, names = judge(docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col)), id_col, text_col, config)
    digest = F.sha2(F.coalesce(F.col(names["clean_text"]), F.lit("")).cast("binary"), 256)
    return rows.select(id_col, F.col(names["n_lines"]).alias("n_lines"), F.col(names["n_dropped"]).alias("n_dropped"), digest.alias("kept_sha256"))
