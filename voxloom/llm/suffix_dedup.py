"""Removal of bytes that repeat an earlier 100-byte string, by column-wise construction of the collection's suffix order.

Every string of ``LENGTH`` bytes is anchored at its least gram (``GRAM`` bytes, least by a hash, the leftmost of equals),
which the string alone decides: equal strings have equal anchors at equal distances. The strings that one gram anchors
form a stretch of text, its context, of fewer than 2 * LENGTH bytes.

* Contexts that are equal as a whole (128-bit hashes, beside the gram's 64 bits) are told apart by order alone: all but
  the earliest repeat it entirely.
* The others of a gram that has several contexts may share some strings (the rims of repeated passages). They are
  inserted column by column: the order of their parts from the gram on comes first, then each round puts the next symbol
  to the left in front of every context. The new suffixes' order follows from the old one by the transform's
  last-to-first mapping (a stable count by symbol), and the common prefixes of neighbours are updated with it (the least
  on the way between two suffixes of one symbol, plus one). After round l, neighbours that share LENGTH bytes hold equal
  strings that start l bytes before their gram; all but the earliest are marked.

Of the transform only what the last round put in is kept: suffixes of other rounds start at other distances from their
gram, so they can't begin with an equal string. So a round is one pass over a column, there are ``LENGTH - GRAM`` of them
however long documents are, and a block needs some 300 bytes a context: columns stay in memory, not in external files.

Skew: copies inside one batch of texts are told before anything is shuffled. Grams with a large share of a sample of
documents are dealt by their contexts' hashes too, and a gram's contexts of over ``BLOCK`` are cut into blocks; the
earliest strings of its blocks are then merged by an aggregation. None of this changes the result.

Edge cases: a null or empty text has no bytes; texts under LENGTH bytes keep everything. Rows come in the order of their
ids (nulls last, then ids that aren't whole numbers by their own order); rows that share an id, or have none, are
documents of their own in the order of a hash of their texts. An empty table gives an empty result; further columns are
passed on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType

from voxloom.llm.common import bounded_batches, free_name, materialize, maybe_broadcast

LENGTH = 100
GRAM = 24
#: Bytes of a text that are looked at together; a position inside fits 20 bits.
PIECE = 1 << 19
#: Contexts that are ordered together, and of one gram from which they are cut into blocks.
BLOCK = 16384
#: Grams are counted in one of so many documents; those found so often there, at most so many of them, are dealt by context.
HOT_ONE_IN, HOT_FOUND, HOT_GRAMS, HOT_PARTS = 64, 256, 1024, 1024
FIRST, WHOLE, HOT, PARTLY = 0, 1, 2, 3
#: No byte of UTF-8: fills contexts up.
FILL = b"\xff"
_LOW = np.uint64((1 << 20) - 1)
_MULT = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all strings of GRAM bytes."""
    h = data.astype(np.uint64) * _MULT[0] + np.uint64(0x632BE59BD9B4E019)
    h ^= h >> np.uint64(29)
    h = h[:-1] * _MULT[1] + h[1:]
    h = h[:-2] * _MULT[2] + h[2:]
    h8 = h[:-4] * _MULT[3] + h[4:]
    h = h8[:-8] * _MULT[4] + h8[8:]
    h = h[: len(h) - 8] * _MULT[0] + h8[16:]
    h ^= h >> np.uint64(32)
    h *= _MULT[1]
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of each anchoring gram: the strings of LENGTH bytes that it anchors start at first to last."""
    found = []
    n = len(data)
    for begin in range(0, max(0, n - LENGTH + 1), PIECE):
        h = gram_hashes(data[begin : begin + PIECE + LENGTH - 1])
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, least = 1, key
        grams = LENGTH - GRAM + 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
        place = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        found.append((h[place[first]].view(np.int64), place[first] + begin, first + begin, last + begin))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def column_rounds(contexts: list[bytes], place: np.ndarray) -> np.ndarray:
    """(m, LENGTH - GRAM + 1) booleans: whether the string that starts l bytes before a context's gram is also in an earlier context.

    Contexts come from the earliest to the latest; place is where the gram starts in each. A context holds the strings that
    its gram anchors, no others.
    """
    m, rounds = len(contexts), LENGTH - GRAM
    again = np.zeros((m, rounds + 1), bool)
    if m < 2:
        return again
    length = np.array([len(c) for c in contexts])
    least, most = np.maximum(0, place - (length - LENGTH)), place
    right = np.frombuffer(b"".join(c[p : p + LENGTH].ljust(LENGTH, FILL) for c, p in zip(contexts, place.tolist(), strict=True)), np.uint8).reshape(m, LENGTH)
    left = np.frombuffer(b"".join(c[:p][::-1].ljust(rounds, FILL) for c, p in zip(contexts, place.tolist(), strict=True)), np.uint8).reshape(m, rounds).T.copy()
    order = np.argsort(np.ascontiguousarray(right).view(f"S{LENGTH}")[:, 0], kind="stable")
    unlike = right[order[1:]] != right[order[:-1]]
    common = np.zeros(m + 1, np.int32)  # with the suffix before; the last entry only ends ranges
    common[1:m] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), LENGTH)
    for l in range(rounds + 1):
        linked = np.flatnonzero(common[:m] >= LENGTH)
        if len(linked):
            head = np.concatenate([[True], np.diff(linked) > 1])  # runs of equal strings begin a place before their links
            begins = linked[head] - 1
            sizes = np.diff(np.append(np.flatnonzero(head), len(linked))) + 1
            at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            who = order[at]
            holds = (least[who] <= l) & (l <= most[who])
            earliest = np.minimum.reduceat(np.where(holds, who, m), np.cumsum(sizes) - sizes)
            again[who[holds & (who != np.repeat(earliest, sizes))], l] = True
        if l == rounds:
            break
        symbol = left[l][order]
        by = np.argsort(symbol, kind="stable")
        symbol, order = symbol[by], order[by]
        spans = np.column_stack([by[:-1] + 1, by[1:] + 1]).reshape(-1)
        between = np.minimum.reduceat(common, spans)[::2]
        common[1:m] = np.where(symbol[1:] == symbol[:-1], between + 1, 0)
    return again


def _contexts(text: bytes) -> tuple[np.ndarray, ...]:
    """(gram hash, two words of the context's hash, first, strings less one) of each anchor of a text; hashes as signed integers."""
    gram, _, first, last = anchors(np.frombuffer(text, np.uint8))
    digest = xxhash.xxh3_128_digest
    whole = np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return gram, whole[:, 0], whole[:, 1], first, last - first


def _first_contexts(docs: DataFrame, hot: list[int]) -> DataFrame:
    """(gram, w0, w1, doc, at, n, flag) of (doc, text): contexts, each once a batch; the others are runs of strings flagged as WHOLE.

    gram is what rows are dealt by: of hot grams with a part of the context's hash, of WHOLE rows anything.
    """
    hot_grams = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.binary())
            parts = []
            for k in np.argsort(ids, kind="stable").tolist():
                text = texts[k].as_py()
                if text and len(text) >= LENGTH:
                    found = _contexts(text)
                    parts.append((*found, np.full(len(found[0]), ids[k])))
            if not parts:
                continue
            gram, w0, w1, at, n, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(w0, kind="stable")
            same = np.concatenate([[False], (w0[order[1:]] == w0[order[:-1]]) & (w1[order[1:]] == w1[order[:-1]]) & (gram[order[1:]] == gram[order[:-1]])])
            again = np.zeros(len(gram), bool)
            again[order] = same
            flag = np.where(np.isin(gram, hot_grams), HOT, FIRST) if len(hot_grams) else np.full(len(gram), FIRST)
            gram = np.where(flag == HOT, gram + (w0 & (HOT_PARTS - 1)) * np.int64(0x5851F42D4C957F2D), gram)
            once = np.flatnonzero(~again)
            rows = np.flatnonzero(again)
            if len(rows):  # neighbours become one run of strings
                head = np.concatenate([[True], (doc[rows[1:]] != doc[rows[:-1]]) | (at[rows[1:]] != at[rows[:-1]] + n[rows[:-1]] + 1)])
                lead, tail = rows[head], rows[np.append(np.flatnonzero(head)[1:] - 1, len(rows) - 1)]
                n[lead] = at[tail] + n[tail] - at[lead]
                flag[lead], w0[lead], w1[lead] = WHOLE, 0, 0
                gram[lead] = (doc[lead] * np.int64(0x5851F42D4C957F2D)) ^ (at[lead] << 32)
                once = np.sort(np.concatenate([once, lead]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[once]) for c in (gram, w0, w1, doc)), *(pa.array(c[once].astype(np.int32)) for c in (at, n)), pa.array(flag[once].astype(np.int8))],
                ["gram", "w0", "w1", "doc", "at", "n", "flag"],
            )

    return docs.mapInArrow(run, "gram long, w0 long, w1 long, doc long, at int, n int, flag byte")


def _hot_grams(docs: DataFrame) -> list[int]:
    """Grams with many contexts in a sample of the documents, HOT_GRAMS at most: a rarer one holds little of all rows."""
    sample = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(HOT_ONE_IN)) == 0)
    counts = _first_contexts(sample, []).filter(F.col("flag") == FIRST).groupBy("gram").count().filter(F.col("count") >= HOT_FOUND)
    return [r["gram"] for r in counts.orderBy(F.desc("count"), "gram").limit(HOT_GRAMS).collect()]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (gram, w0, w1, doc, at, n, flag) sorted in that order: (doc, at, n, flag) of WHOLE rows, which an earlier place has
    too, and of PARTLY ones, the earliest of contexts whose gram has (or, if it is hot, may have) other contexts. Only two
    rows are carried from batch to batch."""
    last = None  # (gram, w0, w1) of the current context
    open_first = None  # the first context of the current gram, until another one shows up

    def rows(doc: np.ndarray, at: np.ndarray, n: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(n), pa.array(flag.astype(np.int8))], ["doc", "at", "n", "flag"])

    for batch in batches:
        known = batch.column(6).to_numpy()
        told = np.flatnonzero(known == WHOLE)
        columns = [c.to_numpy() for c in batch.columns[:6]]
        if len(told):
            yield rows(*(c[told] for c in columns[3:]), known[told])
            columns, known = [np.delete(c, told) for c in columns], np.delete(known, told)
        gram, w0, w1, doc, at, n = columns
        m = len(gram)
        if not m:
            continue
        new_gram, new_whole = np.ones(m, bool), np.ones(m, bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new_whole[1:] = new_gram[1:] | (w0[1:] != w0[:-1]) | (w1[1:] != w1[:-1])
        if last is not None:
            new_gram[0] = gram[0] != last[0]
            new_whole[0] = new_gram[0] or w0[0] != last[1] or w1[0] != last[2]
        flag = np.where(new_whole, np.where(known == HOT, PARTLY, FIRST), WHOLE)
        # earliest rows: PARTLY if they aren't the gram's first context, or if the gram has another one later
        flag[new_whole & ~new_gram] = PARTLY
        starts = np.flatnonzero(new_gram)
        contexts_of = np.add.reduceat(new_whole, starts, dtype=np.int64) if len(starts) else np.empty(0, np.int64)
        flag[starts[contexts_of > 1]] = PARTLY
        extra = []
        until = starts[0] if len(starts) else m
        if open_first is not None:
            if new_whole[:until].any():
                extra, open_first = [open_first], None
            elif len(starts):
                open_first = None
        if len(starts):
            s = starts[-1]
            open_first = (int(doc[s]), int(at[s]), int(n[s])) if flag[s] == FIRST else None
        last = (int(gram[-1]), int(w0[-1]), int(w1[-1]))
        out = np.flatnonzero(flag)
        more = [np.array([x[k] for x in extra], kind) for k, kind in enumerate((np.int64, np.int32, np.int32))]
        yield rows(*(np.concatenate([c[out], x]) for c, x in zip((doc, at, n), more, strict=True)), np.concatenate([flag[out], np.full(len(extra), PARTLY)]))


def _rims(rows: DataFrame) -> DataFrame:
    """(gram, doc, at, place, context) of the PARTLY contexts, from (doc, text, partly array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for doc, text, partly in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                gram, place, first, last = anchors(np.frombuffer(text, np.uint8))
                k = np.searchsorted(first, np.unique(partly.values.to_numpy()))
                found[0] += gram[k].tolist()
                found[1] += [doc] * len(k)
                found[2] += first[k].tolist()
                found[3] += (place[k] - first[k]).tolist()
                found[4] += [text[a:b] for a, b in zip(first[k].tolist(), (last[k] + LENGTH).tolist(), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(found, kinds, strict=True)], ["gram", "doc", "at", "place", "context"])

    return rows.mapInArrow(run, "gram long, doc long, at int, place int, context binary")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (cell, split, doc, at, place, context) sorted by cell: (doc, at, n) runs of repeated strings, some whole cells at a
    time; of cells that hold a part of their gram only also a row a context with the starts of the strings that aren't
    repeated there, and their hashes (starts, h0, h1)."""
    held: list[tuple] = []
    cell = None

    def flush() -> pa.RecordBatch:
        held.sort(key=lambda r: (r[2], r[3]))
        doc, gram_at = np.array([r[2] for r in held], np.int64), np.array([r[3] + r[4] for r in held], np.int64)
        again = column_rounds([r[5] for r in held], np.array([r[4] for r in held], np.int64))
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        split = [k for k, r in enumerate(held) if r[1]]
        heads: list[list] = [[None] * len(who) for _ in range(3)]
        for k in split:
            at, place, context = held[k][3:]
            first = [s for s in range(len(context) - LENGTH + 1) if not again[k, place - s]]
            words = np.frombuffer(b"".join(xxhash.xxh3_128_digest(context[s : s + LENGTH]) for s in first), np.int64).reshape(-1, 2)
            for column, values in zip(heads, (at + np.array(first, np.int32), words[:, 0], words[:, 1]), strict=True):
                column.append(values)
        docs, starts = np.concatenate([doc[who], doc[split]]), np.concatenate([gram_at[who] - high, gram_at[split]])
        more = np.concatenate([high - low, np.zeros(len(split), np.int64)])
        lists = [pa.array(c, pa.list_(kind)) for c, kind in zip(heads, (pa.int32(), pa.int64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(docs), *(pa.array(c.astype(np.int32)) for c in (starts, more)), *lists], ["doc", "at", "n", "starts", "h0", "h1"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != cell and len(held) >= BLOCK:
                yield flush()
                held = []
            cell = row[0]
            held.append(row)
    if held:
        yield flush()


def _repeated_in_rims(rims: DataFrame) -> DataFrame:
    """(doc, at, n): runs of strings in the rims that an earlier place has too."""
    hot = rims.groupBy("gram").count().filter(F.col("count") > BLOCK).select("gram", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    hot = materialize(hot, "suffix-hot")
    n_hot = hot.count()
    own = F.pmod(F.xxhash64("doc", "at"), F.col("blocks"))
    cells = rims.join(maybe_broadcast(hot, n_hot, 100_000), "gram", "left").select(
        F.when(F.col("blocks").isNull(), F.col("gram")).otherwise(F.xxhash64("gram", own)).alias("cell"), F.col("blocks").isNotNull().alias("split"),
        "doc", "at", "place", "context",
    )
    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare, "doc long, at int, n int, starts array<int>, h0 array<long>, h1 array<long>")
    if not n_hot:
        return found.select("doc", "at", "n")
    found = materialize(found, "suffix-strings")
    heads = found.filter("starts IS NOT NULL").select("doc", F.inline(F.arrays_zip(F.col("starts").alias("at"), "h0", "h1")))
    first = heads.groupBy("h0", "h1").agg(F.min(F.struct("doc", "at")).alias("f"), F.count(F.lit(1)).alias("heads")).filter("heads > 1")
    later = heads.join(first, ["h0", "h1"]).filter((F.col("doc") != F.col("f.doc")) | (F.col("at") != F.col("f.at")))
    return found.filter("starts IS NULL").select("doc", "at", "n").unionByName(later.select("doc", "at", F.lit(0).alias("n")))


def marks(rows: DataFrame) -> DataFrame:
    """(doc, runs array<long>) of (doc, text): a run, at * 2**32 + n, says that the strings from at to at + n are repeated."""
    bounded_batches(rows.sparkSession)
    found = _first_contexts(rows, _hot_grams(rows)).repartition("gram").sortWithinPartitions("gram", "w0", "w1", "doc", "at")
    flags = materialize(found.mapInArrow(_mark, "doc long, at int, n int, flag byte"), "suffix-flags")
    partly = flags.filter(F.col("flag") == PARTLY).groupBy("doc").agg(F.collect_list("at").alias("partly"))
    rims = materialize(_rims(rows.filter(F.length("text") > 0).join(partly, "doc").select("doc", "text", "partly")), "suffix-rims")
    runs = flags.filter(F.col("flag") == WHOLE).select("doc", "at", "n").unionByName(_repeated_in_rims(rims))
    run = F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")
    return materialize(runs.groupBy("doc").agg(F.collect_list(run).alias("runs")), "suffix-marks")


def removed_mask(n: int, runs: np.ndarray) -> np.ndarray:
    """True for each of n bytes that is removed, from the runs of its document."""
    edge = np.zeros(n + 1, np.int64)
    start = runs >> 32
    np.add.at(edge, start, 1)
    np.add.at(edge, start + (runs & 0xFFFFFFFF) + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs and the name of a column of longs that orders its rows: id_col itself, where it tells all rows apart."""
    if isinstance(docs.schema[id_col].dataType, (LongType, IntegerType, ShortType, ByteType)):
        ids = docs.select(F.col(id_col).alias("id"))
        if ids.groupBy("id").count().filter("id IS NULL OR count > 1").isEmpty():
            return docs, id_col
    name = free_name(docs, "row")
    text = F.col(text_col).cast("string")
    rows = docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(text), F.xxhash64(F.lit("second"), text))
    # written, so that each use sees the same numbers
    return materialize(rows.withColumn(name, F.monotonically_increasing_id()), "suffix-rows"), name


def _with_marks(docs: DataFrame, id_col: str, text_col: str, one: Callable[[bytes, np.ndarray], tuple], fields: list[tuple[str, str]]) -> DataFrame:
    """docs with added fields: one(text's bytes, mask of the removed ones) gives their values."""
    rows, key = _ordered(docs, id_col, text_col)
    found = marks(rows.select(F.col(key).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")))
    doc, runs, text = (free_name(docs, c) for c in ("doc", "runs", "text"))
    joined = rows.join(found.select(F.col("doc").alias(doc), F.col("runs").alias(runs)), F.col(key) == F.col(doc), "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(text_col).cast("string").alias(text), runs)
    width, names = len(docs.columns), [*docs.columns, *(name for name, _ in fields)]
    none = np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = []
            for whole, marked in zip(batch.column(width).cast(pa.binary()), batch.column(width + 1), strict=True):
                body = whole.as_py() or b""
                values.append(one(body, removed_mask(len(body), marked.values.to_numpy() if marked.is_valid else none)))
            added = [pa.array(x) for x in zip(*values, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], names)

    schema = StructType(list(docs.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, kind)
    return joined.mapInArrow(run, schema)


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    return text if not gone.any() else np.frombuffer(text, np.uint8)[~gone].tobytes()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def one(text: bytes, gone: np.ndarray) -> tuple[int, int, int, str]:
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        return len(text), int(gone.sum()), spans, hashlib.sha256(_kept(text, gone)).hexdigest()

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias(text_col))
    fields = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")]
    return _with_marks(rows, id_col, text_col, one, fields).drop(text_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated bytes taken out of their texts; characters that lose some of their bytes go whole."""

    def one(text: bytes, gone: np.ndarray) -> tuple[str]:
        return (_kept(text, gone).decode("utf-8", "ignore"),)

    kept = free_name(docs, "kept")
    out = _with_marks(docs, id_col, text_col, one, [(kept, "string")])
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(kept))).select(*(F.col(f"`{c}`") for c in docs.columns))
