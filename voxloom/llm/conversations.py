"""Conversation structure repair: the cheapest edits that give a conversation's turns a legal order of roles.

Three weighted machines are composed: an acceptor of the rows as they are, a transducer of edits (keep, give another
role, delete, insert) and an acceptor of the role grammar ``(s?(ua)+)?``, which works on initials of roles. A state of the
composition is (row, grammar state); ``arcs`` makes its arcs when they are asked for. Weights are (cost, label string),
compared in that order. A gap between rows takes two insertions at most (a third would come back to a state at a higher
cost), so states have a topological order and the shortest distances to the end follow from one backward pass. An
audit string leads along one path only, so of paths of equal cost the least string is found by taking the least label
that still reaches the shortest distance: strings are neither built nor compared in the pass.

How it runs: a conversation's rows are brought together, sorted, and streamed through one task, which holds one
conversation at a time. A conversation of over ``rows`` rows or ``bytes`` bytes is cut into segments by a range partition
over its turns. A segment gives a min-plus matrix of costs between grammar states; matrices are multiplied along the
conversation, which gives each segment the distances at its end; then segments give their exits for each entry, and at
last their edits. Only the digest of a whole conversation is a stream through one task, in constant memory, as SHA-256
can't be computed in parts; its audit string takes one byte a row there.

Edge cases: a null role or text is one space; rows come by turn, nulls first, rows of one turn by role and text; an empty
role, or one with another initial than s, u or a, can't be kept; repeated rows are duplicates like any others; a null
conversation id is a conversation of its own; conversations without rows (``copies`` 0 for all) have zeros and an empty
audit; an empty table gives an empty result; further columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, LongType, StructField, StructType

from voxloom.llm.common import bounded_batches, materialize, maybe_broadcast

SPACE_CHARS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: The role grammar: states 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a); its ends are 0 and 3.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INF = 1 << 40
END = (0, INF, INF, 0)
#: The state after an insertion, and the role that it or a change of role gives: each state allows one of user and assistant.
INSERTED = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
CLEAN, CUT, FORCED = 0, 1, 2


@dataclass(frozen=True)
class Limits:
    """Above these a conversation is cut into segments."""

    rows: int = 50_000
    bytes: int = 32 << 20
    broadcast: int = 200_000


# the composed machine


@lru_cache(maxsize=None)
def arcs(state: int, initial: str, fault: int) -> tuple[tuple[str, int, int], ...]:
    """(label, cost, next state) of the arcs that take a row, labels in ASCII order."""
    found = [("D", DELETE, state)]
    if fault != FORCED:
        extra = TRUNCATED if fault == CUT else 0
        if initial in GRAMMAR[state]:
            found.append(("K", extra, GRAMMAR[state][initial]))
        found.append(("R", REROLE + extra, INSERTED[state]))
    return tuple(found)


def _after_insertions(w: Iterable[int]) -> tuple[int, ...]:
    w = tuple(w)
    return tuple(min(w[q], INSERT + w[INSERTED[q]], 2 * INSERT + w[INSERTED[INSERTED[q]]]) for q in range(4))


def distances(rows: list[tuple[str, int]], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Before each of the rows (initial, fault), and after the last: the least cost to the end from each grammar state."""
    v = _after_insertions(end)
    out = [v]
    for initial, fault in reversed(rows):
        v = _after_insertions(min(cost + v[to] for _, cost, to in arcs(q, initial, fault)) for q in range(4))
        out.append(v)
    return out[::-1]


def edits(rows: list[tuple[str, int]], v: list[tuple[int, ...]], state: int, last: bool) -> Iterator[tuple[str, int, int]]:
    """(label, row, state after it) along the least path from state; what may be inserted after the last row is left to the
    next segment, if there is one."""
    i = 0
    while i < len(rows) or (last and v[i][state]):
        steps = [(label, cost + v[i + 1][to], to) for label, cost, to in arcs(state, *rows[i])] if i < len(rows) else []
        steps.append(("I", INSERT + v[i][INSERTED[state]], INSERTED[state]))
        label, _, state = min(s for s in steps if s[1] == v[i][state])
        yield label, i, state
        i += label != "I"


def matrix(rows: list[tuple[str, int]]) -> list[int]:
    """The least costs of a segment from each grammar state to each, row by row."""
    columns = [distances(rows, tuple(0 if q == j else INF for q in range(4)))[0] for j in range(4)]
    return [columns[j][q] for q in range(4) for j in range(4)]


def times(m: list[int], v: Iterable[int]) -> tuple[int, ...]:
    v = list(v)
    return tuple(min(m[4 * q + j] + v[j] for j in range(4)) for q in range(4))


# a run of rows: a whole conversation or a segment of one


@dataclass
class Run:
    """Rows in order; ``first`` says of a row that no earlier one has its role and text, or is None where the run holds
    the whole conversation and sees to that itself."""

    turns: list[int | None]
    roles: list[str]
    texts: list[str]
    coded: list[tuple[str, int]]
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0

    @classmethod
    def of(cls, rows: Iterable[tuple[int | None, str, str, int, bool | None]]) -> Run:
        run, seen = cls([], [], [], []), set()
        for turn, role, text, copies, first in rows:
            bare = text.strip(SPACE_CHARS)
            for copy in range(copies):
                earlier = copy > 0 or ((role, text) in seen if first is None else not first)
                if not bare:
                    run.blank += 1
                elif earlier:
                    run.duplicate += 1
                elif bare[-1] not in ".!?":
                    run.truncated += 1
                fault = FORCED if not bare or earlier else CUT if bare[-1] not in ".!?" else CLEAN
                run.turns.append(turn)
                run.roles.append(role)
                run.texts.append(text)
                run.coded.append((role[:1], fault))
            if first is None:
                seen.add((role, text))
        return run

    def illegal(self) -> int:
        return sum(a[0] + b[0] not in LEGAL for a, b in zip(self.coded, self.coded[1:]))

    def line(self, label: str, i: int, state: int) -> tuple[str, str] | None:
        """The role and text that an edit leaves."""
        if label == "D":
            return None
        if label == "I":
            return ROLES[state], ""
        return (self.roles[i] if label == "K" else ROLES[state]), self.texts[i]


def _turn_counts(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """Least, greatest and number of distinct turns."""
    some = {t for t in turns if t is not None}
    return (min(some), max(some), len(some)) if some else (None, None, 0)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that agree in their first columns, which lie together, with what follows these columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if key is not None:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if key is not None:
        yield key, held


def _mapped(df: DataFrame, keys: list[str], order: list[Column], one: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: StructType) -> DataFrame:
    """one(key, rows) over the groups of keys, rows in order, with a group in memory at a time."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, rows in _runs(batches, len(keys)):
            for made in one(key, rows):
                out.append(made)
                size += 64 + sum(len(x) for x in made if isinstance(x, str))
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*(F.col(k).asc() for k in keys), *order).mapInArrow(run, schema)


ORDER = ("turn", "role", "text")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _with_fields(key: list[StructField], others: str) -> StructType:
    return StructType([*key, *StructType.fromDDL(others).fields])


def _report_schema(conv: DataType) -> StructType:
    return _with_fields([StructField("conv", conv)], ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def _gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else most - least + 1 - distinct


def _whole(rows: list[tuple]) -> tuple[Run, list[tuple[str, int, int]], int]:
    run = Run.of(rows)
    v = distances(run.coded, END)
    return run, list(edits(run.coded, v, 0, True)), v[0][0]


def _report(key: tuple, rows: list[tuple]) -> list[tuple]:
    run, path, cost = _whole(rows)
    lines = [":".join(x) for step in path if (x := run.line(*step))]
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return [(*key, _gaps(*_turn_counts(run.turns)), run.blank, run.duplicate, run.truncated, run.illegal(), cost, "".join(s[0] for s in path), digest)]


def _rows_of(run: Run, path: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int | None, str, str]]:
    """(edit, turn, role, text) of the rows that a path leaves; the turn of an inserted row is null."""
    for label, i, state in path:
        if line := run.line(label, i, state):
            yield label, None if label == "I" else run.turns[i], *line


# conversations in segments


def _segments(rows: DataFrame) -> DataFrame:
    """(conv, seg, turn, role, text, copies, first): equal rows are one with its copies; segments follow the order of rows."""
    rows = rows.filter("copies > 0").groupBy("conv", *ORDER).agg(F.sum("copies").alias("copies"))
    rows = materialize(rows.withColumn("h0", F.xxhash64("role", "text")).withColumn("h1", F.xxhash64(F.lit("second"), "role", "text")), "conversation-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy("conv", "h0", "h1").agg(F.min(place).alias("least"))
    firsts = firsts.select(F.col("conv").alias("f_conv"), F.col("h0").alias("f_h0"), F.col("h1").alias("f_h1"), F.col("least.turn").alias("f_turn"))
    joined = rows.join(firsts, F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("h0") == F.col("f_h0")) & (F.col("h1") == F.col("f_h1")))
    joined = joined.select("conv", *ORDER, "copies", F.col("turn").eqNullSafe(F.col("f_turn")).alias("first"))
    cut = joined.repartitionByRange("conv", *ORDER)
    return materialize(cut.select("conv", F.spark_partition_id().alias("seg"), *ORDER, "copies", "first"), "conversation-segments")


def _along(df: DataFrame, one: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """one(rows of a conversation's segments, in order): a row a segment, as many as range partitions at most."""
    return df.groupBy("conv").applyInPandas(lambda rows: one(rows.sort_values("seg").reset_index(drop=True)), schema)


def _by_segment(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"conv": "r_conv", "seg": "r_seg"})
    return left.join(right, F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("seg") == F.col("r_seg"))).drop("r_conv", "r_seg")


def _planned(parts: DataFrame, conv: DataType) -> tuple[DataFrame, DataFrame]:
    """(conv, seg, v, last, entry) for each segment, and (conv, counts...) for each conversation."""
    key = [StructField("conv", conv), StructField("seg", LongType())]
    rows = parts.select("conv", F.col("seg").cast("long").alias("seg"), *ORDER, "copies", "first")
    order = [F.col(c).asc() for c in ORDER]

    def summed(k: tuple, held: list[tuple]) -> list[tuple]:
        run = Run.of(held)
        ends = (run.roles[0][:1], run.roles[-1][:1])
        return [(*k, matrix(run.coded), run.blank, run.duplicate, run.truncated, run.illegal(), *ends, *_turn_counts(run.turns))]

    schema = _with_fields(key, "m array<long>, blank long, duplicate long, truncated long, illegal long, opens string, closes string, least long, most long, distinct long")
    sums = materialize(_mapped(rows, ["conv", "seg"], order, summed, schema), "conversation-sums")

    def totals(held: pd.DataFrame) -> pd.DataFrame:
        v, vs = END, []
        for m in held["m"][::-1]:
            vs.append(list(v))
            v = times(list(m), v)
        turns = [[None if pd.isna(x) else int(x) for x in held[c]] for c in ("least", "most")]
        known = [(a, b) for a, b in zip(*turns) if a is not None]
        shared = sum(b[0] == a[1] for a, b in zip(known, known[1:]))
        gaps = _gaps(known[0][0], known[-1][1], int(held["distinct"].sum()) - shared) if known else 0
        across = sum(a + b not in LEGAL for a, b in zip(held["closes"], held["opens"][1:]))
        return pd.DataFrame({
            "conv": held["conv"], "seg": held["seg"], "v": vs[::-1], "last": [False] * (len(held) - 1) + [True], "gaps": gaps,
            **{c: int(held[c].sum()) for c in ("blank", "duplicate", "truncated")}, "illegal": int(held["illegal"].sum()) + across, "cost": v[0],
        })

    schema = _with_fields(key, "v array<long>, last boolean, " + ", ".join(f"{c} long" for c in COUNTS))
    plan = materialize(_along(sums, totals, schema), "conversation-plan")

    def exits(k: tuple, held: list[tuple]) -> list[tuple]:
        run, (v, last) = Run.of(r[:5] for r in held), held[0][5:]
        dist = distances(run.coded, END if last else tuple(v))
        found = []
        for state in range(4):
            for _, _, state in edits(run.coded, dist, state, last):
                pass
            found.append(state)
        return [(*k, found)]

    joined = _by_segment(rows, plan.select("conv", "seg", "v", "last")).select("conv", "seg", *ORDER, "copies", "first", "v", "last")
    left = _mapped(joined, ["conv", "seg"], order, exits, _with_fields(key, "exits array<int>"))

    def entries(held: pd.DataFrame) -> pd.DataFrame:
        state, found = 0, []
        for e in held["exits"]:
            found.append(state)
            state = int(e[state])
        return pd.DataFrame({"conv": held["conv"], "seg": held["seg"], "entry": found})

    entry = _along(left, entries, _with_fields(key, "entry int"))
    plan = materialize(_by_segment(plan, entry), "conversation-entries")
    return plan.select("conv", "seg", "v", "last", "entry"), plan.filter("last").select("conv", *COUNTS)


def _edited(parts: DataFrame, plan: DataFrame, one: Callable[[tuple, Run, list], Iterable[tuple]], schema: StructType) -> DataFrame:
    """one(key, run, path) over all segments."""
    rows = parts.select("conv", F.col("seg").cast("long").alias("seg"), *ORDER, "copies", "first")
    joined = _by_segment(rows, plan).select("conv", "seg", *ORDER, "copies", "first", "v", "last", "entry")

    def run_of(k: tuple, held: list[tuple]) -> Iterable[tuple]:
        run, (v, last, entry) = Run.of(r[:5] for r in held), held[0][5:]
        return one(k, run, list(edits(run.coded, distances(run.coded, END if last else tuple(v)), entry, last)))

    return _mapped(joined, ["conv", "seg"], [F.col(c).asc() for c in ORDER], run_of, schema)


def _digest(batches: Iterable[tuple[str, str | None]]) -> tuple[str, str]:
    digest, audit, some = hashlib.sha256(), [], False
    for labels, body in batches:
        audit.append(labels)
        if body is not None:
            digest.update((b"\n" if some else b"") + body.encode())
            some = True
    return "".join(audit), digest.hexdigest()


def _large_reports(rows: DataFrame, conv: DataType) -> DataFrame:
    parts = _segments(rows)
    plan, totals = _planned(parts, conv)
    key = [StructField("conv", conv), StructField("seg", LongType())]

    def piece(k: tuple, run: Run, path: list) -> list[tuple]:
        lines = [":".join(x) for step in path if (x := run.line(*step))]
        return [(*k, "".join(s[0] for s in path), "\n".join(lines) if lines else None)]

    pieces = materialize(_edited(parts, plan, piece, _with_fields(key, "audit string, body string")), "conversation-pieces")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for k, held in groupby(rows_of(), key=lambda r: r[0]):
            audit, digest = _digest(r[2:] for r in held)
            yield pa.RecordBatch.from_pylist([{"d_conv": k, "audit": audit, "repaired_sha256": digest}], schema=arrow)

    schema = _with_fields([StructField("d_conv", conv)], "audit string, repaired_sha256 string")
    arrow = to_arrow_schema(schema)
    digests = pieces.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(stream, schema)
    return totals.join(digests, F.col("conv").eqNullSafe(F.col("d_conv"))).select("conv", *COUNTS, "audit", "repaired_sha256")


def _split(rows: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame | None]:
    """(rows of conversations that fit a task, rows of the others or None)."""
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("size"))
    large = materialize(sizes.filter((F.col("n") > limits.rows) | (F.col("size") > limits.bytes)).select(F.col("conv").alias("l_conv")), "conversations-large")
    n = large.count()
    if not n:
        return rows, None
    large = maybe_broadcast(large, n, limits.broadcast)
    same = F.col("conv").eqNullSafe(F.col("l_conv"))
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def _prepared(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: Column | None) -> DataFrame:
    space = F.lit(" ")
    n = F.lit(1) if copies is None else copies
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"), n.cast("long").alias("copies"),
    )
    return rows.withColumn("text", F.when(F.col("copies") > 0, F.col("text")).otherwise(""))


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, limits: Limits = Limits()
) -> DataFrame:
    """A row a conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``copies`` says how often a row counts (once, if not given); a conversation whose rows all count 0 times has no rows.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[conv].dataType
    small, large = _split(_prepared(df, conv, turn, role, text, copies), limits)
    small = small.select("conv", *ORDER, "copies", F.lit(None).cast("boolean").alias("first"))
    found = _mapped(small, ["conv"], [F.col(c).asc() for c in ORDER], _report, _report_schema(kind))
    if large is not None:
        found = found.unionByName(_large_reports(large, kind))
    return found.withColumnRenamed("conv", conv)


def repaired(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None, limits: Limits = Limits()
) -> DataFrame:
    """The rows of the repaired conversations: id, seg, pos (rows come by seg, pos), edit (K, R or I), turn, role, text."""
    bounded_batches(df.sparkSession)
    kind = df.schema[conv].dataType
    schema = _with_fields([StructField("conv", kind)], "seg long, pos long, edit string, turn long, role string, text string")
    small, large = _split(_prepared(df, conv, turn, role, text, copies), limits)
    small = small.select("conv", *ORDER, "copies", F.lit(None).cast("boolean").alias("first"))

    def whole(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        run, path, _ = _whole(rows)
        return ((*key, 0, k, *r) for k, r in enumerate(_rows_of(run, path)))

    found = _mapped(small, ["conv"], [F.col(c).asc() for c in ORDER], whole, schema)
    if large is not None:
        parts = _segments(large)
        plan, _ = _planned(parts, kind)
        found = found.unionByName(_edited(parts, plan, lambda key, run, path: ((*key, k, *r) for k, r in enumerate(_rows_of(run, path))), schema))
    return found.select(F.col("conv").alias(conv), "seg", "pos", "edit", F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, Column]:
    """Test damage by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its .!? out, 3 repeats it,
    4 makes it the user's. Gives (id, turn, role, text) and how often each row counts."""
    space = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))) % 20
    body = F.coalesce(F.col(text).cast("string"), space)
    rows = df.select(
        F.col(conv).alias(conv), F.col(turn).alias(turn),
        F.when(code == 4, F.lit("user")).otherwise(F.coalesce(F.col(role).cast("string"), space)).alias(role),
        F.when(code == 1, F.lit("")).when(code == 2, F.translate(body, ".!?", "")).otherwise(body).alias(text),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("damage_copies"),
    )
    return rows, F.col("damage_copies")
