"""Totals of each interval's overlaps on one timeline, without a list of the pairs.

Pairs grow with the square of the intervals when more of them share the same time. So time is cut into bins that hold about
as many ends each, and what an interval meets is put together from whole bins and the two bins in which it starts and ends.

* Counts: those that start before its end, less those that end by its start. Overlap: seconds that the others have covered
  up to its end, less those up to its start. Both come from sums of the bins before and a search inside of one bin. Times are
  summed as integers, so that sums are exact in any order.
* Least and greatest ids: of the bins between, from a table of all runs of bins whose length is a power of two; of those that
  cover a bin, from the same kind of runs; inside a bin, of those that start before its end and end after its start, from
  blocks of the starts in order, each sorted by ends.

A bin that holds too many ends of one time is dealt in parts. What reaches the driver are some rows a bin. Intervals that end
before they start, or whose times are beyond LIMIT, are met as pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import interval_join

#: Starts and ends in a bin, some 50 bytes each in Python.
PER_BIN = 50_000
#: Times are whole 64ths of a second and 2^-42 seconds beside these; below this limit 2^26 of them can be summed.
COARSE, FINE, LIMIT = 1 << 6, 1 << 42, float(1 << 31)
#: No id: greater than any, as the ids are where the least is sought. Greatest ids are sought as the least of their complements.
NONE = (1 << 63) - 1
PARTIAL = "n long, coarse long, fine long, apart double, low long, high long"


def _whole(time):
    """A time as two integers, from a numpy array."""
    coarse = np.floor(time * COARSE)
    return np.stack([coarse, np.rint((time - coarse / COARSE) * FINE)]).astype(np.int64)


def _summed(time: Column) -> list[Column]:
    coarse = F.floor(time * COARSE)
    return [F.sum(coarse), F.sum(F.rint((time - coarse / COARSE) * FINE).cast("long"))]


def runs_of(least: np.ndarray) -> list[np.ndarray]:
    """least[:, b] of each bin -> for each power k the least of the bins b to b + 2^k - 1."""
    table = [least]
    while 2 << (len(table) - 1) <= least.shape[1]:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:, :-half], table[-1][:, half:]))
    return table


def least_between(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of the bins first to last, both included; NONE where there are none."""
    out = np.full((2, len(first)), NONE)
    power = np.frexp(np.maximum(last - first + 1, 0))[1] - 1
    for k, least in enumerate(table):
        at = np.flatnonzero(power == k)
        out[:, at] = np.minimum(least[:, first[at]], least[:, last[at] + 1 - (1 << k)])
    return out


def least_of(start: np.ndarray, end: np.ndarray, ids: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each query the least ids[:, i] with start[i] < before and end[i] > after; NONE where there are none.

    In order of starts the rows that start in time come first; their number is a sum of powers of two, so they are blocks of
    these sizes. In a block sorted by ends, those that end late enough come last.
    """
    out, n = np.full((2, len(before)), NONE), len(start)
    order = np.argsort(start, kind="stable")
    upto = np.searchsorted(start[order], before, "left")
    rank = np.empty(n, np.int64)
    rank[np.argsort(end[order], kind="stable")] = np.arange(n)
    late = np.searchsorted(np.sort(end), after, "right")
    for k in range(n.bit_length()):
        at, size = np.flatnonzero(upto >> k & 1), 1 << k
        if not len(at):
            continue
        key = (np.arange(n) >> k) * (n + 1) + rank
        by_end = np.argsort(key)
        rest = np.full((2, -(-n // size) * size), NONE)
        rest[:, :n] = ids[:, order[by_end]]
        rest = np.minimum.accumulate(rest.reshape(2, -1, size)[:, :, ::-1], axis=2)[:, :, ::-1].reshape(2, -1)
        block = (upto[at] >> k) - 1
        place = np.searchsorted(key[by_end], block * (n + 1) + late[at])
        some = place < (block + 1) * size
        out[:, at[some]] = np.minimum(out[:, at[some]], rest[:, place[some]])
    return out


def _prefixed(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((len(values), 1), np.int64), np.cumsum(values, axis=1)], axis=1)


class _Bins:
    """What is known of all bins: sums of the starts and ends before each, least ids of those that cover it and of those that
    touch a run of bins."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, touched: np.ndarray, covered: list[np.ndarray]):
        self.before = [_prefixed(x)[:, :-1] for x in (starts, ends)]
        for half, long in reversed(list(enumerate(covered[1:]))):  # runs of bins become runs of half their length
            for shift in (0, 1 << half):
                covered[half][:, shift : shift + long.shape[1]] = np.minimum(covered[half][:, shift : shift + long.shape[1]], long)
        self.covered = covered[0]
        self.runs = runs_of(np.minimum(touched, self.covered))

    def met(self, mine: pa.Table, others: pa.Table) -> pa.Table:
        """Partial totals of the rows of one bin and part."""
        if not mine.num_rows:
            return _table(mine["id"], np.zeros((3, 0), np.int64), np.zeros((2, 0), np.int64))
        col = lambda t, name: t[name].combine_chunks().to_numpy(zero_copy_only=False)
        s, e, first, last, at = (col(mine, c) for c in ("s", "e", "first", "last", "bin"))
        o_s, o_e, o_first, o_last = (col(others, c) for c in ("s", "e", "first", "last"))
        ids = np.stack([col(others, "low"), col(others, "high")])
        b, lead = int(at[0]), not col(mine, "other_part")[0]
        sides = [np.sort(o_s[o_first == b]), np.sort(o_e[o_last == b])]
        sums = [_prefixed(_whole(x)) for x in sides]
        base = [x[:, b] if lead else np.zeros(3, np.int64) for x in self.before]
        found = np.zeros((3, len(s)), np.int64)

        def covered_until(time: np.ndarray) -> np.ndarray:
            """Seconds that the others have covered up to a time, as integers."""
            place = [np.searchsorted(x, time, "left") for x in sides]
            active = base[0][0] + place[0] - base[1][0] - place[1]
            return _whole(time) * active - (base[0][1:, None] + sums[0][:, place[0]] - base[1][1:, None] - sums[1][:, place[1]])

        ends, starts = last == b, first == b
        found[0, ends] += base[0][0] + np.searchsorted(sides[0], e[ends], "left")
        found[0, starts] -= base[1][0] + np.searchsorted(sides[1], s[starts], "right")
        found[1:, ends] += covered_until(e[ends])
        found[1:, starts] -= covered_until(s[starts])
        # two intervals without length at one time were taken away twice
        points, empty = np.sort(o_s[o_s == o_e]), s == e
        found[0, empty] += np.searchsorted(points, s[empty], "right") - np.searchsorted(points, s[empty], "left")
        least = least_of(o_s, o_e, ids, e, s)
        if lead:
            least = np.minimum(least, self.covered[:, [b]])
            least[:, starts] = np.minimum(least[:, starts], least_between(self.runs, first[starts] + 1, last[starts] - 1))
        return _table(mine["id"], found, least)


def _table(ids: pa.ChunkedArray, found: np.ndarray, least: np.ndarray) -> pa.Table:
    return pa.table([ids, *found, np.zeros(len(ids)), *least], ["id", "n", "coarse", "fine", "apart", "low", "high"])


def _bins_of(right: DataFrame, bins: int) -> tuple[_Bins, np.ndarray]:
    """From rows (s, e, first, last, low, high) what is known of all bins, and how many rows touch each."""
    sides = np.zeros((2, 3, bins), np.int64)
    touched, covered = np.full((2, bins), NONE), [np.full((2, bins + 1 - (1 << k)), NONE) for k in range(bins.bit_length())]
    size, least = np.zeros(bins, np.int64), [F.min("low").alias("low"), F.min("high").alias("high")]
    for k, (time, at) in enumerate((("s", "first"), ("e", "last"))):
        for r in right.groupBy(at).agg(F.count(F.lit(1)), *_summed(F.col(time)), *least, F.count_if(F.col("first") < F.col("last"))).collect():
            sides[k, :, r[0]] = r[1:4]
            touched[:, r[0]] = np.minimum(touched[:, r[0]], r[4:6])
            size[r[0]] += r[1] if k == 0 else r[6]
    # the bins between are covered by two runs of the greatest power of two that fits in
    inner = right.withColumn("n", F.col("last") - F.col("first") - 1).filter("n > 0").withColumn("power", F.length(F.bin(F.greatest("n", F.lit(1)))) - 1)
    inner = inner.withColumn("b", F.explode(F.expr("array(first + 1, last - shiftleft(1, power))")))
    for r in inner.groupBy("power", "b").agg(*least).collect():
        covered[r[0]][:, r[1]] = r[2:4]
    return _Bins(*sides, touched, covered), size


def _dealt(rows: DataFrame, parts: DataFrame, own: str, other: str) -> DataFrame:
    """rows in the bins where they start and end, each in one of its side's parts and all of the other side's."""
    listed = rows.withColumn("bin", F.explode(F.array_distinct(F.array("first", "last")))).join(F.broadcast(parts), "bin")
    part = F.pmod(F.xxhash64(*rows.columns), F.col(own)).cast("int")
    return listed.withColumn(f"{own}_part", part).withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)


def overlap_totals(left: DataFrame, right: DataFrame, per_bin: int = PER_BIN) -> DataFrame:
    """(id, n, first, last, overlap_s) of each left interval that shares a moment with some of right, both (id, start_s, end_s) of
    one timeline: how many, the least and greatest of their ids (long), and the seconds shared, summed. Rows of one id are added up."""
    mine, others = (df.select("id", F.col("start_s").cast("double").alias("s"), F.col("end_s").cast("double").alias("e")).filter("s IS NOT NULL AND e IS NOT NULL") for df in (left, right))
    low = F.coalesce(F.col("id").cast("long"), F.lit(NONE)).alias("low")
    high = F.coalesce(F.bitwise_not(F.col("id").cast("long")), F.lit(NONE)).alias("high")
    others = others.select("s", "e", low, high)
    regular = (F.col("s") <= F.col("e")) & (F.abs("s") < LIMIT) & (F.abs("e") < LIMIT)
    rows, odd = mine.select(regular.alias("r")).unionAll(others.select(regular.alias("r"))).agg(F.count_if("r"), F.count_if(~F.col("r"))).first()
    found = []
    if odd:
        found += [_pairs(mine.filter(~regular), others), _pairs(mine.filter(regular), others.filter(~regular))]
        mine, others = mine.filter(regular), others.filter(regular)

    times = mine.select("s", "e").unionAll(others.select("s", "e")).select(F.explode(F.array("s", "e")).alias("t"))
    n = -(-2 * rows // per_bin)
    edges = sorted(set(times.approxQuantile("t", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    if edges:
        splits = [-float("inf"), *edges, float("inf")]
        cut = Bucketizer(splitsArray=[splits, splits], inputCols=["s", "e"], outputCols=["first", "last"])
        mine, others = cut.transform(mine), cut.transform(others)
    else:
        mine, others = (df.withColumn("first", F.lit(0)).withColumn("last", F.lit(0)) for df in (mine, others))
    mine, others = (df.withColumn("first", F.col("first").cast("int")).withColumn("last", F.col("last").cast("int")) for df in (mine, others))
    bins, other_size = _bins_of(others, len(edges) + 1)
    own_size = np.zeros(len(edges) + 1, np.int64)
    for b, size in mine.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("b")).groupBy("b").count().collect():
        own_size[b] = size
    parts = [(b, *(int(max(1, -(-size[b] // (2 * per_bin)))) for size in (own_size, other_size))) for b in range(len(edges) + 1)]
    parts = left.sparkSession.createDataFrame(parts, "bin int, own int, other int")
    keys = ["bin", "own_part", "other_part"]
    sides = [_dealt(mine, parts, "own", "other").groupBy(*keys), _dealt(others, parts, "other", "own").groupBy(*keys)]
    id_type = mine.schema["id"].dataType.simpleString()
    found.append(sides[0].cogroup(sides[1]).applyInArrow(lambda a, b: bins.met(a, b), f"id {id_type}, {PARTIAL}"))

    total = reduce(DataFrame.unionByName, found).groupBy("id").agg(
        *(F.sum(c).alias(c) for c in ("n", "coarse", "fine", "apart")), F.nullif(F.min("low"), F.lit(NONE)).alias("first"), F.bitwise_not(F.nullif(F.min("high"), F.lit(NONE))).alias("last")
    )
    shared = F.col("coarse") / COARSE + F.col("fine") / FINE + F.col("apart")
    return total.filter("n > 0").select("id", "n", "first", "last", shared.alias("overlap_s"))


def _pairs(mine: DataFrame, others: DataFrame) -> DataFrame:
    """Partial totals from the pairs themselves."""
    sides = [df.withColumnsRenamed({"s": "start_s", "e": "end_s"}).withColumn("all", F.lit(True)) for df in (mine, others)]
    both = interval_join.overlapping(*sides, "all")
    shared = F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s")
    zero = F.lit(0).cast("long")
    return both.select("id", F.lit(1).cast("long").alias("n"), zero.alias("coarse"), zero.alias("fine"), shared.alias("apart"), F.col("r_low").alias("low"), F.col("r_high").alias("high"))
