"""Joins of intervals in bins of two widths, both taken from the data.

A record may hold any share of all intervals, so the record alone is no key to join on. Time is cut into bins, and an
interval is listed in each bin that it touches. One width can't do: with many short intervals and a few long ones it is
too fine for these or too coarse for those. So an interval is long if it is longer than the mean (``coarse``, which is also
the width of the bins in which long ones are met), and short ones meet each other in bins of the short ones' mean length
(``fine``). Since lengths add up to their mean times their number, an interval is listed five times on average at most,
whatever the lengths are. A pair is reported once: in the bin that holds the later of the two starts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where two intervals meet: both short in fine bins; the left one long, or only the right one, in coarse bins.
BOTH_SHORT, LEFT_LONG, RIGHT_LONG = 0, 1, 2


@dataclass(frozen=True)
class Widths:
    fine: float = 1.0
    coarse: float = 1.0

    @classmethod
    def of(cls, *sides: DataFrame, start: str = "start_s", end: str = "end_s") -> Widths:
        """One pass over lengths, by powers of two: what comes back doesn't grow with the rows."""
        size = F.abs(F.col(end).cast("double") - F.col(start).cast("double"))
        lengths = reduce(DataFrame.unionAll, [s.select(size.alias("size")) for s in sides]).filter("size < double('infinity')")
        classes = lengths.groupBy(F.floor(F.log2("size")).alias("power")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).collect()
        total, n = sum(c["total"] for c in classes), sum(c["n"] for c in classes)
        if not total:
            return cls()
        coarse = 2.0 ** (math.floor(math.log2(total / n)) + 1)
        short = [c for c in classes if c["power"] is None or 2.0 ** (c["power"] + 1) <= coarse]
        mean = sum(c["total"] for c in short) / max(1, sum(c["n"] for c in short))
        return cls(mean or coarse, coarse)

    def bin_of(self, at: Column, kind: Column | int) -> Column:
        width = F.lit(self.fine if kind == BOTH_SHORT else self.coarse) if isinstance(kind, int) else F.when(kind == BOTH_SHORT, self.fine).otherwise(self.coarse)
        return F.floor(at / width)

    def is_long(self, start: Column, end: Column) -> Column:
        return F.abs(end - start) > self.coarse

    def touched(self, start: Column, end: Column, kind: int) -> Column:
        """The bins from start to end."""
        return F.sequence(self.bin_of(F.least(start, end), kind), self.bin_of(F.greatest(start, end), kind))

    def listed(self, start: Column, end: Column, left: bool) -> Column:
        """(kind, bin) of all bins in which an interval meets those of the other side."""
        spots = lambda kind: F.transform(self.touched(start, end, kind), lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("bin")))
        if left:
            return F.when(self.is_long(start, end), spots(LEFT_LONG)).otherwise(F.concat(spots(BOTH_SHORT), spots(RIGHT_LONG)))
        return F.when(self.is_long(start, end), F.concat(spots(LEFT_LONG), spots(RIGHT_LONG))).otherwise(F.concat(spots(BOTH_SHORT), spots(LEFT_LONG)))


def _double(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def overlapping(left: DataFrame, right: DataFrame, key: str, prefix: str = "r_", widths: Widths | None = None) -> DataFrame:
    """Pairs of intervals [start_s, end_s) of one key that share a moment; right's columns get the prefix."""
    widths = widths or Widths.of(left, right)
    other = right.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}") for c in right.columns))
    start, end, r_start, r_end = (F.col(c) for c in ("start_s", "end_s", f"{prefix}start_s", f"{prefix}end_s"))
    mine = left.withColumn("__spot", F.explode(widths.listed(start.cast("double"), end.cast("double"), True)))
    theirs = other.withColumn("__r_spot", F.explode(widths.listed(r_start.cast("double"), r_end.cast("double"), False)))
    met = (F.col(key) == F.col(f"{prefix}{key}")) & (F.col("__spot.kind") == F.col("__r_spot.kind")) & (F.col("__spot.bin") == F.col("__r_spot.bin"))
    once = F.col("__spot.bin") == widths.bin_of(F.greatest(start, r_start).cast("double"), F.col("__spot.kind"))
    return mine.join(theirs, met & (start < r_end) & (r_start < end) & once).drop("__spot", "__r_spot")


def outside(points: DataFrame, intervals: DataFrame, at: Column, key: str, widths: Widths | None = None) -> DataFrame:
    """Rows of points whose time lies in no interval of their key: an anti join with the short intervals, and one with the long."""
    widths = widths or Widths.of(intervals)
    spans = intervals.select(F.col(key).alias("__k"), _double(intervals, "start_s").alias("__s"), _double(intervals, "end_s").alias("__e")).filter("__e > __s")
    rows = points.withColumn("__at", at.cast("double"))
    for kind, some in ((BOTH_SHORT, ~widths.is_long(F.col("__s"), F.col("__e"))), (LEFT_LONG, widths.is_long(F.col("__s"), F.col("__e")))):
        listed = spans.filter(some).withColumn("__b", F.explode(widths.touched(F.col("__s"), F.col("__e"), kind)))
        inside = (F.col(key) == F.col("__k")) & (F.col("__bin") == F.col("__b")) & (F.col("__at") >= F.col("__s")) & (F.col("__at") < F.col("__e"))
        rows = rows.withColumn("__bin", widths.bin_of(F.col("__at"), kind)).join(listed, inside, "left_anti").drop("__bin")
    return rows.drop("__at")
