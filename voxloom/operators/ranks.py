"""Running numbers and order statistics of groups of any size, without one task for a group.

Rows are range partitioned by (group, order): a group lies in some neighbouring partitions. Inside a partition a window
numbers a group's rows; what comes before it in the group's earlier partitions is added. Only groups that lie in several
partitions need that, and there are fewer rows of that kind than two a partition, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.sources.shared import materialize


def numbered(df: DataFrame, order: list[Column], by: list[str] | None = None, out: str = "number", partitions: int | None = None) -> DataFrame:
    """df with ``out``: the place from 1 of each row in its group by the order, as row_number gives.

    Rows that are equal in group and order come in any order, and lie in one partition: let the order tell rows apart.
    """
    by = by or []
    groups = [f"__g{k}" for k in range(len(by))]
    keyed = df.select("*", *(F.col(f"`{c}`").alias(g) for c, g in zip(by, groups)))
    bounds = [*(F.col(g) for g in groups), *order]
    dealt = keyed.repartitionByRange(partitions, *bounds) if partitions else keyed.repartitionByRange(*bounds)
    dealt = materialize(dealt.withColumn("__part", F.spark_partition_id()), "numbered")
    inside = Window.partitionBy("__part", *groups).orderBy(*order)
    rows = dealt.withColumn("__n", F.row_number().over(inside))
    sizes = dealt.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__size"))
    along = Window.partitionBy(*groups).orderBy("__part")
    before = F.sum("__size").over(along.rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("__before", before).filter("__before is not null")
    later = F.broadcast(later.select(F.col("__part").alias("__p"), *(F.col(g).alias(f"{g}_") for g in groups), "__before"))
    same = F.col("__part") == F.col("__p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    found = rows.join(later, same, "left")
    return found.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__n") + F.coalesce("__before", F.lit(0))).cast("long").alias(out))


def at_places(df: DataFrame, value: str, places: DataFrame, by: list[str] | None = None) -> DataFrame:
    """places (group, place from 1) with the value that stands there when a group's values are ordered: exact order statistics."""
    by = by or []
    ranked = numbered(df.filter(F.col(value).isNotNull()).select(*by, value), [F.col(value).asc()], by, "__place")
    kept = ranked.select(*(F.col(c).alias(f"__k{k}") for k, c in enumerate(by)), "__place", value)
    same = F.col("place") == F.col("__place")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{k}"))
    return places.join(kept, same, "left").drop("__place", *(f"__k{k}" for k in range(len(by))))
