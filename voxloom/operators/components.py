"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.sources.shared import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of (p, q) with the least node that links connect it to.

    Rounds of two steps that keep what is connected: every node passes its larger neighbours on to its least one, then its
    smaller neighbours. A node of very many links is combined before it is shuffled. Ends when all links lead to roots: about
    log(nodes) rounds. Each round is written, so that a lost executor costs a re-read.
    """
    edges = materialize(links.filter("p <> q").select(F.greatest("p", "q").alias("p"), F.least("p", "q").alias("q")).distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("q").alias("p"), F.col("p").alias("q")))
        least = both.groupBy(F.col("p").alias("at")).agg(F.least(F.min("q"), F.col("p")).alias("m"))
        large = both.join(least, F.col("p") == F.col("at")).filter("q > p").select(F.col("q").alias("p"), F.col("m").alias("q")).distinct()
        small = large.groupBy(F.col("p").alias("at")).agg(F.min("q").alias("m"))
        moved = large.join(small, F.col("p") == F.col("at"))
        nearer = moved.filter("q <> m").select(F.col("q").alias("p"), F.col("m").alias("q")).unionAll(small.select(F.col("at").alias("p"), F.col("m").alias("q")))
        after = materialize(nearer.filter("p <> q").distinct(), "links")
        # stars: every node has one link, and roots have none
        roots = after.select(F.col("q").alias("root")).distinct()
        if after.groupBy("p").count().filter("count > 1").isEmpty() and after.join(roots, F.col("p") == F.col("root"), "left_semi").isEmpty():
            return after.select(F.col("p").alias("node"), F.col("q").alias("root")).unionAll(roots.select(F.col("root").alias("node"), "root"))
        edges = after
