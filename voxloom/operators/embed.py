"""Embedding statistics: PLDA, cosine similarity and average-linkage clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.components import components
from voxloom.operators.ranks import numbered
from voxloom.sources.shared import bounded_batches, materialize

#: Vectors of a block, of a group that one task clusters (some MB of sums), and of a product in it.
BLOCK_ROWS, WHOLE_GROUP, NEAR_ROWS = 512, 1 << 17, 256
#: A round of merges must take one of so many clusters.
LITTLE = 50


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit(v: Column) -> Column:
    """A vector by its length; a vector of zeros stays."""
    size = F.sqrt(dot(v, v))
    return F.get(F.transform(F.array(F.when(size > 0, size).otherwise(1.0)), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 0)


def block_pairs(vectors: DataFrame, id_col: str, vec_col: str, by: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(g, a, b): every two blocks of unit vectors (arrays of (id, v)) of a group, and each block with itself.

    A group of any size falls into blocks by a hash of its ids, so that a pair of blocks is a row of bounded size and a task
    holds one at a time. Only the number of blocks is paired before the blocks themselves are joined on.
    """
    bounded_batches(vectors.sparkSession)
    unit = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(by).alias("g"), F.col(id_col).alias("id"), _unit(F.col(vec_col)).alias("v"))
    sizes = unit.groupBy(F.col("g").alias("s_g")).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = unit.join(sizes, F.col("g").eqNullSafe(F.col("s_g"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = materialize(dealt.groupBy("g", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows")), "vector-blocks")
    there = blocks.groupBy("g").agg(F.array_sort(F.collect_list("block")).alias("n"))
    pairs = there.select("g", "n", F.explode("n").alias("i")).select("g", "i", F.explode(F.filter("n", lambda j: j >= F.col("i"))).alias("j"))
    side = lambda n, at: blocks.select(F.col("g").alias(f"{n}_g"), F.col("block").alias(at), F.col("rows").alias(n))
    found = pairs.join(side("a", "a_i"), F.col("g").eqNullSafe(F.col("a_g")) & (F.col("i") == F.col("a_i")))
    found = found.join(side("b", "b_j"), F.col("g").eqNullSafe(F.col("b_g")) & (F.col("j") == F.col("b_j")))
    return found.select("g", "a", "b", (F.col("i") == F.col("j")).alias("own"))


def _vectors(rows: pa.Scalar) -> tuple[pa.Array, np.ndarray]:
    """(ids, matrix) of a block."""
    ids, v = rows.values.field("id"), rows.values.field("v")
    return ids, v.flatten().to_numpy().reshape(len(ids), -1)


def cosine_pairs(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", by: str = "label", least: float = 0.0) -> DataFrame:
    """(id_a, id_b, cosine) of pairs inside a group with at least that similarity: a matrix product for every two blocks."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in zip(batch.column("a"), batch.column("b"), batch.column("own").to_pylist(), strict=True):
                (left, x), (right, y) = _vectors(a), _vectors(b)
                cosine = x @ y.T
                i, j = np.nonzero(np.triu(cosine >= least, 1) if own else cosine >= least)
                yield pa.RecordBatch.from_arrays([left.take(pa.array(i)), right.take(pa.array(j)), pa.array(cosine[i, j])], ["p", "q", "cosine"])

    found = block_pairs(vectors, id_col, vec_col, by).mapInArrow(run, f"p {kind}, q {kind}, cosine double").filter("p <> q")
    return found.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "cosine")


def class_moments(vectors: DataFrame, vec_col: str = "embedding", label: str = "label") -> DataFrame:
    """(label, n, sums array<double>, products array<double>): each class's first and second moments.

    One pass in Arrow batches gives a partial row a batch and class; the rows that are shuffled don't grow with the vectors'
    number but with classes and partitions.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, group in batch.groupby("label"):
                x = np.vstack(group["v"].to_numpy()).astype(np.float64)
                rows.append((name, len(x), x.sum(axis=0), (x.T @ x).ravel()))
            yield pd.DataFrame(rows, columns=["label", "n", "s", "p"])

    parts = vectors.select(F.col(label).alias("label"), F.col(vec_col).alias("v")).filter("v is not null and label is not null").mapInPandas(
        partial, f"label {vectors.schema[label].dataType.simpleString()}, n long, s array<double>, p array<double>"
    )

    def total(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(group["label"].iloc[0], int(group["n"].sum()), group["s"].sum(), group["p"].sum())], columns=["label", "n", "s", "p"])

    return parts.groupBy("label").applyInPandas(total, parts.schema).withColumnsRenamed({"s": "sums", "p": "products"})


class Plda:
    """Mean, between-class and within-class covariance of embeddings."""

    def __init__(self, mu: np.ndarray, between: np.ndarray, within: np.ndarray):
        self.mu, self.between, self.within = mu, between, within

    @classmethod
    def fit(cls, vectors: DataFrame, vec_col: str = "embedding", label: str = "label") -> Plda:
        """From the classes' moments; the number of classes bounds what is collected."""
        rows = class_moments(vectors, vec_col, label).collect()
        n = np.array([r["n"] for r in rows], float)
        sums = np.array([r["sums"] for r in rows])
        d = sums.shape[1]
        products = np.sum([np.array(r["products"]).reshape(d, d) for r in rows], axis=0)
        means = sums / n[:, None]
        mu = sums.sum(axis=0) / n.sum()
        centred = means - mu
        between = (centred * n[:, None]).T @ centred / n.sum()
        within = (products - (means * n[:, None]).T @ means) / max(1.0, n.sum() - len(n))
        return cls(mu, between, within)

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.mu.tolist(), self.between.tolist(), self.within.tolist())]
        spark.createDataFrame(row, "mu array<double>, between array<array<double>>, within array<array<double>>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Plda:
        row = spark.read.parquet(path).first()
        return cls(*(np.array(row[k]) for k in ("mu", "between", "within")))

    def scorer(self):
        """Pandas UDF (array, array) -> double, higher for one class: with centred a and b, the quadratic forms of a - b under
        the within-class and of a + b under the between-class pseudo-inverse, against those of a and b under the total's."""
        within, between, total = (np.linalg.pinv(m) for m in (self.within, self.between, self.within + self.between))
        mu = self.mu

        @F.pandas_udf(T.DoubleType())
        def score(a: pd.Series, b: pd.Series) -> pd.Series:
            x, y = np.vstack(a.to_numpy()) - mu, np.vstack(b.to_numpy()) - mu
            form = lambda m, v: np.einsum("ij,jk,ik->i", v, m, v, optimize=True)
            return pd.Series(0.5 * (form(total, x) + form(total, y) - form(within, x - y) - form(between, x + y)))

        return score


def _nearest(total: np.ndarray, size: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the cluster nearest to each of ``some``, by matrix products of NEAR_ROWS at a time (ties: the first)."""
    mean = total / size[:, None]
    near, gap = np.empty(len(some), np.int64), np.empty(len(some))
    for a in range(0, len(some), NEAR_ROWS):
        mine = some[a : a + NEAR_ROWS]
        d = 1 - mean[mine] @ mean.T
        d[np.arange(len(mine)), mine] = np.inf
        near[a : a + NEAR_ROWS] = found = d.argmin(axis=1)
        gap[a : a + NEAR_ROWS] = d[np.arange(len(mine)), found]
    return near, gap


def _chained(total: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """The cluster that each cluster goes into (itself, or one before it), by a chain of nearest neighbours.

    The chain is followed until two clusters are each other's nearest, whatever ties there are; these are merged.
    """
    alive, into = np.ones(len(size), bool), np.arange(len(size))
    chain: list[int] = []
    waiting = list(range(len(size)))[::-1]
    while chain or waiting:
        if not chain:
            if alive[start := waiting.pop()]:
                chain.append(start)
            continue
        a = chain[-1]
        gap = 1 - (total @ total[a]) / (size * size[a])
        gap[~alive] = np.inf
        gap[a] = np.inf
        near = int(gap.argmin())
        if len(chain) > 1 and (gap[chain[-2]] <= gap[near] or near in chain):  # equal but for rounding
            near = chain[-2]
        if not gap[near] <= threshold:
            alive[a] = False  # nothing will ever come nearer to it: it is done
            chain.pop()
        elif len(chain) > 1 and near == chain[-2]:
            chain[-2:] = []
            keep, gone = min(a, near), max(a, near)
            total[keep] += total[gone]
            size[keep] += size[gone]
            alive[gone], into[gone] = False, keep
            waiting.append(keep)
        else:
            chain.append(near)
    return into


def average_linkage(x: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Labels from 0 (by first member) of average-linkage clusters under cosine distance, cut at the threshold.

    The mean distance between two clusters of unit vectors is 1 less the product of their mean vectors, so clusters are held
    as sums and no matrix of distances is. Merging brings no cluster nearer, so all pairs of each other's nearest may be merged
    at once, if they are under the cut. A cluster looks again only if its nearest one has changed, and one without a neighbour
    under the cut is done. Rounds end when they merge little (as with many copies); a chain merges what is left.
    """
    n = len(x)
    if n <= 1:
        return np.zeros(n, int)
    total = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    size, into, ids = np.ones(n), np.arange(n), np.arange(n)  # ids: a living cluster's least member
    near, gap = _nearest(total, size, ids)
    while len(ids) > 1:
        here = np.arange(len(ids))
        keep = np.flatnonzero((near[near] == here) & (here < near) & (gap <= threshold))
        if len(keep) * LITTLE < len(ids):
            into[ids] = ids[_chained(total, size, threshold)]
            break
        gone = near[keep]
        total[keep] += total[gone]
        size[keep] += size[gone]
        into[ids[gone]] = ids[keep]
        changed = np.zeros(len(ids), bool)
        changed[keep] = changed[gone] = True
        alive = gap <= threshold  # others have nothing under the cut, and never will
        alive[keep], alive[gone] = True, False
        stale = (changed | changed[near] | ~alive[near])[alive]
        place = np.cumsum(alive) - 1
        near, gap, total, size, ids = place[near[alive]], gap[alive], total[alive], size[alive], ids[alive]
        some = np.flatnonzero(stale)
        near[some], gap[some] = _nearest(total, size, some)
    for k in range(n):  # a cluster's number is its least member's, which comes before it
        into[k] = into[into[k]]
    return np.unique(into, return_inverse=True)[1]


def near_forest(vectors: DataFrame, key: str, id_col: str, vec_col: str, threshold: float) -> DataFrame:
    """(g, p, q): links that connect, inside a group, what pairs at most ``threshold`` apart connect: of each pair of blocks a forest."""
    rows = block_pairs(vectors, id_col, vec_col, key)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, a, b, own in zip(batch.column("g"), batch.column("a"), batch.column("b"), batch.column("own").to_pylist(), strict=True):
                (left, x), (right, y) = _vectors(a), _vectors(b)
                near = 1 - x @ y.T <= threshold
                both = near if own else np.block([[np.zeros((len(x), len(x)), bool), near], [near.T, np.zeros((len(y), len(y)), bool)]])
                ids = left if own else pa.concat_arrays([left, right])
                links, seen = [], np.zeros(len(ids), bool)
                for root in range(len(ids)):
                    edge = [] if seen[root] else [root]
                    seen[root] = True
                    while edge:
                        k = edge.pop()
                        new = np.flatnonzero(both[k] & ~seen)
                        seen[new] = True
                        links += [(k, int(j)) for j in new]
                        edge += new.tolist()
                p, q = (pa.array([e[side] for e in links], pa.int64()) for side in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * len(links), g.type), ids.take(p), ids.take(q)], ["g", "p", "q"])

    return rows.select("g", "a", "b", "own").mapInArrow(run, f"g {kinds['g']}, p {kind}, q {kind}")


def cluster(vectors: DataFrame, key: str, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.5, whole: int = WHOLE_GROUP) -> DataFrame:
    """(key, id, cluster): average-linkage clusters inside each group, numbered from 0 by their least ids.

    A group of up to ``whole`` vectors is one task's. In a larger one, clusters can only grow along pairs under the cut: two
    clusters whose mean distance is under it have such a pair. So the group is cut into the components of these pairs
    first, which are clustered each by itself. Rows without a vector have no cluster; an id stands for one row of its group.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("v is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        label = average_linkage(np.vstack(group["v"].to_numpy()).astype(float), threshold)
        return pd.DataFrame({"key": group["key"], "id": group["id"], "cluster": label})

    schema = f"key {kinds['key']}, id {kinds['id']}, cluster int"
    large = materialize(rows.groupBy(F.col("key").alias("l_key")).count().filter(F.col("count") > whole).select("l_key"), "large-groups")
    if large.isEmpty():
        return rows.groupBy("key").applyInPandas(run, schema).withColumnsRenamed({"key": key, "id": id_col})
    same = F.col("key").eqNullSafe(F.col("l_key"))
    small = rows.join(large, same, "left_anti").groupBy("key").applyInPandas(run, schema)

    some = materialize(rows.join(large, same, "left_semi"), "large-vectors")
    node = lambda c: F.struct(F.col("g").alias("key"), F.col(c).alias("id"))
    roots = components(near_forest(some, "key", "id", "v", threshold).select(node("p").alias("p"), node("q").alias("q")))
    placed = some.join(roots.select(F.col("node.key").alias("n_key"), F.col("node.id").alias("n_id"), "root"), F.col("key").eqNullSafe(F.col("n_key")) & (F.col("id") == F.col("n_id")), "left")
    placed = placed.select("key", "id", "v", F.coalesce("root", F.struct("key", "id")).alias("root"))
    alone = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = placed.join(alone, "root")
    parts = placed.filter("n > 1").groupBy("root").applyInPandas(run, schema).unionByName(placed.filter("n = 1").select("key", "id", F.lit(0).alias("cluster")))
    # a cluster of a component is known by its least id
    linked = placed.select("key", "id", "root").join(parts.withColumnsRenamed({"key": "p_key", "id": "p_id"}), F.col("key").eqNullSafe(F.col("p_key")) & (F.col("id") == F.col("p_id")))
    linked = materialize(linked.select("key", "id", "root", "cluster"), "cluster-parts")
    firsts = linked.groupBy("key", "root", "cluster").agg(F.min("id").alias("first"))
    number = numbered(firsts, [F.col("first")], by=["key"], out="number").select(F.col("key").alias("f_key"), F.col("root").alias("f_root"), F.col("cluster").alias("f_cluster"), (F.col("number") - 1).cast("int").alias("number"))
    found = linked.join(number, F.col("key").eqNullSafe(F.col("f_key")) & (F.col("root") == F.col("f_root")) & (F.col("cluster") == F.col("f_cluster")))
    found = found.select("key", "id", F.col("number").alias("cluster"))
    return small.unionByName(found).withColumnsRenamed({"key": key, "id": id_col})
