"""Hard-negative mining by one-dimensional distance keys, exact.

Vectors get one more component so that all have the same norm ``m``: then the distance of an anchor q (with 0 there) to a
row is sqrt(q.q + m*m - 2 * score), and the order by score is the order by distance. Each row belongs to its nearest
pivot, and rows are stored sorted by (pivot, distance to the pivot), in cells of consecutive rows. By the triangle
inequality a row at distance r of an anchor that is D away from a pivot has a key between D - r and D + r there. So a
search scans intervals of keys that grow with the radius, an annulus a round, and ends for an anchor when what it
has found bounds the distance that is left below what was not scanned. A search for scores in a band starts at the
annulus of the band's upper end.

How it runs: anchors travel in groups that are alike, cells as matrices. Which group needs which cell is a join of key
intervals on (pivot, bin of the key); a pair of a group and a cell is one matrix product in a task. Lists are merged by a
window whose limit is applied before its shuffle. Rounds are written to the shared folder. Pivots are fitted on
``sample_rows`` rows (those of least hash); everything else covers all rows, and results don't depend on the pivots.

Copies: equal rows (id, label and vector) count once. Of rows with equal labels and vectors only those of least ids can be
among the first, as many as the longest list and the anchor itself; batches and cells keep no more.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part; a null id is no anchor
and comes last among ties; shorter vectors count as padded with zeros; scores are exact while they stay below 2**53 (then
they are the nearest double's); anchors without positives or negatives give no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import bounded_batches, materialize


@dataclass(frozen=True)
class MiningConfig:
    scale: float = 256.0
    positives: int = 5
    negatives: int = 10
    #: Negatives' scores lie between these percentages of the positive's.
    least_percent: int = 30
    most_percent: int = 90
    pivots: int = 32
    sample_rows: int = 4096
    cell_rows: int = 1024
    group_rows: int = 256
    #: Ends of the rounds' annuli as shares of the common norm; a last round has no end.
    radii: tuple[float, ...] = (0.125, 0.5)
    bins: int = 32


# vectors


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles, shorter ones padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, summed row by row: equal vectors get equal distances in every batch."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], axis=1)) if len(x) else np.empty((0, len(pivots)))


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Means of a few rounds of k-means, started from rows that are far from each other."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    means = sample[chosen].copy()
    for _ in range(rounds):
        nearest = _distances(sample, means).argmin(1)
        for k in np.unique(nearest):
            means[k] = sample[nearest == k].mean(0)
    return means


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """A matrix of whole numbers in the smallest of three types."""
    kind = next((t for t in ("i2", "i4") if not x.size or np.abs(x).max() <= np.iinfo(t).max), "f8")
    return kind, np.ascontiguousarray(x, dtype=f"<{kind}").tobytes()


def _unpacked(kind: str, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<{kind}").reshape(n, -1).astype(np.float64)


def _first_copies(labels: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Indices of the rows that are among the first ``most`` of their label and vector by id (null ids, as the largest, last)."""
    keys = np.ascontiguousarray(np.column_stack([labels.astype(np.float64), x])).view(np.dtype((np.void, 8 * (x.shape[1] + 1)))).ravel()
    _, group = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
    order, g = order[fresh], g[fresh]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return np.sort(order[rank < most])


# the index


def _prepared(df: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: float) -> DataFrame:
    """(id, label, vec, anchor): the rows that take part, vectors as whole numbers."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    rows = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", sound))
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double"))).withColumn("anchor", F.col("anchor") & F.col("id").isNotNull())


def _measured(rows: DataFrame, config: MiningConfig) -> tuple[int, float, np.ndarray]:
    """Number of components, greatest squared norm, pivots."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    dims, top = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
    sample = rows.select("vec", F.xxhash64("id", "vec").alias("h")).orderBy("h").limit(config.sample_rows).select("vec").toArrow()["vec"].combine_chunks()
    found = _matrix(sample if isinstance(sample, pa.Array) else pa.array([], pa.list_(pa.float64())), dims)
    return dims, top, fit_pivots(_augmented(found, top), config.pivots)


def _keyed(rows: DataFrame, dims: int, top: float, pivots: np.ndarray, most: int) -> DataFrame:
    """(pivot, key, label, h, id, known, vec, anchor): rows with their keys; a batch's copies beyond the first ``most`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            known = np.array(ids.is_valid())
            number = np.where(known, ids.fill_null(0).to_numpy(zero_copy_only=False), np.iinfo(np.int64).max)
            x, label = _matrix(batch.column(2), dims), batch.column(1).to_numpy(zero_copy_only=False)
            anchor = np.array(batch.column(3))
            keep = np.union1d(_first_copies(label, number, x, most), np.flatnonzero(anchor))
            far = _distances(_augmented(x[keep], top), pivots)
            nearest = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(keep)), nearest]), *(batch.column(k).take(pa.array(keep)) for k in range(4))],
                names=["pivot", "key", "id", "label", "vec", "anchor"],
            )

    found = rows.select("id", "label", "vec", "anchor").mapInArrow(run, "pivot int, key double, id long, label long, vec array<double>, anchor boolean")
    return found.withColumn("h", F.xxhash64("vec"))


def _blocks(rows: DataFrame, dims: int, size: int, most: int, pivots: np.ndarray | None) -> DataFrame:
    """Rows in the order of their keys as blocks: of one pivot where pivots is None (cells), else with the distances of
    their rows to all pivots (groups of anchors)."""

    def block(number: int, held: list[tuple]) -> dict:
        x = np.zeros((len(held), dims))
        for k, row in enumerate(held):
            x[k, : len(row[6])] = row[6]
        kind, data = _packed(x)
        known = np.array([r[5] is not None for r in held])
        made = {
            "block": number, "n": len(held), "kind": kind, "vecs": data, "known": known.astype(np.uint8).tobytes(),
            "ids": np.array([0 if r[5] is None else r[5] for r in held], np.int64).tobytes(), "labels": np.array([r[2] for r in held], np.int64).tobytes(),
            "pivot": held[0][0], "lo": held[0][1], "hi": held[-1][1],
        }
        if pivots is not None:
            far = _distances(np.column_stack([x, np.zeros(len(x))]), pivots)
            made |= {"dmin": far.min(0).tolist(), "dmax": far.max(0).tolist(), "squares": (x * x).sum(1).tolist()}
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, run_of, copies, before = TaskContext.get().partitionId() << 32, [], None, 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before is not None and row[:4] == before[:4] and row[5:] == before[5:]:
                    continue  # an equal row
                copies = copies + 1 if row[:4] == run_of and row[6] == before[6] else 1
                run_of, before = row[:4], row
                if copies > most:
                    continue
                if held and (len(held) == size or (pivots is None and held[0][0] != row[0])):
                    yield pa.RecordBatch.from_pylist([block(number, held)], schema=arrow)
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([block(number, held)], schema=arrow)

    fields = [("block", pa.int64()), ("n", pa.int32()), ("kind", pa.string()), ("vecs", pa.binary()), ("known", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]
    schema = "block long, n int, kind string, vecs binary, known binary, ids binary, labels binary, pivot int, lo double, hi double"
    if pivots is not None:
        fields += [(c, pa.list_(pa.float64())) for c in ("dmin", "dmax", "squares")]
        schema += ", dmin array<double>, dmax array<double>, squares array<double>"
    arrow = pa.schema(fields)
    order = [F.col("pivot").asc(), F.col("key").asc(), F.col("label").asc(), F.col("h").asc(), F.col("id").asc_nulls_last()]
    rows = rows.select("pivot", "key", "label", "h", "anchor", "id", "vec")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


# the search


@dataclass(frozen=True)
class _Wanted:
    """What lists of an anchor take: rows of the same label or of others, so many; there are ``lists`` lists an anchor."""

    same: bool
    lists: int
    most: int


def _bounds(groups: DataFrame, wanted: DataFrame, state: DataFrame | None, what: _Wanted, top: float) -> DataFrame:
    """(block, lo, hi, floor, need, inner): for the lists of each group's anchors the scores that they take, times 100, the
    scores that full lists end with; the farthest distance that any of them still needs, and the nearest."""
    width = what.lists
    rows = groups.select("block", "n", "squares").join(wanted, "block")
    if state is None:
        rows = rows.withColumn("full", F.lit(None).cast("array<struct<a: int, l: int, score: double>>"))
    else:
        full = state.groupBy("block", "a", "l").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("score")).filter(F.col("held") == what.most)
        rows = rows.join(full.groupBy("block").agg(F.collect_list(F.struct("a", "l", "score")).alias("full")), "block", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for r in frame.itertuples():
                lo, hi = (np.array(x, float).reshape(r.n, width) for x in (r.lo, r.hi))
                floor = np.full((r.n, width), -np.inf)
                for e in r.full if r.full is not None else ():
                    floor[e["a"], e["l"]] = e["score"]
                least = np.maximum(lo / 100, floor)
                room = np.array(r.squares)[:, None] + top
                active = (lo <= hi) & (least <= hi / 100)
                far = np.where(active, np.sqrt(np.maximum(room - 2 * least, 0)), -1.0)
                near = np.where(active, np.sqrt(np.maximum(room - 2 * hi / 100, 0)), np.inf)
                made.append((r.block, lo.ravel().tolist(), hi.ravel().tolist(), floor.ravel().tolist(), float(far.max()), float(near.min())))
            yield pd.DataFrame(made, columns=["block", "lo", "hi", "floor", "need", "inner"])

    return materialize(rows.mapInPandas(run, "block long, lo array<double>, hi array<double>, floor array<double>, need double, inner double"), "mining-bounds")


def _pairs(groups: DataFrame, bounds: DataFrame, cells: DataFrame, since: float, until: float, norm: float, config: MiningConfig) -> DataFrame:
    """(block, cell): the cells whose least distance to a group lies in the annulus and is still needed."""
    slack, width = 1e-9 * (norm + 1), 2.5 * max(norm, 1.0) / config.bins
    bin_of = lambda c: F.floor(c / width).cast("int")
    each = groups.select("block", "dmin", "dmax").join(bounds.filter(F.col("need") >= since - slack).select("block", "need", "inner"), "block")
    each = each.select("block", "need", "inner", F.posexplode(F.arrays_zip("dmin", "dmax")).alias("pivot", "d"))
    each = each.select("block", "need", "inner", "pivot", F.col("d.dmin").alias("dmin"), F.col("d.dmax").alias("dmax"))
    reach = F.least(F.col("need") + slack, F.lit(until))
    each = each.withColumn("first", bin_of(F.greatest(F.col("dmin") - reach, F.lit(0.0)))).withColumn("end", bin_of(F.least(F.col("dmax") + reach, F.lit(3 * norm + 1))))
    each = each.withColumn("bin", F.explode(F.sequence("first", "end")))
    dealt = cells.select(F.col("block").alias("cell"), F.col("pivot").alias("c_pivot"), F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
    dealt = dealt.withColumn("c_first", bin_of(F.col("c_lo"))).withColumn("c_bin", F.explode(F.sequence("c_first", bin_of(F.col("c_hi")))))
    least = F.greatest(F.lit(0.0), F.col("c_lo") - F.col("dmax"), F.col("dmin") - F.col("c_hi"))
    found = each.join(dealt, (F.col("pivot") == F.col("c_pivot")) & (F.col("bin") == F.col("c_bin"))).filter(
        (F.col("bin") == F.greatest("first", "c_first"))  # once a pair
        & (least >= since) & (least < until) & (least <= F.col("need") + slack) & (F.col("c_hi") + F.col("dmax") >= F.col("inner") - slack)
    )
    return found.select("block", "cell")


def _score(what: _Wanted, held: int):
    """Of each pair of a group and a cell: (block, a, l, score, id, anchor_id) of the rows that may be among the first of a list."""
    names = ["block", "a", "l", "score", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            for r in batch.to_pylist():
                q, x = _unpacked(r["kind"], r["vecs"], r["n"]), _unpacked(r["c_kind"], r["c_vecs"], r["c_n"])
                score = q @ x.T
                same = np.frombuffer(r["labels"], np.int64)[:, None] == np.frombuffer(r["c_labels"], np.int64)[None, :]
                ids, known = np.frombuffer(r["c_ids"], np.int64), np.frombuffer(r["c_known"], np.uint8).astype(bool)
                allowed = same if what.same else ~same
                if what.same:  # an anchor's own row: same id, label and vector
                    me = np.argwhere((np.frombuffer(r["ids"], np.int64)[:, None] == ids[None, :]) & known[None, :] & same)
                    for a, b in me:
                        allowed[a, b] &= not (q[a] == x[b]).all()
                lo, hi, floor = (np.array(r[c], float).reshape(r["n"], what.lists) for c in ("lo", "hi", "floor"))
                floor = np.maximum(floor, floors.get(r["block"], -np.inf))
                parts, raised = [], floor.copy()
                for k in range(what.lists):
                    taken = np.where(allowed & (100 * score >= lo[:, k : k + 1]) & (100 * score <= hi[:, k : k + 1]) & (score >= floor[:, k : k + 1]), score, -np.inf)
                    if taken.shape[1] > what.most:
                        cut = np.partition(taken, -what.most, axis=1)[:, -what.most]
                        raised[:, k] = np.maximum(raised[:, k], cut)
                        taken = np.where(taken >= cut[:, None], taken, -np.inf)
                    a, b = np.nonzero(taken > -np.inf)
                    order = np.lexsort((ids[b], ~known[b], -taken[a, b], a))
                    a, b = a[order], b[order]
                    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, int)
                    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
                    a, b = a[rank < what.most], b[rank < what.most]
                    parts.append((a, np.full(len(a), k), taken[a, b], b))
                floors[r["block"]] = raised
                floors.move_to_end(r["block"])
                if len(floors) > held:
                    floors.popitem(last=False)
                a, k, s, b = (np.concatenate(c) for c in zip(*parts))
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), r["block"])), pa.array(a.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(s.astype(np.float64)), pa.array(ids[b], mask=~known[b])], names=names
                    )

    return run


def _search(groups: DataFrame, cells: DataFrame, wanted: DataFrame, what: _Wanted, norm: float, config: MiningConfig) -> DataFrame:
    """(block, a, l, score, id): the first rows of each list."""
    schema = "block long, a int, l int, score double, id long"
    state, since = None, 0.0
    matrices = ["kind", "vecs", "ids", "labels", "n"]
    there = cells.select(F.col("block").alias("cell"), *(F.col(c).alias(f"c_{c}") for c in (*matrices, "known")))
    first = Window.partitionBy("block", "a", "l").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    for until in [r * norm for r in config.radii] + [float("inf")]:
        bounds = _bounds(groups, wanted, state, what, norm * norm)
        pairs = materialize(_pairs(groups, bounds, cells, since, until, norm, config), "mining-pairs")
        since = until
        if pairs.isEmpty():
            continue
        rows = pairs.join(groups.select("block", *matrices), "block").join(bounds.select("block", "lo", "hi", "floor"), "block").join(there, "cell")
        found = rows.mapInArrow(_score(what, 64), schema)
        found = found if state is None else found.unionByName(state)
        found = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= what.most).drop("place")
        state = materialize(found, "mining-state")
    return groups.sparkSession.createDataFrame([], schema) if state is None else state


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, config: MiningConfig = MiningConfig()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    positives (rows of its label), the first rows of other labels whose scores lie in the band under the positive's."""
    bounded_batches(df.sparkSession)
    rows = _prepared(df, id_col, vector_col, F.col("label") if label is None else label, anchor, config.scale)
    dims, top, pivots = _measured(rows, config)
    norm, most = float(np.sqrt(top)), max(config.positives, config.negatives) + 1
    keyed = _keyed(rows, dims, top, pivots, most)
    cells = materialize(_blocks(keyed, dims, config.cell_rows, most, None), "mining-cells")
    # copies of an anchor are anchors of their own
    groups = materialize(_blocks(keyed.filter("anchor"), dims, config.group_rows, 1 << 62, pivots), "mining-anchors")

    every = lambda value, lists: F.array_repeat(F.lit(value), F.col("n") * lists)
    open_band = groups.select("block", every(float("-inf"), 1).alias("lo"), every(float("inf"), 1).alias("hi"))
    found = _search(groups, cells, open_band, _Wanted(True, 1, config.positives), norm, config)
    place = Window.partitionBy("block", "a").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    positives = materialize(found.select("block", "a", (F.row_number().over(place) - 1).alias("l"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "mining-positives")

    listed = positives.groupBy("block").agg(F.collect_list(F.struct("a", "l", "positive_score")).alias("held"))

    def bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for r in frame.itertuples():
                lo, hi = np.full((r.n, config.positives), np.inf), np.full((r.n, config.positives), -np.inf)
                for e in r.held:
                    lo[e["a"], e["l"]], hi[e["a"], e["l"]] = config.least_percent * e["positive_score"], config.most_percent * e["positive_score"]
                made.append((r.block, lo.ravel().tolist(), hi.ravel().tolist()))
            yield pd.DataFrame(made, columns=["block", "lo", "hi"])

    wanted = materialize(groups.select("block", "n").join(listed, "block").mapInPandas(bands, "block long, lo array<double>, hi array<double>"), "mining-bands")
    negatives = _search(groups, cells, wanted, _Wanted(False, config.positives, config.negatives), norm, config)

    ids = groups.select("block", "n", "ids").mapInPandas(_anchor_ids, "block long, a int, anchor_id long")
    order = Window.partitionBy("block", "a", "l").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    out = negatives.withColumn("rank", F.row_number().over(order)).join(positives, ["block", "a", "l"]).join(ids, ["block", "a"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("positive_score").cast("long"), F.col("score").cast("long").alias("negative_score"))


def _anchor_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples():
            yield pd.DataFrame({"block": r.block, "a": np.arange(r.n, dtype=np.int32), "anchor_id": np.frombuffer(r.ids, np.int64)})
