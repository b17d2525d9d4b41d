"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are computed in one Arrow pass over whole texts. Distinct fingerprints are dealt into candidate
buckets, and the members of a bucket are compared bit-sliced: the fingerprints' bits are stored as vertical
planes (one machine word holds one bit of 64 fingerprints), plane by plane the differing bits are added into
carry-save counters, and a block of 64 comparisons is abandoned as soon as all of it exceeds the radius.

Two ways of dealing buckets:

* ``pigeonhole``: the bits are cut into radius+2 pieces, a bucket fixes all but ``radius`` of them, so no pair
  within the radius is lost (exact; for small radii);
* ``minhash``: bands of MinHash values of the same shingles (for similarity thresholds such as 0.8, where the
  radius is too large for the pigeonhole). Here the SimHashes only choose candidates, within a wide radius: the
  distinct shingles of all texts of a candidate component are compared, and exact Jaccard similarity decides.

Buckets of more than ``block_rows`` distinct fingerprints are cut into blocks, and each pair of blocks is
compared by a task of its own; nothing is capped or sampled. Out of a block only a spanning forest of its links
leaves, so links stay linear in the number of fingerprints. Components are found by alternating large-star and
small-star steps over written tables.

Edge cases: a null or wordless text has fingerprint zero; texts with fewer words than a shingle count as one
shingle; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import bounded_batches, free_name, materialize, maybe_broadcast

SEED = 42
BLOCK_ROWS = 8192
#: Sets and hashes of a block where candidates are verified.
VERIFY_ROWS = 4096
VERIFY_HASHES = 1_000_000
#: Odd multipliers that derive further hash words from a shingle's hash.
WORD_MIX = 0x9E3779B97F4A7C15
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``width`` words, A-Z lower-cased, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(s, SEED) for s in shingles], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    if n == 1:
        return int(hashes[0])
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 96:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, b], minlength=256) @ _BITS for b in range(8)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _mix(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from each hash (word 0: the hash itself)."""
    if word == 0:
        return h
    h = h + np.uint64(WORD_MIX * word % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """One 64-bit key a band of ``rows`` MinHash values; an empty text has the same keys as any other empty text.

    A value is the least of the hashes under one of ``bands * rows`` mixings; a few hundred hashes are mixed in all ways at once.
    """
    if not len(hashes):
        return [0] * bands
    salts = _salts(bands * rows)
    mins = np.full(len(salts), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        h = hashes[None, at : at + 512] ^ salts[:, None]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        np.minimum(mins, h.min(axis=1), out=mins)
    mins = mins.astype("<u8").reshape(bands, rows)
    return [xxhash.xxh64_intdigest(m.tobytes(), b) - 2**63 for b, m in enumerate(mins)]


@functools.cache
def _salts(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"minhash", i) for i in range(n)], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    """(id, w0.. w{words-1} long): SimHash of whole texts, ``words`` times 64 bits."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                h = shingle_hashes(text, width)
                rows.append([majority_bits(_mix(h, w)) for w in range(words)])
            fp = np.array(rows, np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fp[:, w]) for w in range(words))], ["id", *(f"w{w}" for w in range(words))])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"w{w} long" for w in range(words))
    return rows.mapInArrow(run, schema)


class BitSliced:
    """Vertical bit planes of fingerprints, and their comparison with the same fingerprints shifted by some lanes."""

    def __init__(self, words: np.ndarray, radius: int):
        """words: (lanes, fingerprint words) uint64."""
        self.n, self.radius = len(words), radius
        self.levels = max(3, radius.bit_length() + 1)
        pad = -self.n % 64 + 64
        octets = np.vstack([words, np.zeros((pad, words.shape[1]), np.uint64)]).astype("<u8").view(np.uint8)
        bits = np.unpackbits(octets, axis=1, bitorder="little")
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")

    def _differing(self, first: int, last: int, at: np.ndarray, skip: int, shift: int) -> np.ndarray:
        planes = self.planes[first:last]
        other = planes[:, np.minimum(at + skip, planes.shape[1] - 1)]
        if shift:
            nxt = planes[:, np.minimum(at + skip + 1, planes.shape[1] - 1)]
            other = (other >> np.uint64(shift)) | (nxt << np.uint64(64 - shift))
        return planes[:, at] ^ other

    def within(self, distance: int, alive: np.ndarray) -> np.ndarray:
        """Lanes i of ``alive`` whose fingerprint differs from that of lane i+distance in at most radius bits."""
        flags = np.packbits(np.concatenate([alive, np.zeros(-len(alive) % 64, bool)]), bitorder="little").view("<u8")
        at = np.flatnonzero(flags)
        live = flags[at]
        skip, shift = divmod(distance, 64)
        count = np.zeros((self.levels, len(at)), np.uint64)
        over = np.zeros(len(at), np.uint64)
        total = len(self.planes)
        for first in range(0, total, 7):
            x = self._differing(first, min(first + 7, total), at, skip, shift)
            for low, carry, high in _compressed(x):
                for level, plane in enumerate((low, carry, high)):
                    for k in range(level, self.levels):
                        if plane is None:
                            break
                        count[k], plane = count[k] ^ plane, count[k] & plane
                    if plane is not None:
                        over |= plane
            keep = live & ~(over | self._exceeds(count))
            some = keep != 0
            if not some.all():
                at, live, count, over = at[some], keep[some], count[:, some], over[some]
                if not len(at):
                    return np.empty(0, np.int64)
            else:
                live = keep
        bits = np.unpackbits(live.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, lane = np.nonzero(bits)
        return at[word] * 64 + lane

    def _exceeds(self, count: np.ndarray) -> np.ndarray:
        """Lanes whose counter is over the radius, compared from the highest level down."""
        more = np.zeros(count.shape[1], np.uint64)
        same = ~more
        for k in range(self.levels - 1, -1, -1):
            if self.radius >> k & 1:
                same &= count[k]
            else:
                more |= same & count[k]
                same &= ~count[k]
        return more


def _full_add(a, b, c):
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _compressed(x: np.ndarray):
    """Seven planes as one three-bit number a lane (carry-save); fewer planes one by one."""
    if len(x) < 7:
        return [(p, None, None) for p in x]
    s1, c1 = _full_add(x[0], x[1], x[2])
    s2, c2 = _full_add(x[3], x[4], x[5])
    low, c3 = _full_add(s1, s2, x[6])
    mid, high = _full_add(c1, c2, c3)
    return [(low, mid, high)]


def block_classes(keys: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """For each row the least row number that links among rows of equal key connect it to; keys come sorted."""
    n = len(keys)
    label = np.arange(n)
    sliced = BitSliced(words, radius)
    for distance in range(1, n):
        together = keys[:-distance] == keys[distance:]
        if not together.any():
            break
        alive = together & (label[:-distance] != label[distance:])
        if not alive.any():
            continue
        for i in sliced.within(distance, alive):
            a, b = label[i], label[i + distance]
            if a != b:
                label[label == max(a, b)] = min(a, b)
    return label


def _compare(words: int, radius: int, buffer_rows: int):
    """Over rows (key, block, id, w0..) sorted by key and block: links (a, b) of ids, bucket after bucket."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        keys = table.column("cell").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], table.column("id").to_numpy()[order]
        same = keys[1:] == keys[:-1]
        paired = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        fp = np.column_stack([table.column(f"w{w}").to_numpy()[order].view(np.uint64) for w in range(words)])
        keys, ids, fp = keys[paired], ids[paired], fp[paired]
        label = block_classes(keys, fp, radius) if len(keys) else np.empty(0, np.int64)
        # a class leaves as a star around its least id: chains would take components() many rounds
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        a, b = least[label], ids
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows + batch.num_rows >= buffer_rows:  # cut where a bucket ends
                keys = batch.column(0).to_numpy()
                ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                if held and held[-1].column(0)[-1].as_py() != keys[0]:
                    ends = np.concatenate([[0], ends])
                if len(ends):
                    cut = int(ends[-1])
                    if cut:
                        held.append(batch.slice(0, cut))
                    yield flush(held)
                    held, batch = [], batch.slice(cut)
                    rows = 0
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield flush(held)

    return run


def link_forest(nodes: DataFrame, keys: Column, words: int, radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that connect what links of at most ``radius`` bits connect within the buckets of ``keys``.

    nodes: (id, w0.., and what ``keys``, an array of long, needs), one row a distinct fingerprint.
    """
    cols = ["id", *(f"w{w}" for w in range(words))]
    dealt = nodes.select(F.explode(keys).alias("key"), *cols)
    hot = dealt.groupBy("key").count().filter(F.col("count") > block_rows)
    hot = materialize(hot.select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "simhash-hot")
    n_hot = hot.count()
    if n_hot:
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        cells = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least("own", j), F.greatest("own", j))
        )
        dealt = (
            dealt.join(maybe_broadcast(hot, n_hot, 50_000), "key", "left")
            .withColumn("own", F.when(F.col("blocks").isNotNull(), own))
            .select(F.explode(F.when(F.col("own").isNotNull(), F.array_distinct(cells)).otherwise(F.array("key"))).alias("cell"), *cols)
        )
    else:
        dealt = dealt.withColumnRenamed("key", "cell")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_compare(words, radius, 4 * block_rows), "a long, b long").distinct()


def pigeonhole_keys(word: Column, radius: int) -> Column:
    """Keys of a 64-bit fingerprint: two within ``radius`` bits share at least one. All but radius of radius+2 pieces are fixed."""
    pieces = radius + 2
    edges = [64 * i // pieces for i in range(pieces + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(edges)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(pieces), pieces - radius)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - 2**64 if mask >= 2**63 else mask
        keys.append(F.xxhash64(F.lit(number), word.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, root): the smallest id reachable, for each id that has a link. Alternating large-star and small-star steps."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(low, "a")
        if large:
            moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return moved.filter(F.col("a") != F.col("b")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = materialize(star(star(edges, True), False), "cc")
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id): fingerprints of 64 bits linked at ``radius`` or fewer differing bits."""
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = materialize(prints.groupBy(F.col("w0").alias("id")).agg(F.min("id").alias("rep")).withColumn("w0", F.col("id")), "simhash-nodes")
    links = link_forest(nodes, pigeonhole_keys(F.col("w0"), radius), 1, radius)
    roots = components(links)
    placed = materialize(nodes.join(roots, "id", "left").select(F.col("id").alias("fp"), "rep", F.coalesce("root", "id").alias("root")), "simhash-roots")
    lows = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(lows, "root").select("fp", "component_id")
    return (
        prints.select(F.col("id").alias("doc_id"), F.col("w0").alias("fp"))
        .join(named, "fp")
        .select("doc_id", "fp", "component_id")
    )


def similar_radius(similarity: float, bits: int, sigmas: float = 7.0) -> int:
    """Differing bits expected at a Jaccard similarity of equally large sets, plus ``sigmas`` standard deviations.

    Seven, as the expectation is that of large sets: for 4 shingles against 5 at 0.8 it is a quarter higher.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + sigmas * math.sqrt(bits * share * (1 - share)))


def similar_classes(hashes: np.ndarray, starts: np.ndarray, similarity: float) -> np.ndarray:
    """For each set the least number among those that links of exact Jaccard ``similarity`` or more connect it to.

    Set i is hashes[starts[i] : starts[i + 1]], distinct and not empty.
    """
    sizes = np.diff(starts)
    n = len(sizes)
    label = np.arange(n)
    vocabulary, codes = np.unique(hashes, return_inverse=True)
    mark = np.zeros(len(vocabulary), bool)
    for i in range(n - 1):
        low, high = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        open_ = (label[i + 1 :] != label[i]) & (low / high >= similarity)
        if not open_.any():
            continue
        own = codes[starts[i] : starts[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[codes[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1], dtype=np.int64)
        mark[own] = False
        for j in i + 1 + np.flatnonzero(open_ & (common / (low + high - common) >= similarity)):
            x, y = label[i], label[j]
            if x != y:
                label[label == max(x, y)] = min(x, y)
    return label


def _verify(similarity: float):
    """Over rows (cell, id, hashes) sorted by cell: links (a, b) of ids whose shingle sets are alike, cell after cell."""

    def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        a = b = np.empty(0, np.int64)
        if len(ids) > 1:
            label = similar_classes(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), similarity)
            b = np.array(ids, np.int64)
            least = np.full(len(b), np.iinfo(np.int64).max)
            np.minimum.at(least, label, b)
            a = least[label]
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, sets = None, [], []
        for batch in batches:
            for at, key, hashes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at != cell:
                    if len(ids) > 1:
                        yield links(ids, sets)
                    cell, ids, sets = at, [], []
                if hashes:
                    ids.append(key)
                    sets.append(np.frombuffer(hashes, np.uint64))
        yield links(ids, sets)

    return run


def _row_key(docs: DataFrame) -> list[Column]:
    """Two hashes (k0, k1) of all columns that can be hashed: what tells rows apart, whatever their ids."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(*cols).alias("k0"), F.xxhash64(F.lit("second"), *cols).alias("k1")]


def _set_hashes(width: int):
    """Over rows (cells, id, text): (cells, id, the text's distinct shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)).tobytes() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["cells", "id", "hashes"])

    return run


def _exact_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """Links (a, b) of exact similarity within the candidate components (id, root).

    All pairs of a component are compared, those that share a class already excepted. Components of more than
    VERIFY_ROWS sets or VERIFY_HASHES hashes are cut into blocks, and each pair of blocks is a cell of its own.
    """
    placed = materialize(nodes.select("id", "n", "k0", "k1").join(candidates, "id"), "neardup-candidates")
    total = placed.groupBy("root").agg(F.greatest(F.count(F.lit(1)) / VERIFY_ROWS, F.sum("n") / VERIFY_HASHES).alias("parts"))
    hot = materialize(total.filter("parts > 1").select("root", F.ceil("parts").cast("int").alias("blocks")), "neardup-hot")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("root", F.least("own", j), F.greatest("own", j)))
    picks = (
        placed.join(maybe_broadcast(hot, hot.count(), 50_000), "root", "left")
        .withColumn("own", F.when(F.col("blocks").isNotNull(), own))
        .select("k0", "k1", "id", F.when(F.col("own").isNotNull(), F.array_distinct(cells)).otherwise(F.array("root")).alias("cells"))
    )
    texts = docs.select(*_row_key(docs), F.col(text_col).cast("string").alias("text"))
    sets = (
        texts.join(maybe_broadcast(picks, placed.count(), 200_000), ["k0", "k1"])
        .select("cells", "id", "text")
        .mapInArrow(_set_hashes(width), "cells array<long>, id long, hashes binary")
        .dropDuplicates(["id"])
        .select(F.explode("cells").alias("cell"), "id", "hashes")
    )
    dealt = sets.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_verify(similarity), "a long, b long").distinct()


def near_duplicate_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, words: int = 8,
    bands: int = 14, band_rows: int = 4,
) -> DataFrame:
    """(id, k0, k1, root), a row for each of docs: texts that links of exact shingle similarity connect have one root.

    A link joins two texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more.
    Candidates share one of ``bands`` bands of ``band_rows`` MinHash values (at a similarity of 0.8, 99.9 % of the pairs
    do with the defaults) and have ``64*words``-bit SimHashes of at most ``similar_radius`` differing bits; their
    components are then compared set by set. Texts of one shingle set are one node, whose id is a hash of the set.
    """
    bounded_batches(docs.sparkSession)
    prints = materialize(_set_prints(docs, id_col, text_col, width, words, bands, band_rows), "neardup")
    fp = [f"w{w}" for w in range(words)]
    one = F.min(F.struct("k0", "k1")).alias("row")
    nodes = prints.groupBy(F.col("node").alias("id")).agg(one, F.first("n").alias("n"), *(F.first(c).alias(c) for c in [*fp, "keys"]))
    nodes = materialize(nodes.select("id", "row.k0", "row.k1", "n", *fp, "keys"), "neardup-nodes")
    links = link_forest(nodes.filter("n > 0"), F.col("keys"), words, similar_radius(similarity, 64 * words))
    candidates = components(links)
    roots = materialize(components(_exact_links(docs, nodes, candidates, text_col, width, similarity)), "neardup-roots")
    roots = maybe_broadcast(roots.withColumnRenamed("id", "node"), roots.count(), 200_000)
    return prints.select("id", "k0", "k1", "node").join(roots, "node", "left").select("id", "k0", "k1", F.coalesce("root", "node").alias("root"))


def _set_prints(docs: DataFrame, id_col: str, text_col: str, width: int, words: int, bands: int, band_rows: int) -> DataFrame:
    """(id, k0, k1, node, n, w0.., keys): hash and size of each row's set of shingles, its SimHash and its MinHash bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, nodes, sizes = [], [], [], []
            for text in batch.column(3).cast(pa.binary()).to_pylist():
                h = np.unique(shingle_hashes(text, width))
                rows.append([majority_bits(_mix(h, w)) for w in range(words)])
                keys.append(band_keys(h, bands, band_rows))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) - 2**63)
                sizes.append(len(h))
            fp = np.array(rows, np.uint64).reshape(-1, words).view(np.int64)
            cols = [*batch.columns[:3], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(fp[:, w]) for w in range(words))]
            names = ["id", "k0", "k1", "node", "n", *(f"w{w}" for w in range(words)), "keys"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(keys, pa.list_(pa.int64()))], names)

    rows = docs.select(F.col(id_col).alias("id"), *_row_key(docs), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, k0 long, k1 long, node long, n long, " + "".join(f"w{w} long, " for w in range(words)) + "keys array<long>"
    return rows.mapInArrow(run, schema)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class of ``near_duplicate_rows``: that of the smallest id, null ids last, then of the least row hash.

    A row goes only where its own text is in the class of a row that stays, whatever rows share its id.
    """
    rows = materialize(near_duplicate_rows(docs, id_col, text_col, **options), "neardup-rows")
    n0, n1 = free_name(docs, "k0"), free_name(docs, "k1")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k0", "k1")).alias("row"))
    gone = rows.join(first.select("row.k0", "row.k1"), ["k0", "k1"], "left_anti").select(F.col("k0").alias(n0), F.col("k1").alias(n1)).distinct()
    k0, k1 = _row_key(docs)
    named = docs.select("*", k0.alias(n0), k1.alias(n1))
    return named.join(gone, [n0, n1], "left_anti").dropDuplicates([n0, n1]).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, group_id), a row for each of docs: group_id is the smallest id of the row's class in ``near_duplicate_rows``."""
    rows = materialize(near_duplicate_rows(docs, id_col, text_col, **options), "neardup-rows")
    named = rows.groupBy("root").agg(F.min("id").alias("group_id"))
    return rows.join(named, "root").select(F.col("id").alias(id_col), "group_id")
