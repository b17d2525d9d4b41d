"""Decoding, clustering and ranks against plain forms."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import ctc, embed, ranks, vbx
from voxloom.operators.components import components


def all_readings(logp, blank=0):
    """Log-probability of each token string, over all paths."""
    found = {}
    for path in itertools.product(range(logp.shape[1]), repeat=len(logp)):
        tokens = tuple(t for k, t in enumerate(path) if t != blank and (k == 0 or path[k - 1] != t))
        found.setdefault(tokens, []).append(sum(logp[k, t] for k, t in enumerate(path)))
    return {k: float(np.logaddexp.reduce(v)) for k, v in found.items()}


@pytest.mark.parametrize("seed", range(5))
def test_beams_equal_all_paths(seed):
    rng = np.random.default_rng(seed)
    logp = np.array([ctc.log_softmax(3 * rng.normal(size=4)) for _ in range(6)])
    want = all_readings(logp, blank=seed % 4)
    beams = ctc.PrefixBeams(seed % 4, 10_000)
    for row in logp:
        beams.advance(row)
    got = beams.best(10_000)
    assert {tuple(t): round(s, 9) for s, t, _ in got} == {t: round(s, 9) for t, s in want.items() if s > -math.inf} and len(got) == len(want)
    narrow = ctc.PrefixBeams(seed % 4, 8)
    for row in logp:
        narrow.advance(row)
    assert all(s <= want[tuple(t)] + 1e-9 for s, t, _ in narrow.best(8)) and len(narrow.best(8)) == 8


def test_a_prefix_that_left_the_beams_comes_back_as_itself():
    beams = ctc.PrefixBeams(0, 3)
    rng = np.random.default_rng(9)
    for _ in range(200):
        beams.advance(ctc.log_softmax(rng.normal(size=5)))
        held = [tuple(t) for _, t, _ in beams.best(3)]
        assert len(set(held)) == len(held)


def test_nbest_of_chunks(spark):
    say = lambda token: [8.0 if k == token else 0.0 for k in range(4)]
    rows = [("x", k, say(t)) for k, t in enumerate([0, 1, 1, 0, 1, 3, 3, 2, 0])] + [("y", 0, None), ("z", 1, say(2)), ("z", 0, say(1))]
    found = ctc.nbest(spark.createDataFrame(rows, "chunk_id string, frame int, logits array<double>"), ["-", "a", "b", " "], best=2)
    got = {(r.chunk_id, r.rank): r for r in found.collect()}
    assert got["x", 0].text == "aa b" and [tuple(w) for w in got["x", 0].words] == [("aa", 1, 4), ("b", 7, 7)]
    assert got["y", 0].text == "" and got["y", 0].score == 0 and ("y", 1) not in got and got["z", 0].text == "ab"
    assert found.limit(0).count() == 0
    with pytest.raises(Exception, match="scores for 3 tokens"):
        ctc.nbest(spark.createDataFrame(rows, "chunk_id string, frame int, logits array<double>"), ["-", "a", "b"]).count()


def all_state_paths(logp, start, loop):
    """Responsibilities, expected entries by a jump and log-likelihood, over all paths of states and all choices to jump."""
    n, k = logp.shape
    gamma, entered, total = np.zeros((n, k)), np.zeros(k), 0.0
    for path in itertools.product(range(k), repeat=n):
        for jumps in itertools.product([False, True], repeat=n - 1):
            p = start[path[0]] * math.exp(logp[0, path[0]])
            for t, jump in enumerate(jumps, 1):
                p *= ((1 - loop) * start[path[t]] if jump else loop * (path[t] == path[t - 1])) * math.exp(logp[t, path[t]])
            total += p
            for t, s in enumerate(path):
                gamma[t, s] += p
            for t, jump in enumerate(jumps, 1):
                entered[path[t]] += p * jump
    return gamma / total, entered / total, math.log(total)


def test_chain_equals_all_paths():
    rng = np.random.default_rng(1)
    logp, start = rng.normal(size=(5, 3)), np.array([0.5, 0.3, 0.2])
    for got, want in zip(vbx.forward_backward(logp, start, 0.8), all_state_paths(logp, start, 0.8)):
        assert np.allclose(got, want)
    gamma, entered, total = vbx.forward_backward(logp[:1], start, 0.8)
    assert np.allclose(gamma.sum(), 1) and not entered.any() and total == pytest.approx(math.log((start * np.exp(logp[0])).sum()))


def test_speakers_are_found_and_the_bound_rises():
    rng = np.random.default_rng(2)
    between = np.array([30.0, 20.0, 10.0])
    means = rng.normal(size=(3, 3)) * np.sqrt(between)
    truth = np.repeat([0, 1, 0, 2, 1], 30)
    x = means[truth] + rng.normal(size=(150, 3))
    first = np.minimum(rng.integers(0, 6, 150), 5)
    first[::2] = truth[::2]
    gamma, bounds = vbx.variational_hmm(x, between, first, vbx.VbxConfig(fa=1.0, fb=1.0))
    assert all(b >= a - 1e-6 for a, b in zip(bounds, bounds[1:])) and len(bounds) > 2
    label = gamma.argmax(axis=1)
    assert all(len(set(label[truth == s])) == 1 for s in range(3)) and len(set(label)) == 3


def test_plda_space_and_records(spark):
    rng = np.random.default_rng(3)
    means = 6 * rng.normal(size=(4, 5))
    rows = [(i, (means[i // 10 % 4] + rng.normal(size=5)).tolist(), i // 10 % 4, f"r{i // 120}") for i in range(240)] + [(999, None, 1, "r1")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, record_id string")
    plda = embed.Plda.fit(df)
    mean, matrix, between = vbx.to_plda_space(plda)
    assert np.allclose(matrix.T @ plda.within @ matrix, np.eye(len(between))) and np.allclose(matrix.T @ plda.between @ matrix, np.diag(between))
    found = vbx.cluster(df, plda, config=vbx.VbxConfig(fa=1.0, fb=1.0, loop=0.9))
    got = {r.vec_id: (r.record_id, r.cluster) for r in found.collect()}
    assert len(got) == 240 and got[0][1] == 0
    assert all((got[i] == got[j]) == (i // 120 == j // 120 and rows[i][2] == rows[j][2]) for i in range(240) for j in range(240))
    assert vbx.cluster(df.limit(0), plda).count() == 0


def plain_linkage(x, threshold):
    """Merges the two nearest clusters while their mean distance is under the cut, all distances made anew each time."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    clusters = [[k] for k in range(len(x))]
    mean = lambda a, b: float(np.mean([1 - unit[i] @ unit[j] for i in a for j in b]))
    while len(clusters) > 1:
        d, i, j = min((mean(a, b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if d > threshold:
            break
        clusters[i] += clusters.pop(j)
    label = np.empty(len(x), int)
    for k, c in enumerate(sorted(clusters, key=min)):
        label[c] = k
    return label


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.7, 1.2, 3.0])
def test_linkage_equals_the_plain_form(threshold):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 12, 25):
        x = rng.normal(size=(n, 3))
        assert embed.average_linkage(x, threshold).tolist() == plain_linkage(x, threshold).tolist()
    same = np.tile(rng.normal(size=(1, 4)), (9, 1))
    assert embed.average_linkage(same, threshold).tolist() == [0] * 9 and embed.average_linkage(x[:0], threshold).tolist() == []


def test_large_groups_by_components(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(("hot" if i % 10 else "b") if i % 7 else None, i, rng.normal(size=3).tolist()) for i in range(160)] + [("hot", 500, None), ("b", 501, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, vec_id long, embedding array<double>")
    monkeypatch.setattr(embed, "BLOCK_ROWS", 16)
    want = {}
    for g in ("hot", "b", None):
        mine = sorted((i, v) for k, i, v in rows if k == g and v)
        want |= {(g, i): c for (i, _), c in zip(mine, plain_linkage(np.array([v for _, v in mine]), 0.04).tolist())}
    for whole in (0, 30, 10_000):
        got = {(r.g, r.vec_id): r.cluster for r in embed.cluster(df, "g", threshold=0.04, whole=whole).collect()}
        assert got == want
    pairs = {(r.id_a, r.id_b): r.cosine for r in embed.cosine_pairs(df, by="g", least=0.5).collect()}
    flat = [(g, i, np.array(v) / np.linalg.norm(v)) for g, i, v in rows if v]
    assert pairs == pytest.approx({(i, j): x @ y for g, i, x in flat for h, j, y in flat if g == h and i < j and x @ y >= 0.5})


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for p, q in links:
        if p != q:
            a, b = sorted((find(p), find(q)))
            root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "p long, q long")).collect()}
    assert got == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "p long, q long")).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_and_order_statistics(spark, partitions):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.choice([None, 1.5, 2.0, -3.0, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(3)
    got = {r.i: r.n for r in ranks.numbered(df, [F.col("x").desc_nulls_last(), F.col("i")], ["g"], "n", partitions).collect()}
    for g in ("hot", "a", "b", None):
        mine = sorted((x is None, -(x or 0), i) for k, i, x in rows if k == g)
        assert [got[i] for _, _, i in mine] == list(range(1, len(mine) + 1))
    whole = {r.i: r.number for r in ranks.numbered(df, [F.col("i").desc()]).collect()}
    assert whole == {i: 300 - i for i in range(300)}
    places = spark.createDataFrame([("hot", 1), ("hot", 10), ("a", 10_000), (None, 2)], "g string, place long")
    found = {(r.g, r.place): r.x for r in ranks.at_places(df, "x", places, ["g"]).collect()}
    values = lambda g: sorted(x for k, _, x in rows if k == g and x is not None)
    assert found == {("hot", 1): values("hot")[0], ("hot", 10): values("hot")[9], ("a", 10_000): None, (None, 2): values(None)[1]}
