"""The language model of any order against a plain form, and its files."""

import glob
import math
import random
from collections import Counter, defaultdict

import pytest

from voxloom.operators import ngram_model
from voxloom.sources.shared import scratch

TEXTS = "id long, text string"


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["la", "casa", "es", "muy", "grande", "y", "no", "sé"]
    return [(i, " ".join(rng.choices(words, [8, 4, 4, 2, 2, 2, 1, 1], k=rng.randint(0, 9)))) for i in range(n)] + [(900, None), (901, ""), (902, "la la la la la")]


class Plain:
    """Interpolated probabilities by their definition, from dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        said = [("<s>", *t.split(), "</s>") for t in texts if t is not None]
        self.counts = [None] * (order + 1)
        for n in range(order, 0, -1):
            if n == order:
                self.counts[n] = Counter(w[i : i + n] for w in said for i in range(len(w) - n + 1))
            else:
                self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
                if n > 1:
                    self.counts[n] += Counter(w[:n] for w in said if len(w) >= n)
        self.cuts = [None] + [self.cut(n) for n in range(1, order + 1)]
        self.follow = [None] + [defaultdict(list) for _ in range(order)]
        for n in range(1, order + 1):
            for g, c in self.counts[n].items():
                self.follow[n][g[:-1]].append((c, self.less(n, c)))

    def cut(self, n):
        a, b, c, d = (sum(v == k for v in self.counts[n].values()) for k in (1, 2, 3, 4))
        if not (a and b and c and d):
            return (0.5, 1.0, 1.5)
        y = a / (a + 2 * b)
        found = (1 - 2 * y * b / a, 2 - 3 * y * c / b, 3 - 4 * y * d / c)
        return found if all(0 <= x <= k for k, x in enumerate(found, 1)) else (0.5, 1.0, 1.5)

    def less(self, n, c):
        return self.cuts[n][min(c, 3) - 1]

    def p(self, gram):
        """Of gram's last word after the others, known or not."""
        n = len(gram)
        if n == 0:
            return 1 / (len(self.counts[1]) + 1)
        after = self.follow[n].get(gram[:-1])
        if not after:
            return self.p(gram[1:])
        total, lost = sum(c for c, _ in after), sum(d for _, d in after)
        c = self.counts[n].get(gram, 0)
        return (c - self.less(n, c) if c else 0) / total + lost / total * self.p(gram[1:])

    def text(self, t):
        w = ("<s>", *t.split(), "</s>")
        return sum(math.log10(self.p(w[max(0, i - self.order + 1) : i + 1])) for i in range(1, len(w)))


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_model_equals_the_plain_form(spark, order):
    rows = corpus(order)
    model = ngram_model.train(spark.createDataFrame(rows, TEXTS), order)
    plain = Plain([t for _, t in rows], order)
    held = {r.gram: r for r in model.collect()}
    assert {tuple(g.split(" ")) for g in held} == {g for n in range(1, order + 1) for g in plain.counts[n]} | {("<unk>",), ("<s>",)}
    for gram, r in held.items():
        words = tuple(gram.split(" "))
        assert r.n == len(words) and (gram in ("<s>", "<unk>") or 10**r.logp == pytest.approx(plain.p(words)))
    asked = [(i, t) for i, (_, t) in enumerate(corpus(99, 12))] + [(50, "casa casa zebra la"), (51, "zebra"), (52, "y no sé " * 300)]
    want = {i: plain.text(t) for i, t in asked if t is not None}
    path = scratch(spark, "arpa")
    ngram_model.write_arpa(model, path)
    for known in (model, ngram_model.read_arpa(spark, path)):
        got = {r.id: r for r in ngram_model.score(known, spark.createDataFrame(asked, TEXTS), "id").collect()}
        assert {i: r.lm for i, r in got.items()} == pytest.approx(want, rel=1e-6) and got[50].unknown == 1 and got[52].unknown == 0


def test_probabilities_add_up(spark):
    plain = Plain([t for _, t in corpus(3)], 3)
    model = {r.gram: r for r in ngram_model.train(spark.createDataFrame(corpus(3), TEXTS), 3).collect()}
    for context, r in model.items():
        if r.backoff is not None and r.n == 2:
            words = tuple(context.split(" "))
            known = [g for g in model if g.startswith(context + " ") and model[g].n == 3]
            rest = sum(plain.p((words[1], g[0])) for g in plain.counts[1] if f"{context} {g[0]}" not in model) + plain.p((words[1], "?"))
            assert sum(10 ** model[g].logp for g in known) + 10**r.backoff * rest == pytest.approx(1)


def test_file_is_an_arpa_file(spark):
    path = scratch(spark, "arpa")
    ngram_model.write_arpa(ngram_model.train(spark.createDataFrame(corpus(4), TEXTS), 3).repartition(5), path)
    parts = sorted(glob.glob(path.removeprefix("file://") + "/part-*"))
    lines = [line.rstrip("\n") for part in parts for line in open(part, encoding="utf-8")]
    assert lines[0] == "\\data\\" and lines[-1] == "\\end\\" and [x for x in lines if x.endswith("-grams:")] == [f"\\{n}-grams:" for n in (1, 2, 3)]
    for n in (1, 2, 3):
        start = lines.index(f"\\{n}-grams:") + 1
        entries = lines[start : lines.index("", start)]
        assert f"ngram {n}={len(entries)}" in lines and all(len(e.split("\t")[1].split(" ")) == n for e in entries)
        assert [e.split("\t")[1] for e in entries] == sorted((e.split("\t")[1] for e in entries), key=str.encode)


def test_model_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], TEXTS)
    model = ngram_model.train(none, 3)
    assert {r.gram: r.logp for r in model.collect()} == {"<unk>": 0.0, "<s>": -99.0}
    assert ngram_model.score(model, none, "id").count() == 0
