"""The training-data operators against brute force, libraries and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxloom.llm import audio, bpe, langid, license_scan, mixing, quality, queries, simhash, suffix_dedup, toxicity, url_filter

EDGE = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one"), (5, "漢字 🙂 \x1c\x85 ñ"), (6, "x" * 50_000), (7, "word " * 30_000)]


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def random_texts(seed, n, words=("the", "of", "and", "to", "in", "lorem", "ipsum", "ñu", "漢字")):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.4:
                p, a = rng.choice(passages), rng.randint(0, 80)
                parts.append(p[a : a + rng.randint(50, 260)])
            elif kind < 0.5:
                parts.append(rng.choice(["a", "b ", "abc"]) * rng.randint(90, 300))
            else:
                parts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))))
        out.append(" ".join(parts))
    return out


# 1 language


def test_language_id(spark):
    rng = random.Random(2)
    stems = {"en": "the of thing and with", "de": "der und schön nicht ein", "fr": "le être été que aux", "es": "el niño que está los"}
    rows = []
    for i in range(400):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join(rng.choice(stems[lang].split()) for _ in range(20)), lang))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", None), (1003, "ñ" * 20_000, None)]
    df = docs_of(spark, rows, "doc_id long, text string, lang string")
    model = langid.train(df.filter("doc_id % 4 <> 2"))
    assert model.families == ["germanic", "romance"] and [p[:2] for p in model.pairs] == [("de", "en"), ("es", "fr")]
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    tested = [r for r in rows if r[0] < 1000 and r[0] % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang in tested) >= 0.99 * len(tested)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(df.limit(0), model).count() == 0
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}


def slow_language(model, text):
    """Language and score by plain loops: every n-gram of the normalised bytes counted by itself."""
    data = b" " + b" ".join(bytes(b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in text.lower().encode()).split()) + b" "
    x = [0.0] * langid.DIMS
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            code = sum(c << 8 * k for k, c in enumerate(data[i : i + n]))
            x[(code * 2654435761 % 2**32) >> (33 - langid.DIMS.bit_length())] += 1
    x = np.sqrt(x)
    x /= np.linalg.norm(x)
    chance = lambda w, scale: 1 / (1 + math.exp(-(scale[0] * (x @ w[:-1] + w[-1]) + scale[1])))
    by_family = [chance(w, s) for w, s in zip(model.family_w, model.family_scale)]
    best = by_family.index(max(by_family))
    members = [lang for lang in model.langs if langid.family_of(lang) == model.families[best]]
    wins, least = Counter(), {m: 1.0 for m in members}
    for a, b, w, scale in model.pairs:
        if a in members:
            wins[a if x @ w[:-1] + w[-1] > 0 else b] += 1
            p = chance(w, scale)
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
    lang = max(members, key=lambda m: wins[m])
    return lang, by_family[best] / sum(by_family) * least[lang]


def test_language_equals_brute_force(spark):
    rng = random.Random(3)
    stems = {"en": "the of thing and with", "de": "der und schön nicht ein", "fr": "le être été que aux", "es": "el niño que está los"}
    rows = [(i, " ".join(rng.choice(stems[g].split()) for _ in range(rng.randint(1, 9))), g) for i in range(300) for g in [rng.choice(list(stems))]]
    model = langid.train(docs_of(spark, rows, "doc_id long, text string, lang string"))
    odd = [t for _, t, _ in rows[:40]] + ["The der, LE el!", "ñ", "漢字", "a" * 5000, "que que que", "que que que"]
    df = docs_of(spark, [(None if i % 2 else str(i), t, 7.0) for i, t in enumerate(odd)], "doc_id string, text string, score double")
    got = langid.identify(df, model).collect()
    for t, r in zip(odd, got):
        lang, score = slow_language(model, t)
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3, abs=1e-5), t[:50]
    assert (got[-1].lang_pred, got[-1].score) == (got[-2].lang_pred, got[-2].score)


# 2 simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [8192, 4])
def test_simhash_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(simhash.link_forest, "__defaults__", (block,))
    texts = random_texts(1, 80) + ["Alpha BETA gamma delta " * 8 + x for x in ("one", "two", "one two", "x y z")] * 3
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in EDGE]
    want = {i: slow_fingerprint(t) for i, t in rows}
    comps = slow_components(want, 2)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicate_classes(docs_of(spark, rows)).collect()}
    assert got == {i: (want[i], comps[i]) for i in want}


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, (300, 4)).astype(np.uint64)
    x[1::2] = x[::2] ^ (rng.integers(0, 2**20, (150, 4)).astype(np.uint64))
    for radius in (2, 20, 40):
        s = simhash.BitSliced(x, radius)
        for d in (1, 2, 64, 70):
            alive = rng.random(300 - d) < 0.7
            want = [i for i in np.flatnonzero(alive) if np.bitwise_count(x[i] ^ x[i + d]).sum() <= radius]
            assert s.within(d, alive).tolist() == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.root for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert simhash.components(links.limit(0)).count() == 0


def test_near_duplicates_at_08(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, near, far = [], [], []
    for k in range(30):
        base = [word() for _ in range(300)]
        close, other = list(base), list(base)
        for p in rng.sample(range(300), 2):
            close[p] = word()
        for p in rng.sample(range(300), 60):
            other[p] = word()
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(close)), (3 * k + 2, " ".join(other))]
        near.append((3 * k, 3 * k + 1))
        far.append((3 * k, 3 * k + 2))
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs_of(spark, rows)).collect()}
    assert all(got[a] == got[b] for a, b in near) and not any(got[a] == got[b] for a, b in far)
    edge = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs_of(spark, EDGE)).collect()}
    assert edge[3] == edge[4] == 3 and edge[0] == edge[1] == edge[2] == 0 and edge[6] == 6


def test_exact_similarity_decides(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(240):  # similarities from 0.6 to 1
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        other = list(base)
        spread = rng.uniform(0.01, 0.15) * len(base)
        at = rng.randrange(len(base) - int(spread))
        other[at : at + int(spread)] = [word() for _ in range(int(spread))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    base = [word() for _ in range(104)]
    again = [w for i in range(0, 100, 5) for w in base[i : i + 5] * (4 if i < 20 else 1)] + base[100:]
    rows += [(1000, " ".join(base)), (1001, " ".join(again)), (1002, " ".join(base[:100] + base[:60] * 3))]
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in shingles}
    for a in shingles:
        for b in shingles:
            if a < b and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    assert 60 < sum(root[i] != i for i in root) < 200
    for block in (4096, 3):
        monkeypatch.setattr(simhash, "VERIFY_ROWS", block, raising=False)
        got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs_of(spark, rows)).collect()}
        assert got == root


def test_exact_classes_in_blocks(spark, monkeypatch):
    rng = random.Random(22)
    base = [str(rng.random()) for _ in range(80)]
    rows = []
    for i in range(60):  # a chain: neighbours are alike, the ends are not
        base[i] = str(rng.random())
        rows.append((i, " ".join(base)))
    for limit in ("VERIFY_ROWS", "VERIFY_HASHES"):
        with monkeypatch.context() as m:
            m.setattr(simhash, limit, 7 if limit == "VERIFY_ROWS" else 500)
            assert {r.group_id for r in simhash.near_duplicate_groups(docs_of(spark, rows)).collect()} == {0}


# 3 licenses


def test_licenses_are_found_and_inherited(spark):
    files = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/x.py", "print(1)"), ("a/b/LICENSE", "Released under the MIT License."),
        ("a/y.py", None), ("z/w.py", ""), ("a/b/own.py", "text " * 50 + "\nLicensed under CC BY-NC 4.0.\nmore"), (None, "x"), ("top.py", "Nothing is said about licensing cats here."),
    ]
    got = {r.path: (r.license, r.license_from, r.effective_license) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/b/c/x.py"] == (None, "a/b/LICENSE", "MIT") and got["a/y.py"] == (None, "a/LICENSE", "Apache-2.0")
    assert got["a/b/own.py"][2] == "CC-BY-NC-4.0" and got["z/w.py"] == got["top.py"] == got[None] == (None, None, None)
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def slow_cosine(a, b, idf, unknown):
    vector = lambda s: {t: n * idf.get(t, unknown) for t, n in Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", s.lower())).items()}
    a, b = vector(a), vector(b)
    size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(t, 0) for t, v in a.items()) / size if size else 0.0


def test_license_cosine_equals_brute_force():
    rows = license_scan.templates()
    index = license_scan.Index(rows)
    bags = [set(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())) for _, _, t in rows]
    idf = {t: math.log((1 + len(bags)) / (1 + sum(t in b for b in bags))) + 1 for t in set().union(*bags)}
    texts = [t for _, _, t in rows] + ["Licensed under CC BY-NC 4.0 or something like that", "", "xyzzy", "the the of license"]
    for text in texts:
        want = min((-round(slow_cosine(text, t, idf, index.unknown), 9), n) for n, _, t in rows)
        got = index.nearest(license_scan.TOKEN.findall(text.lower()), 7, 0.0)
        assert (got is None and not text) or got[0] == pytest.approx(-want[0], abs=2e-9)
    assert all(index.nearest(license_scan.TOKEN.findall(t.lower()), 7, 0.75)[0] == pytest.approx(1) for _, _, t in rows)


def test_license_files_and_headers(spark):
    texts = {n: t for n, k, t in license_scan.templates() if k == license_scan.TEXT}
    wrap = lambda s, mark, width: "\n".join(mark + s[i : i + width] for i in range(0, len(s), width))
    words = lambda s, n: "\n".join(" ".join(s.split()[i : i + n]) for i in range(0, len(s.split()), n))
    notice = license_scan.NOTICES["Apache-2.0"][0]
    code = "\n\nimport os\n" + "def f(x):\n    return x\n" * 200
    files = {f"{n}/LICENSE": "Copyright (c) 2020 Some One\n\n" + words(t, 7) for n, t in texts.items()}
    files |= {f"{n}/src/deep/x.py": "x = 1" for n in texts}
    files["h/a.py"] = "#!/usr/bin/env python\n# Copyright 2021 Some One\n#\n" + "\n".join("# " + line for line in words(notice, 9).split("\n")) + code
    files["h/b.c"] = "/*\n * Copyright 2021\n *\n" + "\n".join(" * " + line for line in words(license_scan.NOTICES["GPL-3.0"][0], 8).split("\n")) + "\n */" + code
    files["h/c.js"] = "/* " + words(texts["MIT"], 10) + " */" + code
    files["h/d.py"] = "x = 1" + code + "\n# not licensing anything\n"
    files["h/e.md"] = "# Title\n\nWords.\n\n" + words(license_scan.NOTICES["MPL-2.0"][0], 6) + "\n\n" + "More words. " * 300
    df = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(files.items())], "path string, text string, license int")
    got = {r.path: r for r in license_scan.scan(df).collect()}
    for n in texts:
        assert (got[f"{n}/LICENSE"].license, got[f"{n}/src/deep/x.py"].effective_license) == (n, n), n
    assert [got[f"h/{x}"].license for x in ("a.py", "b.c", "c.js", "d.py", "e.md")] == ["Apache-2.0", "GPL-3.0", "MIT", None, "MPL-2.0"]
    assert got["h/d.py"].effective_license is None  # headers license their own file only


def test_license_ties_and_repeats(spark):
    said = "Released under the MIT License."
    rows = [("d/B", said), ("d/A", said), ("d/x", "y"), ("d/x", "y"), ("d/z", None)]
    got = sorted((r.path, r.effective_license, r.license_from) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == [("d/A", "MIT", "d/A"), ("d/B", "MIT", "d/B"), ("d/x", "MIT", "d/A"), ("d/x", "MIT", "d/A"), ("d/z", "MIT", "d/A")]


# 4 tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_encoder_equals_library(tokenizer):
    mine = bpe.WordBpe(queries.vocabulary_path())
    rng = random.Random(5)
    alphabet = "abcdefgTHEin'  \n\t.,!?123äéßñΣςσİıé́漢字🙂\u200d\x1c\x85\xa0 <|>_-"
    pieces = [t.replace(mine.mark, "") for t in mine.token_id]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) + ("<|endoftext|> x<|startoftext|>" if k % 9 == 0 else "") for k in range(1500)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(1500)] + [t for _, t in EDGE if t is not None]
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False)
        got = mine.encode(t)
        assert got.tolist() == want.ids, t
        assert mine.decode(got).decode() == tokenizer.decode(want.ids, skip_special_tokens=False)


def test_token_tables(spark, tokenizer):
    rows = docs_of(spark, EDGE)
    got = {r.doc_id: r for r in bpe.round_trip_digests(rows, queries.vocabulary_path()).collect()}
    for i, t in EDGE:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_table(rows, queries.vocabulary_path())
    decoded = bpe.decode_table(encoded, queries.vocabulary_path()).filter("doc_id = 5").first()
    assert decoded.decoded == tokenizer.decode(decoded.ids, skip_special_tokens=False)
    with pytest.raises(ValueError):
        bpe.encode_table(encoded, queries.vocabulary_path())


# 5 toxicity


def test_toxicity_tolerates_gaps(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 2)):
                words[rng.randrange(60)] = rng.choice(["idiot", "pathetic", "loser"])
        rows.append((i, ". ".join(" ".join(words[k : k + 10]) for k in range(0, 60, 10)), int(toxic)))
    df = docs_of(spark, rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    model = toxicity.train(df.select("doc_id", "text"), labels.filter("doc_id % 2 = 0"))
    extra = [(2000, "you are an i-d-i-o-t and p.a.t.h.e.t.i.c"), (2001, "nothing of note"), (2002, None), (2003, ""), (2004, "x" * 30_000)]
    got = {r.doc_id: r.score for r in toxicity.score(df.select("doc_id", "text").unionByName(docs_of(spark, extra)), model).collect()}
    held = [(got[i], t) for i, _, t in rows if i % 2]
    assert all((s >= 0.7) == bool(t) for s, t in held)
    assert got[2000] >= 0.7 > max(got[2001], got[2002], got[2003], got[2004])
    spelled = ["such an i---d---i---o---t here", "such an i d i o t here", "an i di ot, really", "i. d. i. o. t.", "what a\nl  o  s e r!", "p_a_t_h_e_t_i_c", "pathxetic", "we do it as is, to me or us", "a b c d e f"]
    odd = docs_of(spark, [(None, t, 1) for t in spelled], "doc_id string, text string, score int")
    assert [r.score >= 0.7 for r in toxicity.score(odd, model).collect()] == [True] * 7 + [False] * 2
    assert toxicity.train(df.select("doc_id", "text"), labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs_of(spark, EDGE), None).collect()} == {0.0}


def test_kernel_batch_equals_plain_form():
    marks = toxicity.Landmarks(["idiot", "stupid", "lowesten"])
    words = ["idiot", "i-d-i-o-t", "stupids", "xlowesten", "tidio", "banana", "aaaaaaa", "stu", "ab", "lowest"]
    marks.near(words)
    for w in words:
        plain = np.array([toxicity.kernel(toxicity.subsequences(w.strip(toxicity.EDGES)), toxicity.subsequences(m)) for m in marks.words])
        want = np.where(plain >= toxicity.NEAR, plain, 0)
        got = marks.known[w]
        assert np.allclose(want, 0 if got is None else got, atol=1e-5), w


def test_sentence_values_equal_plain_form():
    marks = toxicity.Landmarks(["idiot", "stupid"])
    rng = random.Random(51)
    pool = ["idiot", "i-d-i-o-t!", "stupid", "stupids", "banana", "of", "it", "you", "lowest", "idi", "idiots"]
    texts = [None, "", "you"] + [rng.choice(". |! |\n| ".split("|")).join(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 5))) for _ in range(4)) for _ in range(40)]

    def values(word):
        word = toxicity.GAP.join(x for x in re.split(r"[^A-Za-z0-9]+", word) if x)
        found = np.array([toxicity.kernel(toxicity.subsequences(word), toxicity.subsequences(m)) for m in marks.words])
        return np.where(found >= toxicity.NEAR, found, 0) ** toxicity.POWER

    for text, got in zip(texts, marks.sentences(texts)):
        sentences = [set(x.split()) for x in re.split(r"(?<=[.!?…])\s+|\n+", text or "")]
        want = [v for v in (sum((values(w) for w in x), np.zeros(2)) for x in sentences) if v.any()]
        apart = [x for x in got if not any(np.allclose(x, v, atol=1e-4) for v in want)]
        assert len(got) - len(apart) >= len(want) and all(any(np.allclose(x, v, atol=1e-4) for x in got) for v in want), text
        assert not apart or toxicity.SPELLED.search(text.lower())


# 6 mixing


def slow_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in done]
        rest, whole = total - sum(done.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / whole > cap * sizes[s]]
        if not over:
            return done | {s: rest * weight[s] / whole for s in left}
        done |= {s: cap * sizes[s] for s in over}


def slow_multiplier(sizes, target, cap=3):
    low, high = -50.0, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(s * min(cap, math.exp(min(50, mid * s))) for s in sizes) > target else (mid, high)
    return mid


def mix_rows(df, **options):
    rows, n = mixing.mix(df, **options)
    return rows.select("doc_id", "source", *(F.col(n[c]).alias(f"mix_{c}") for c in n if c not in ("source", "turn", "place"))).collect()


def test_mixing_meets_targets(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "ß", None] + ["hot"] * 4)) for i in range(3000)] + [(9000, "w " * 5, "tiny"), (9001, None, "void")]
    rows += [(9500, "w " * 20, "copies")] * 300 + [(9501, "w " * 7, "copies")] * 10
    df = docs_of(spark, rows, "doc_id long, text string, source string")
    got = mix_rows(df)
    sizes, taken, targets, by = defaultdict(int), defaultdict(int), {}, defaultdict(list)
    for r in got:
        sizes[r.source] += r.mix_size
        taken[r.source] += r.mix_size * r.mix_copies
        targets[r.source] = r.mix_target
        by[r.source].append(r)
        assert 0 <= r.mix_copies <= 3 and abs(r.mix_copies - r.mix_rate) < 1 + 1e-6
    want = slow_targets(dict(sizes))
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 31 and all(r.mix_source_size == sizes[s] for r in by[s])
        own = [r.mix_size for r in by[s]]
        if sizes[s] and want[s] < 3 * sizes[s] * (1 - 1e-9):
            m = slow_multiplier(own, want[s])
            # the dual's optimum: tilted by size, and the rates' words are the target
            assert all(r.mix_rate == pytest.approx(min(3, math.exp(m * r.mix_size)), rel=1e-5) for r in by[s])
            assert sum(r.mix_size * r.mix_rate for r in by[s]) == pytest.approx(want[s], rel=1e-6)
    assert len({r.mix_rate for r in by["hot"]}) > 30
    again = sorted((r.doc_id, r.mix_copies) for r in mix_rows(df.repartition(7)))
    assert again == sorted((r.doc_id, r.mix_copies) for r in got)
    assert mixing.mixed(df).columns == df.columns and mixing.mixed(df).count() == sum(r.mix_copies for r in got)
    assert mix_rows(df.limit(0)) == [] and mixing.mixed(df.limit(0)).count() == 0


def test_mixing_clashing_names_and_zero_target(spark):
    df = docs_of(spark, [(1, "a b c", "x", 5, "p"), (None, None, None, 6, "q")], "doc_id long, text string, source string, __copies int, SIZE string")
    out = mixing.mixed(df)
    assert out.columns == df.columns and {tuple(r)[3] for r in out.collect()} <= {5, 6}
    rows, n = mixing.mix(docs_of(spark, [(1, "a b c", "x"), (2, "a b", "y")], "doc_id long, text string, source string"), weights=(0, 1))
    got = {r.doc_id: (r[n["rate"]], r[n["copies"]]) for r in rows.collect()}
    assert got[1] == (0.0, 0) and got[2][0] == pytest.approx(2.5)


# 7 URLs


def slow_rule(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best


def slow_ratio(url, learned):
    """learned: URLs that either side was counted from."""
    text = url_filter.START * url_filter.ORDER + (url or "") + url_filter.END
    total = 0.0
    for i in range(url_filter.ORDER, len(text)):
        chance = []
        for counts in learned:
            p = 1 / 0x110000
            for k in range(url_filter.ORDER + 1):
                p = (counts[text[i - k : i + 1]] + url_filter.ALPHA * p) / (counts["context", text[i - k : i]] + url_filter.ALPHA)
            chance.append(p)
        total += math.log(chance[0]) - math.log(chance[1])
    return total / (len(text) - url_filter.ORDER)


def url_counts(urls):
    counts = Counter()
    for u in urls:
        text = url_filter.START * url_filter.ORDER + u + url_filter.END
        for i in range(url_filter.ORDER, len(text)):
            for k in range(url_filter.ORDER + 1):
                counts[text[i - k : i + 1]] += 1
                counts["context", text[i - k : i]] += 1
    return counts


def test_urls(spark):
    urls = [f"http://{h}.{d}/{p}/{i}" for i, (h, d, p) in enumerate((h, d, p) for h in ("a", "b.C") for d in ("example.com", "x.net", "y.org") for p in ("en", "de", "es") for _ in range(6))]
    urls += [None, "", "nothing", "https://COM/en/1?x#y", "http://q://z/", "http://é.com/en/", "http://example.com/en/7?a"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = slow_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.name if rule else None), u
        if rule:
            assert got[i].verdict == ("allow" if rule.allow else "block")
    sides = {True: set(), False: set()}
    for u in urls:
        if (rule := slow_rule(u)[2]) and hashlib.md5(u.encode()).hexdigest()[0] > "3":
            sides[rule.allow].add(u)
    learned = [url_counts(sides[flag]) for flag in (True, False)]
    for i, u in enumerate(urls):
        assert (got[i].score is None) == (got[i].rule is not None)
        if got[i].score is not None:
            assert got[i].score == pytest.approx(slow_ratio(u, learned), abs=2e-6), u
    contexts = {text[i - 3 : i] for u in urls[:20] if u for text in [url_filter.START * 3 + u + url_filter.END] for i in range(3, len(text))}
    for context in list(contexts)[:5]:  # chances of all characters after a context add up to 1
        for counts in learned:
            total = 0.0
            for c in {chr(i) for i in range(0x250)}:
                p = 1 / 0x110000
                for k in range(4):
                    p = (counts[(context + c)[3 - k :]] + url_filter.ALPHA * p) / (counts["context", context[3 - k :]] + url_filter.ALPHA)
                total += p
            assert 0.999 < total <= 1 + 1e-9
    assert {r.verdict for r in url_filter.judge(df.filter("coalesce(url, '') = ''")).collect()} <= {"allow"} and url_filter.judge(df.limit(0)).count() == 0


# 8 media


def test_codecs():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    x = (np.sin(np.arange(4000) / 9) * 12000).astype(np.int16)
    for codec, table in ((audio.MULAW, mu), (audio.ALAW, a)):
        rate, pcm = audio.decode(audio.write_wav(audio.compress(x, table), codec, 8000, len(x)))
        assert rate == 8000 and np.abs(pcm.astype(int) - x).max() < 600
    rate, pcm = audio.decode(audio.write_wav(audio.adpcm_encode(x), audio.IMA_ADPCM, 8000, len(x), audio.BLOCK_BYTES, 4))
    assert len(pcm) == len(x) and np.abs(pcm[600:].astype(int) - x[600:]).mean() < 400
    up = audio.resample(x, 8000, 16000)
    assert len(up) == 2 * len(x) and np.abs(up[200:-200:2].astype(int) - x[100:-100]).max() < 1500
    with pytest.raises(ValueError):
        audio.decode(b"RIFF")


def test_media_table(spark):
    got = {r.doc_id: r for r in audio.store_texts(docs_of(spark, EDGE)).collect()}
    for i, t in EDGE:
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[0].media_sha256 == got[1].media_sha256 and got[3].feature == got[4].feature
    stored = {r.doc_id: (bytes(r.media), bytes(r.pcm)) for r in audio.media_columns(docs_of(spark, EDGE + [(100 + i, "t" * i) for i in range(12)])).collect()}
    assert {audio.read_wav(m)[0] for m, _ in stored.values()} == {audio.MULAW, audio.ALAW, audio.IMA_ADPCM}
    for i, (m, pcm) in stored.items():  # each file on its own gives what the batch gives
        rate, x = audio.decode(m)
        assert audio.read_wav(pcm)[:2] == (audio.PCM, 16000) and np.array_equal(audio.decode(pcm)[1], audio.resample(x, rate, 16000))
        if i in got:
            assert hashlib.sha256(m).hexdigest() == got[i].media_sha256 and got[i].feature.endswith(f"pcm={zlib.crc32(pcm):08x}")
    media = spark.createDataFrame([(1, bytearray(audio.write_wav(b"\x80" * 100, audio.MULAW, 8000, 100))), (2, None), (3, bytearray(b"junk"))], "i int, media binary")
    pcm = {r.i: r.pcm for r in audio.to_pcm(media, on_error="null").collect()}
    assert audio.read_wav(bytes(pcm[1]))[:2] == (audio.PCM, 16000) and pcm[2] is None and pcm[3] is None


# 9 quality


def slow_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_quality_measures(spark):
    texts = random_texts(8, 60) + ["a\nb\na\n\n \n c", "# $ % <x>\n" * 30]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1000 + i, t, None) for i, t in EDGE]
    df = docs_of(spark, rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df)[0].collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_measures(t), t[:80] if t else t
    assert quality.judge(df.limit(0))[0].count() == 0
    clash = df.withColumn("KEPT", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("a.b", F.lit(3))
    rows, names = quality.judge(clash)
    assert rows.columns[:6] == clash.columns and names["kept"] == "__kept" and names["n_words"] == "n_words"
    assert {r.doc_id: r["__kept"] for r in rows.collect()} == {i: r.kept for i, r in got.items()}
    assert quality.cleaned(clash).columns == clash.columns


def slow_frequent(rows, config):
    """(host, normalised line) above the limits."""
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" "))
    held, docs = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        docs[h].add(t or "")
        for x in (t or "").split("\n"):
            if norm(x):
                held[h, norm(x)].add(t)
    return {k for k, v in held.items() if len(v) >= config.min_docs and len(v) > min(config.max_docs, config.max_share * len(docs[k[0]]))}, norm


def test_line_frequency_equals_brute_force(spark):
    rng = random.Random(41)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.choice([5, 30, 400, 3000]))) for _ in range(30)]
    rows = []
    for i in range(400):
        lines = [rng.choice(pool) if rng.random() < 0.3 else f"{rng.random()} own Line {i}" for _ in range(rng.randint(0, 8))]
        rows.append((i, "\n".join(lines) if rng.random() < 0.97 else None, rng.choice(["big"] * 6 + ["small", None])))
    rows += [(1000 + i, *rows[i][1:]) for i in range(20)]
    df = docs_of(spark, rows, "doc_id long, text string, source string")
    for config in (quality.QualityConfig(min_words=0), quality.QualityConfig(min_words=0, max_docs=8), quality.QualityConfig(min_words=0, min_docs=2, max_share=0.01)):
        found, norm = slow_frequent(rows, config)
        assert found
        for r in quality.judge(df, config=config)[0].collect():
            lines = (r.text or "").split("\n")
            stays = [x for x in lines if (r.source, norm(x)) not in found]
            assert r.clean_text == (None if r.text is None else "\n".join(stays))
            assert r.removed_words == sum(len(norm(x).split(" ")) for x in lines if (r.source, norm(x)) in found)


def test_frequent_lines_deplete(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    bar = "\n".join(prose(6) for _ in range(12))
    rows = [(i, prose(80) + "\n" + prose(90), "h") for i in range(40)]
    rows += [(100 + i, bar + "\n" + prose(5 if i < 10 else 100), "h") for i in range(20)]
    rows += [(200 + i, bar + "\n" + prose(5), "other") for i in range(4)] + [(250 + i, bar + "\n" + prose(5), "few") for i in range(6)]
    copied = "\n".join(prose(20) for _ in range(4))
    rows += [(300 + i, copied, "h") for i in range(40)]
    df = docs_of(spark, rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(df)[0].collect()}
    assert not any(kept[100 + i] for i in range(10)) and all(kept[100 + i] for i in range(10, 20))
    assert all(kept[i] for i in range(40)) and all(kept[200 + i] for i in range(4)) and not any(kept[250 + i] for i in range(6)) and all(kept[300 + i] for i in range(40))


# 10 repeated strings


def slow_removal(rows):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            seen.add(s)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def removal(df):
    return [tuple(r) for r in suffix_dedup.digests(df).collect()]


@pytest.mark.parametrize("block, hot", [(4096, 256), (5, 256), (5, 2)])
def test_removal_equals_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "HOT_FOUND", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_ONE_IN", 2)
    rows = list(enumerate(random_texts(10, 150))) + [(1000 + i, t) for i, t in EDGE]
    assert sorted(removal(docs_of(spark, rows).repartition(5))) == slow_removal(rows)


def test_hot_passage(spark, monkeypatch):
    """One passage with different surroundings in every document: its rims are cut into blocks and merged."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 16)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 12))) + passage + " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(120)]
    assert sorted(removal(docs_of(spark, rows).repartition(4))) == slow_removal(rows)


def test_column_rounds_equal_brute_force():
    rng = random.Random(22)
    gram = b"g" * suffix_dedup.GRAM
    for alphabet in (b"a", b"ab", b"abcdef"):
        ends = [(bytes(rng.choice(alphabet) for _ in range(76)), bytes(rng.choice(alphabet) for _ in range(76))) for _ in range(4)]
        contexts, places = [], []
        for _ in range(60):
            a, b = rng.choice(ends)[0], rng.choice(ends)[1]
            low = rng.randint(0, 76)
            high = rng.randint(low, 76)  # strings start low to high bytes before the gram
            contexts.append(a[76 - high :] + gram + b[: 76 - low])
            places.append(high)
        got = suffix_dedup.column_rounds(contexts, np.array(places))
        seen = set()
        for k, (c, p) in enumerate(zip(contexts, places)):
            own = {p - s: c[s : s + 100] for s in range(len(c) - 99)}
            assert [l for l in range(77) if got[k, l]] == sorted(l for l, s in own.items() if (l, s) in seen)
            seen |= set(own.items())


def test_removal_without_ids_that_tell_rows_apart(spark):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefg ") for _ in range(300))
    rows = [(1, passage, "x"), (1, passage, "x"), (1, "é" + passage[50:250], "w"), (2, "é" + passage + "é", "y"), (3, None, "z"), (None, passage, "n"), (None, "short", None)]
    df = docs_of(spark, rows, "doc_id long, text string, __row string")
    got = [(r.doc_id, r.text, r["__row"]) for r in suffix_dedup.deduplicated(df).collect()]
    assert len(got) == 7 and (3, None, "z") in got and (None, "short", None) in got and (2, "éé", "y") in got and (None, "", "n") in got
    ones = sorted(t for d, t, _ in got if d == 1)  # the row of the least hash of its text keeps what the others then lose
    assert ones in (sorted(["", "é", passage]), sorted(["", passage[:50] + passage[250:], "é" + passage[50:250]])), ones
    assert suffix_dedup.digests(df.limit(0)).count() == 0 and suffix_dedup.deduplicated(df.limit(0)).columns == df.columns
    named = docs_of(spark, [("b", passage), ("a", passage)], "doc_id string, text string")
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.deduplicated(named).collect()) == [("a", passage), ("b", "")]


def test_frequent_lines_leave_the_text(spark):
    import corpus_pipeline

    rng = random.Random(32)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    bar = "Share this  page 12 now"
    own = [[prose(30), prose(40)] for _ in range(24)]
    rows = [(i, f"{x}\n  share THIS page {i} now\n\n{y}\n{bar}" if i < 20 else f"{x}\n{y}", "h", 0) for i, (x, y) in enumerate(own)]
    rows += [(100 + i, f"{bar}\n{prose(60)}", "rare", 0) for i in range(3)] + [(200, None, "h", 0), (201, "", None, 0)]
    docs = docs_of(spark, rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.stage_quality(spark, docs, "").collect()}
    want = {i: f"{x}\n\n{y}" if i < 20 else f"{x}\n{y}" for i, (x, y) in enumerate(own)} | {i: t for i, t, *_ in rows if 100 <= i < 200}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    judged = {r.doc_id: r.clean_text for r in quality.judge(docs)[0].collect()}
    assert judged[200] is None and judged[201] == ""


# the pipeline and the queries


def test_pipeline_and_queries(spark):
    import corpus_pipeline

    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(n))
    texts = [prose(120) for _ in range(30)]
    near = texts[0].split()
    near[50] = "changed"
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*texts, texts[1], " ".join(near), "short", None, texts[2] + " " + texts[3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "suffix_dedup", "mix", "tokens"]
    state = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, "")
        seen.append(state.collect())
        state = spark.createDataFrame(seen[-1], state.schema)
    kept = [{r.doc_id for r in s} for s in seen]
    assert kept[0] == {r[0] for r in rows} - {32, 33} and kept[1] == kept[0] - {30, 31} and kept[2] == kept[1]
    assert len({r.doc_id: r.text for r in seen[2]}[34]) < 120
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert abs(words(seen[3]) - words(seen[2])) <= 3 * 120 and len(seen[4]) == len(seen[3])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.queries()}


def test_pipeline_keeps_texts_of_shared_and_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(31)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(4, 9))) for _ in range(n))
    texts = [prose(120) for _ in range(8)]
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (None, texts[1], "a"), (None, texts[1], "b"), (7, texts[2], "a"), (7, texts[3], "a")]
    rows += [(5, texts[4], "a"), (9, texts[4] + " end", "a"), (9, texts[5], "a"), (None, texts[5], "a"), (11, texts[6], "a"), (12, texts[7], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.stage_near_dedup(spark, docs, "").collect()
    ids = [(None, 0), (None, 1), (7, 2), (7, 3), (5, 4), (9, 5), (11, 6), (12, 7)]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((i, texts[t]) for i, t in ids)
    shared = " " + prose(60) + " "
    rows = [(3, texts[0] + shared), (3, shared + texts[1]), (None, shared + texts[2]), (1, texts[3] + shared + texts[4]), (None, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r.text for r in corpus_pipeline.stage_suffix_dedup(spark, docs, "").collect()]
    assert sum(shared.strip() in t for t in left) == 1 and texts[3] + shared + texts[4] in left
    assert all(sum(x in t for t in left) == 1 for x in [t[3:-3] for t in texts[:6]])
