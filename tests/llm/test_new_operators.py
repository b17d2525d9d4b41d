"""Conversation repair, line dedup and hard negatives against brute force, and faults of earlier operators that stay mended."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import bpe, conversations, hard_negatives, license_scan, line_dedup, mixing, queries, simhash, toxicity
from voxloom.llm.conversations import Limits
from voxloom.llm.hard_negatives import MiningConfig

SPACE = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string"


# 11 conversations


def plain_repair(rows):
    """(cost, audit, lines) by the definition: every edit of every suffix, least (cost, label string) first."""
    seen, coded = set(), []
    for role, text in rows:
        blank, again = not text.strip(SPACE), (role, text) in seen
        seen.add((role, text))
        coded.append((role, text, blank or again, not blank and not again and text.rstrip(SPACE)[-1] not in ".!?"))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    known = {}

    def best(i, state, inserted):
        if (i, state, inserted) in known:
            return known[i, state, inserted]
        found = []
        if i == len(coded) and state in ("", "a"):
            found.append((0, "", ()))

        def add(cost, label, line, rest):
            if rest:
                found.append((cost + rest[0], label + rest[1], (*line, *rest[2])))

        if inserted < 4:
            for r in "ua":
                if (state, r) in step:
                    add(3, "I", [f"{names[r]}:"], best(i, r, inserted + 1))
        if i < len(coded):
            role, text, forced, cut = coded[i]
            add(4, "D", [], best(i + 1, state, 0))
            if not forced:
                if role and (state, role[0]) in step:
                    add(3 * cut, "K", [f"{role}:{text}"], best(i + 1, role[0], 0))
                for r in "ua":
                    if (state, r) in step:
                        add(3 + 3 * cut, "R", [f"{names[r]}:{text}"], best(i + 1, r, 0))
        known[i, state, inserted] = min(found) if found else None
        return known[i, state, inserted]

    return best(0, "", 0)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain_report(rows):
    """The contract's row of each conversation."""
    held = defaultdict(list)
    for r in plain_damage(rows):
        held[r[0]].append(r[1:])
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(held[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in mine if t is not None}
        blank = duplicate = truncated = 0
        seen = set()
        for _, role, text in mine:
            if not text.strip(SPACE):
                blank += 1
            elif (role, text) in seen:
                duplicate += 1
            elif text.rstrip(SPACE)[-1] not in ".!?":
                truncated += 1
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = plain_repair([r[1:] for r in mine])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_turns(seed, conversations_=60, most=14):
    rng = random.Random(seed)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "sage", "tool", "", "ünder", None]
    texts = ["Yes.", "No", "What?", " \t", "", "so\n", "done! \x0b", "é.", "\x1c", None, "A longer line of text.", "x" * 300]
    rows = []
    for conv in range(conversations_):
        for turn in range(rng.randint(1, most)):
            turn = None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 5])
            rows.append((None if conv == 0 else conv, turn, rng.choice(roles), rng.choice(texts)))
    return rows


def reports(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def test_every_label_string_of_small_conversations():
    """The recursion that the other tests trust, against all label strings."""
    for rows in itertools.product([("user", "Hi."), ("assistant", "cut"), ("system", "Be."), ("user", "")], repeat=3):
        seen, best = set(), None
        forced = []
        for role, text in rows:
            forced.append(not text.strip() or (role, text) in seen)
            seen.add((role, text))
        for n in range(7):
            for labels in itertools.product("DIKR", repeat=n):
                if sum(x != "I" for x in labels) != len(rows):
                    continue
                for given in itertools.product("ua", repeat=sum(x in "IR" for x in labels)):
                    made, at, k, cost = "", 0, 0, 0
                    for x in labels:
                        if x in "IR":
                            made += given[k]
                            k += 1
                        elif x == "K":
                            made += rows[at][0][0]
                        cost += {"I": 3, "R": 3, "K": 0, "D": 4}[x]
                        if x in "KR":
                            cost += 1000 if forced[at] else 3 * (rows[at][1][-1] not in ".!?")
                        at += x != "I"
                    if re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, "".join(labels)) < best):
                        best = (cost, "".join(labels))
        assert plain_repair(rows)[:2] == best


def test_conversation_repair(spark):
    rows = random_turns(1)
    df = spark.createDataFrame(rows, TURNS)
    damaged, copies = conversations.damaged(df)
    assert reports(conversations.repair(damaged, copies=copies)) == plain_report(rows)


@pytest.mark.parametrize("limits", [Limits(rows=0), Limits(rows=4), Limits(bytes=100), Limits(rows=2, broadcast=-1)])
def test_conversations_in_segments(spark, limits):
    rows = random_turns(2, 12, 40) + [(7, 3, "user", "Yes.")] * 30 + [(8, t, "assistant", "No") for t in range(40)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    damaged, copies = conversations.damaged(df)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many small segments
    try:
        assert reports(conversations.repair(damaged, copies=copies, limits=limits)) == plain_report(rows)
        got = defaultdict(list)
        for r in conversations.repaired(damaged, copies=copies, limits=limits).collect():
            got[r.conv_id].append(r)
        want = plain_report(rows)
        for conv, (*_, audit, digest) in want.items():
            lines = sorted(got[conv], key=lambda r: (r.seg, r.pos))
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == digest
            assert "".join(r.edit for r in lines) == audit.replace("D", "") and all(r.turn is None for r in lines if r.edit == "I")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_conversation_edges(spark):
    rows = spark.createDataFrame([("a/b", None, None, None, 1), ("a/b", 2, "user", "Hi.", 2), ("c", 1, "assistant", "Yes.", 3)], "conv_id string, turn int, role string, text string, copies int")
    got = reports(conversations.repair(rows))
    assert set(got) == {"a/b", "c"} and got["a/b"][:3] == (0, 1, 0) and got["a/b"][5:7] == (7, "DIK"[:1] + "KI")
    assert got["c"][5:7] == (3, "IK")
    none = conversations.repair(rows, copies=F.lit(0))
    assert reports(none) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ("a/b", "c")}
    assert conversations.repair(rows.limit(0)).count() == 0 and conversations.repaired(rows.limit(0)).count() == 0


# 12 lines


def plain_lines(rows, config=line_dedup.LineConfig()):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACE).translate(lower)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= config.min_chars:
                holders[key(line)].add(i)
    last = {k: max(v, key=lambda i: (i is not None, i)) for k, v in holders.items() if len(v) >= config.min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def random_lines(seed, n):
    rng = random.Random(seed)
    common = ["a line that many documents hold, some with Capitals", "ÄÖÜ lines keep their capitals, but not the ASCII", "x" * 39, "x" * 40, "", "short", "ñ" * 41]
    rows = []
    for i in range(n):
        lines = [rng.choice([str.upper, str, lambda s: f" \t{s}\x0b", lambda s: s + "\r"])(rng.choice(common)) for _ in range(rng.randint(0, 6))]
        lines += [f"line {rng.randint(0, 30)} of its own, but shared by a handful of documents" for _ in range(rng.randint(0, 3))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("config", [line_dedup.LineConfig(), line_dedup.LineConfig(broadcast_lines=-1, broadcast_bytes=-1), line_dedup.LineConfig(min_chars=0, min_docs=2)])
def test_line_dedup(spark, config):
    rows = random_lines(3, 80) + [(900, None), (901, ""), (902, "\n\n"), (None, "x" * 40), (None, "x" * 40 + "\n" + "y" * 50), (5, "x" * 40), (903, "word " * 30_000)]
    got = line_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), config=config)
    assert sorted(map(tuple, got.collect()), key=str) == plain_lines(rows, config)


def test_line_dedup_edges(spark):
    line = "the same long line, again and again and again"
    df = spark.createDataFrame([(f"{i}/a", f"{line}\nown {i}", i, True) for i in range(6)], "doc_id string, text string, n_lines int, gone boolean")
    rows, names = line_dedup.judge(df)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert rows.columns[:4] == df.columns and got["2/a"]["n_lines"] == 2 and got["2/a"][names["n_lines"]] == 2 and got["2/a"][names["n_dropped"]] == 1
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()} == {f"{i}/a": (f"{line}\n" if i == 5 else "") + f"own {i}" for i in range(6)}
    assert line_dedup.digests(df.limit(0)).count() == 0


def test_line_dedup_stays_in_the_jvm(spark):
    plan = line_dedup.digests(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 13 negatives


def plain_negatives(rows):
    kept = {(i, label, tuple(np.floor(256 * np.array(v, np.float32).astype(np.float64)).tolist())) for i, label, v in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    kept = [(i, label if i is None or i % 7 else (label + 1) % 10, v) for i, label, v in kept]
    order = lambda s: (-s[0], s[1] is None, s[1])
    out = []
    for me in kept:
        if me[0] is None or me[0] % 100:
            continue
        scored = [(int(sum(a * b for a, b in zip(me[2], r[2]))), r[0], r) for r in kept]
        same = sorted(((s, i) for s, i, r in scored if r[1] == me[1] and r != me), key=order)[:5]
        for ps, pid in same:
            band = sorted(((s, i) for s, i, r in scored if r[1] != me[1] and 30 * ps <= 100 * s <= 90 * ps), key=order)[:10]
            out += [(me[0], pid, k + 1, i, ps, s) for k, (s, i) in enumerate(band)]
    return sorted(out, key=str)


def mined(df, config=MiningConfig()):
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    found = hard_negatives.mine(df, anchor=F.col("vec_id") % 100 == 0, label=label, config=config)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=str)


def random_vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    x = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dims))
    x[::9] = x[0]  # copies
    x[5::11] *= 3
    return [(i, int(rng.integers(0, 4)), np.float32(v).tolist()) for i, v in enumerate(x)]


VECTORS = "vec_id long, label int, embedding array<float>"
SMALL = MiningConfig(pivots=7, cell_rows=16, group_rows=3, radii=(0.05, 0.1, 0.2, 0.4))


@pytest.mark.parametrize(("spread", "config"), [(0.05, SMALL), (1.0, SMALL), (0.3, MiningConfig(pivots=1, cell_rows=5, radii=()))])
def test_hard_negatives(spark, spread, config):
    rows = random_vectors(4, 420, 6, spread)
    rows += [(500, None, [1.0] * 6), (600, 1, None), (700, 1, [float("nan")] + [0.0] * 5), (800, 1, [float("inf")] * 6), (801, 2, [None, 1.0]), (None, 3, [0.5] * 6), (None, 2, [0.5] * 6)]
    rows += [rows[100], rows[100], (900, 1, [0.0] * 6), (1000, 2, [0.25]), (1100, 3, [])]
    assert mined(spark.createDataFrame(rows, VECTORS).repartition(4), config) == plain_negatives(rows)


def test_hard_negatives_edges(spark):
    df = spark.createDataFrame([(100, 1, [0.5, 0.25], "x")], VECTORS + ", id string")
    assert mined(df) == [] and mined(df.limit(0)) == []
    huge = spark.createDataFrame([(100, 1, [3e38] * 2), (101, 1, [3e38] * 2), (102, 2, [1.0, 1.0])], VECTORS)
    assert isinstance(mined(huge), list)


def test_hard_negatives_scan_part_of_the_cells(spark):
    """In clusters far from each other an anchor's search for positives ends before it has seen all cells."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 8, (np.eye(8)[i % 8] + 0.01 * rng.normal(size=8)).tolist()) for i in range(2000)]
    scanned = []
    plain = hard_negatives._pairs

    def counted(*args):
        found = plain(*args)
        scanned.append(found.count())
        return found

    hard_negatives._pairs = counted
    try:
        df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
        found = hard_negatives.mine(df, anchor=F.col("vec_id") % 500 == 0, config=MiningConfig(cell_rows=50, group_rows=1, pivots=8))
        assert found.select("anchor_id", "positive_id").distinct().count() in (0, 20)
    finally:
        hard_negatives._pairs = plain
    assert sum(scanned[:3]) < 4 * 20  # of 4 anchors and some 40 cells


# mended faults


def test_scores_do_not_depend_on_the_cache(monkeypatch):
    rng = random.Random(6)
    words = ["idiot", "idiots", "i.d.i.o.t", "fine", "green", "house", "moron", "table", "lamp"]
    texts = [" ".join(rng.choices(words, k=6)) + "." for _ in range(60)]
    marks = toxicity.Landmarks(["idiot", "moron"])
    want = [x.tolist() for x in marks.sentences(texts)]
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 5)
    for size in (1, 7, 60):
        marks = toxicity.Landmarks(["idiot", "moron"])
        assert [x.tolist() for i in range(0, 60, size) for x in marks.sentences(texts[i : i + size])] == want


def test_mix_of_repeated_rows_without_a_source(spark):
    rows = [(i % 10, "word " * 20, None) for i in range(300)] + [(400 + i, "word " * 7, None) for i in range(10)] + [(500 + i, f"w{i} " * 40, "a") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found, named = got
    sums = found.groupBy("source").agg(F.sum(F.col(named["size"]) * F.col(named["copies"])).alias("taken"), F.first(named["target"]).alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 40 for r in sums)


IDS = [("string", ["a/b", "a%2Fb", None, "ü"]), ("int", [1, 2, None, -4])]


@pytest.mark.parametrize(("kind", "ids"), IDS)
def test_ids_of_any_type(spark, kind, ids):
    names = ["__k0", "__k1", "__mix_of", "__mix_extra", "id", "h", "row"]
    schema = f"doc_id {kind}, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names)
    rows = [(i, f"some words of text number {k} " * 4, "e/n", "s/t", *range(7)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, schema)
    key = lambda r: str(r.doc_id)
    for found in (
        bpe.round_trip_digests(df, queries.vocabulary_path()), simhash.near_duplicate_classes(df), license_scan.scan_documents(df), line_dedup.digests(df),
        simhash.without_near_duplicates(df), mixing.mix(df)[0], mixing.mixed(df.withColumn("text", F.lit("a b"))), toxicity.score(df, None),
    ):
        assert sorted({key(r) for r in found.collect()}) == sorted(map(str, ids)), found
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns and {tuple(r)[4:] for r in kept.collect()} == {tuple(range(7))}
    for empty in (bpe.round_trip_digests(df.limit(0), queries.vocabulary_path()), simhash.near_duplicate_classes(df.limit(0)), license_scan.scan_documents(df.limit(0))):
        assert empty.count() == 0
