"""Faults that a review of round 3 found, each with a test of its own."""

import math
import os
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.functions import align, text
from voxloom.operators import chunks, diarization, embed, intervals, lexicon, ngram_lm, score, synth
from voxloom.operators.overlap_totals import overlap_totals
from voxloom.plans import baselines, derived, pipelines, registry
from voxloom.sources import readers, shared, writers
from voxloom.streaming import intervals as streams


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same_as_sql(spark, sf_dir, name, tables):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in tables:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = registry.queries()[name](spark, sf_dir).select(*names).collect()
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))


def write_events(spark, folder, rows):
    """rows: (event_id, microseconds since 2024, user_id, event_type, value)."""
    df = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double")
    df.select("event_id", F.timestamp_micros(F.col("at") + derived.EPOCH_US).alias("ts"), "user_id", "event_type", "value").write.parquet(f"{folder}/events.parquet")
    return str(folder)


# F1


def test_recordings_equal_the_plain_form_and_the_pool_stays_where_it_is(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(3)}", f"c{k:03d}", rng.choice(["es", "es", "es", "ca", "eu", None]), f"t{k}", rng.choice([0.5, 1.0, 2.5])) for k in range(60)]
    pool = spark.createDataFrame(rows, "speaker_id string, segment_id string, language string, transcript string, duration_s double").repartition(3)
    config = synth.SynthConfig(target_s=60.0, switch=0.3)
    clips, others = {}, {}
    for who, segment, language, said, size in rows:
        clip = {"segment_id": segment, "language": language, "transcript": said, "duration_s": size}
        (clips.setdefault(who, []) if language == "es" else others.setdefault(language, [])).append(clip)
    want = []
    for i in range(5):
        r = random.Random(config.seed + i)
        want += [(i, *t.values()) for t in synth.conversation(clips, others, synth.pick_speakers(clips, config, r), config, r)]
    sizes, kind = [], type(pool)
    original = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (lambda out: sizes.append(len(out)) or out)(original(df)))
    found = synth.build_recordings(pool, 5, config)
    assert max(sizes, default=0) <= len(clips) + len(others)
    monkeypatch.undo()
    got = found.select("recording", "turn", "speaker_id", "language", "segment_id", "transcript", "start_s", "end_s").orderBy("recording", "turn").collect()
    assert [tuple(r) for r in got] == want


# F2


def test_language_model_tables_are_not_broadcast_by_their_bytes(spark, monkeypatch):
    texts = spark.createDataFrame([(i, " ".join(random.Random(i).choices("abcde", k=9))) for i in range(30)], "id long, text string")
    want = {r.id: r.lm for r in ngram_lm.KneserNey(texts).score(texts, "id").collect()}
    monkeypatch.setattr(ngram_lm, "BROADCAST_ROWS", 0)
    found = ngram_lm.KneserNey(texts).score(texts, "id")
    model = ngram_lm.KneserNey(texts)
    assert all(t.inputFiles() for t in (model.three, model.two, model.one, model.context3, model.context2))  # counted once
    assert "BroadcastHashJoin" not in plan_of(found) and "BroadcastExchange" not in plan_of(found)
    assert {r.id: r.lm for r in found.collect()} == pytest.approx(want)


# F4


def test_a_label_around_a_chunk_without_length(spark, tmp_path):
    df = lambda rows, tail: spark.createDataFrame(rows, "record_id string, start_s double, end_s double, " + tail)
    got = intervals.main_label(df([("r", 5.0, 5.0, "a"), ("r", 0.0, 4.0, "b")], "chunk_id string"), df([("r", 1.0, 9.0, "x")], "label string"))
    found = {r.chunk_id: (r.label, r.label_share) for r in got.collect()}
    assert found["b"] == ("x", 0.75) and found["a"][0] == "x" and math.isnan(found["a"][1])
    rows = [(1, 10_000_000, 1, "view", 0.0), (2, 5_000_000, 1, "click", 2.0), (3, 10_000_000, 1, "view", 1.0), (4, 1, 2, "view", 0.0)]
    assert same_as_sql(spark, write_events(spark, tmp_path, rows), "ev_coverage_label", ["events"])


# F6, F7


def ties():
    """Microseconds whose seconds end in 5 at the fourth place, where the shortest decimal and the product by 1000 round apart."""
    rng = random.Random(1)
    while True:
        at = rng.randrange(2_500_000_000) * 1000 + 500
        low, high = math.floor(at / 1e6 * 1000 + 0.5) / 1000, (at + 500) // 1000 / 1000
        if low != high:
            yield at, low, high


def test_times_are_rounded_as_sql_rounds(spark, tmp_path):
    found = ties()
    some = [next(found) for _ in range(40)]
    # such that frames of 0.01 s differ as well
    fine = [next((at, low, high) for at, low, high in found if round(low / 0.01) != round(high / 0.01)) for _ in range(5)]
    rows = [(k, at, k % 4, ("view", "click")[k % 2], 1.5 + k) for k, (at, _, _) in enumerate([*some, *fine])]
    sf_dir = write_events(spark, tmp_path, rows)
    for name in ("rttm_lines", "frame_der_fine"):
        assert same_as_sql(spark, sf_dir, name, ["events"]), name


# F3, F8, F19


def test_audio_is_made_in_small_batches_and_never_broadcast(spark, monkeypatch):
    from voxloom.plans import io_queries

    def sizes(batches):
        for batch in batches:
            yield batch[["vec_id"]].assign(n=len(batch))

    rows = io_queries._tones(spark, "/root/testdata/sf0.01").select("vec_id", "content").mapInPandas(sizes, "vec_id long, n long")
    assert rows.agg(F.max("n")).first()[0] <= 2 * shared.BATCH_BYTES // 32_000
    plans, plain = {}, pipelines.materialize
    monkeypatch.setattr(pipelines, "materialize", lambda df, label: plans.setdefault(label, plan_of(df)) and plain(df, label))
    registry.queries()["enriched_audio"](spark, "/root/testdata/sf0.001")
    assert "SortMergeJoin" in plans["chunk-features"] and "BroadcastHashJoin" not in plans["chunk-features"] and "voiced" in plans


# F5, F18, F22, F23, F25


def files_of(path):
    return [f for _, _, names in os.walk(path) for f in names if not f.startswith((".", "_"))]


def test_files_do_not_grow_with_records(spark, tmp_path):
    rows = [(f"r{k}", 0.0, 1.0 + k, "A") for k in range(200)]
    writers.write_rttm(spark.createDataFrame(rows, "record_id string, start_s double, end_s double, speaker string"), str(tmp_path / "rttm"))
    said = [(f"r{k}", [{"word": w, "start_s": 0.0, "end_s": 1.0, "confidence": 1.0} for w in ("a\nb", f"“{k}”")]) for k in range(200)]
    writers.write_transcripts(spark.createDataFrame(said, f"record_id string, words {chunks.WORDS}"), str(tmp_path / "said"))
    assert len(files_of(tmp_path / "rttm")) < 50 and len(files_of(tmp_path / "said")) < 50
    assert sorted(map(tuple, readers.read_rttm(spark, str(tmp_path / "rttm")).collect())) == sorted(rows)
    assert {r.record_id: r.value for r in readers.read_packed(spark, str(tmp_path / "said")).collect()} == {f"r{k}": f'a b "{k}"' for k in range(200)}


def test_a_record_that_is_written_again_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "records")
    df = lambda rows: spark.createDataFrame(rows, "record_id string, n int")
    writers.write_by_record(df([(f"r{k}", k) for k in range(300)] + [(None, -1)]), path)
    assert len([n for n in os.listdir(path) if n.startswith("folder=")]) <= writers.RECORD_FOLDERS
    writers.write_by_record(df([("r7", 70), ("r7", 71), ("new", 5)]), path)
    got = [(r.record_id, r.n) for r in spark.read.schema("record_id string, n int").parquet(path).collect()]
    assert sorted(got, key=str) == sorted([(f"r{k}", k) for k in range(300) if k != 7] + [("r7", 70), ("r7", 71), ("new", 5), (None, -1)], key=str)
    with pytest.raises(ValueError, match="folders"):
        writers.write_by_record(df([("r1", 1)]), path, folders=8)


# F9, F10, F12


def test_votes_of_many_words_take_little_memory():
    rng = random.Random(2)
    said = [[(f"w{rng.randrange(4000)}", 1.0) for _ in range(40 + 20 * k)] for k in range(20)]
    tracemalloc.start()
    align.vote(said)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20  # a table of slots by words takes 10 MB and more


# F11, F15, F17, F21


def test_words_are_split_once_for_all_spans(spark):
    rows = spark.range(1).select(F.lit("a b c d e f").alias("t"))
    spans = chunks.even_spans(F.split("t", " "), F.lit(0.0), F.lit(3.0))
    assert plan_of(rows.select(spans)).count("split(") <= 2
    assert [(w.word, w.start_s, w.end_s) for w in rows.select(spans.alias("w")).first().w] == [(c, k * 0.5, k * 0.5 + 0.5) for k, c in enumerate("abcdef")]


def test_python_batches_are_held_to_their_bytes(spark):
    for name in ("merged_overlaps", "edit_split_by_role", "rover_fuse", "fused_baseline"):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(shared.BATCH_BYTES), name


# F14


def test_white_space_and_repairs_as_before(spark, col):
    cases = ["  a  b ", "a\t b", "a \n\n b", "a b", " a  b ", "a b", "", " ", "a=b", "xa=bc=d e=", "a==b", "é=ñandú x"]
    assert col(text.collapse, cases) == [" ".join(c.split()) for c in cases]
    assert col(lambda c: text.clean_markup(c), cases)[8:] == ["b", "bc=d e=", "a==b", "ñandú x"]


# F9, F10, F12


def test_small_tables_of_distances_are_made_once():
    made = []

    def following(before, k):
        made.append(k)
        return before + 1

    rows = [int(r[0]) for r in align.rows_backwards(np.zeros(8, np.int64), following, 100)]
    assert rows == list(range(100, -1, -1)) and len(made) == 100


def test_baseline_runs_each_model_once_a_clip(spark, tmp_path):
    marks = str(tmp_path / "calls")

    def model(every):
        def load():
            def say(row):
                with open(marks, "a") as f:
                    f.write("x")
                return " ".join(w for k, w in enumerate((row["transcript"] or "").split()) if k % every)

            return say

        return load

    clips = spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(["a b c d e", "Uno, dos", "", None, "x"])], "segment_id string, transcript string")
    rows, summary = baselines.recognition_baseline(clips, model(2), model(3))
    assert rows.count() == 5 and summary.columns == ["records", "raw_wer", "normalized_wer", "fused_wer"]
    one = summary.first()
    assert os.path.getsize(marks) == 10
    assert (one.records, one.raw_wer, one.normalized_wer) == (5, 5 / 8, 5 / 8) and one.fused_wer == score.corpus_wer(rows, hypothesis="hyp_fused").first().wer
    alone = baselines.recognition_baseline(clips, model(2))[1].first()
    assert alone.fused_wer is None and alone.raw_wer == 5 / 8


# F16, F20


def test_words_are_counted_in_hash_tables_and_once(spark):
    rows = [(2, "b b a", "x"), (1, "c b a", "x"), (1, "d c", "x"), (None, "e e a B", "x"), (5, "", None), (6, None, "y"), (-7, "z c", "y"), (8, "z", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = lexicon.word_counts(docs, ["lang"])
    first = lambda w, lang: min(((r[0] is not None, r[0] or 0), r[1].lower().split().index(w)) for r in rows if r[1] and r[2] == lang and w in r[1].lower().split())
    got = counts.orderBy("lang", "first").collect()
    assert [(r.lang, r.word) for r in got] == sorted(((r.lang, r.word) for r in got), key=lambda x: (x[0], first(x[1], x[0])))
    assert {(r.lang, r.word): (r.tf, r.df) for r in got}["x", "b"] == (4, 3) and {(r.lang, r.word): r.tf for r in got}["x", "e"] == 2
    assert [(r.word, r.n) for r in lexicon.universal_words(docs, least=2).collect()] == [(r.word, r.n) for r in lexicon.universal_words(docs, least=2, counts=counts).collect()]
    for df in (lexicon.universal_words(docs, least=1), lexicon.most_common(docs)):
        assert "SortAggregate" not in plan_of(df)
    strings = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r.word for r in lexicon.most_common(strings).collect()} == {r.word for r in lexicon.most_common(docs).collect()}


# F26


def test_linkage_looks_at_all_neighbours_in_few_products(monkeypatch):
    x = np.random.default_rng(3).normal(size=(600, 6))
    looked = []
    monkeypatch.setattr(embed, "_nearest", lambda t, s, some, f=embed._nearest: (looked.append(len(some)), f(t, s, some))[1])
    found = embed.average_linkage(x, 0.3)
    assert 2 < len(looked) < 30 and sum(looked) < 3 * 600  # one product for each step of a chain before: some 2 * 600
    looked.clear()
    monkeypatch.setattr(embed, "LITTLE", 0.5)  # never enough: by the chain alone
    assert embed.average_linkage(x, 0.3).tolist() == found.tolist() and len(looked) == 1
    copies = np.repeat(x[:3], 400, axis=0)
    monkeypatch.setattr(embed, "LITTLE", 50)
    assert embed.average_linkage(copies, 0.01).tolist() == np.repeat([0, 1, 2], 400).tolist() and embed.WHOLE_GROUP >= 100_000


# F27


def test_errors_of_many_records_take_few_calls(spark):
    rng = random.Random(8)
    segment = lambda r: (r, round(a := rng.uniform(0, 50), 3), round(a + rng.choice([0.0, 1.0, 7.5]), 3), rng.choice("abc"))
    sides = [[segment(rng.choice([None, "p", "q", f"only{k}"])) for _ in range(80)] for k in range(2)]
    ref, hyp = (spark.createDataFrame(rows, "record_id string, start_s double, end_s double, speaker string") for rows in sides)
    out = diarization.error_by_record(ref, hyp)
    of = lambda rows, r: [x[1:] for x in rows if x[0] == r]
    got = {r.record_id: r.asDict() for r in out.collect()}
    assert set(got) == {None, "p", "q"}
    for r in got:
        assert {n: got[r][n] for n in diarization.SECONDS} == pytest.approx(diarization.record_error(of(sides[0], r), of(sides[1], r)))
    assert "FlatMapCoGroups" not in plan_of(out) and "ArrowEvalPython" in plan_of(out)


# F24


def test_stream_merge_makes_few_calls_to_a_records_state():
    calls, held, timers = [], {}, set()

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def call(*value):
                calls.append(what)
                if what in ("put", "update"):
                    held[self.name] = value[0]
                elif what == "clear":
                    held.pop(self.name, None)
                elif what == "exists":
                    return self.name in held
                return held.get(self.name, [] if self.name == "waiting" else None)

            return call

    class Handle:
        getListState = getValueState = lambda self, name, schema: State(name)
        listTimers = lambda self: (calls.append("list"), iter(list(timers)))[1]
        registerTimer = lambda self, t: (calls.append("register"), timers.add(t))
        deleteTimer = lambda self, t: (calls.append("delete"), timers.discard(t))

    merge = streams.GapMerge(0.5)
    merge.init(Handle())
    out = []
    for added, mark in (([(1.0, 2.0, "a")], 0), ([(2.2, 3.0, "a"), (9.0, 9.5, "b")], 8000), ([], 20000)):
        del calls[:]
        out += merge._advance(("r",), added, mark).values.tolist()
        assert len(calls) <= 6 and len(timers) <= 1  # eight and more before
    assert out == [["r", "a", 1.0, 3.0], ["r", "b", 9.0, 9.5]] and not held and not timers


# F13


@pytest.mark.parametrize("seed, per_bin", [(1, 10_000), (2, 40), (3, 7)])
def test_totals_of_overlaps_equal_those_of_the_pairs(spark, seed, per_bin):
    """Short, long, empty and inverted intervals, many of one time, without ids and with one id twice."""
    rng = random.Random(seed)

    def some(n, first):
        out = []
        for i in range(n):
            start = rng.choice([round(rng.uniform(-20, 400), 1), 77.0, 78.0])
            size = rng.choice([0.0, 0.0, 0.5, round(rng.uniform(0, 9), 2), round(rng.uniform(0, 300), 1), *([-2.0] if i % 9 == 0 else [])])
            out.append((first + i, start, start + size))
        return [*out, (None, 10.0, 90.0), (None, 77.0, 77.0), (first, 300.0, 301.5), (first + n, None, 4.0)]

    left, right = some(150, 0), some(130, -60)
    df = lambda x: spark.createDataFrame(x, "id long, start_s double, end_s double")
    want = {}
    for i, s, e in left:
        for j, t, f in right:
            if None not in (s, e, t, f) and s < f and t < e:
                n, ids, shared = want.get(i, (0, [], 0.0))
                want[i] = n + 1, ids + [j] * (j is not None), shared + min(e, f) - max(s, t)
    got = {r.id: r for r in overlap_totals(df(left), df(right), per_bin).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for i, (n, ids, shared) in want.items():
        assert (got[i].n, got[i].first, got[i].last) == (n, min(ids, default=None), max(ids, default=None)), i
        assert got[i].overlap_s == pytest.approx(shared, abs=1e-9), i
    assert overlap_totals(df(left).limit(0), df(right)).count() == 0 and overlap_totals(df(left), df(right).limit(0)).count() == 0


def test_overlaps_of_one_record_are_not_listed(spark, tmp_path, monkeypatch):
    """Events of one hour, so that each view meets most errors; no sum lies between two hundredths."""
    rng = random.Random(4)
    rows = [(k, rng.randrange(360_000) * 10_000, k % 7, ("view", "error")[k % 2], rng.choice([0.0, 0.5, 60.0, 90.13])) for k in range(3000)]
    sf_dir = write_events(spark, tmp_path, rows)
    monkeypatch.setattr(intervals.interval_join, "overlapping", None)  # lists pairs
    assert same_as_sql(spark, sf_dir, "ev_overlaps_of_one_record", ["events"])


# F10


def test_votes_hold_the_words_of_one_row_at_a_time():
    """A batch of 300,000 words; as Python objects all at once they take some 80 MB."""
    words = [{"word": f"w{k}", "confidence": 1.0} for k in range(50)]
    batch = pa.array([[words, words[:-1], words]] * 2000, pa.list_(pa.list_(pa.struct([("word", pa.string()), ("confidence", pa.float64())]))))
    tracemalloc.start()
    out = align.rover_udf.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2000 and out[0].as_py() == [w["word"] for w in words] and peak < 40e6


def test_systems_of_one_opinion_need_no_vote(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        first = [(rng.choice(["a", "b", "c", None] if k % 5 == 0 else "abc"), rng.choice([0.5, 1.0])) for _ in range(rng.randrange(6))]
        for system in range(rng.choice([1, 2, 3])):
            rows.append((k, system, first if k % 2 else [(w, c / 2) for w, c in first[system:]]))
    df = spark.createDataFrame(rows, "chunk_id long, system int, words array<struct<word:string,confidence:double>>")
    want = {k: align.vote([w for j, _, w in rows if j == k]) for k in range(40)}
    assert {r.chunk_id: r.words for r in chunks.fuse(df).collect()} == want

    @F.arrow_udf("array<string>")
    def alone(hypotheses: pa.Array) -> pa.Array:
        assert hypotheses.null_count == len(hypotheses)
        return pa.nulls(len(hypotheses), pa.list_(pa.string()))

    monkeypatch.setattr(align, "rover_udf", alone)
    assert {r.chunk_id: r.words for r in chunks.fuse(df.filter("chunk_id % 2 = 1 and chunk_id % 5 <> 0")).collect()} == {k: w for k, w in want.items() if k % 2 and k % 5}
