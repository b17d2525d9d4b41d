import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import chunks, diarization, embed, lexicon, models, report, score, select, signal, synth
from voxloom.plans import pipelines

W = chunks.WORDS


def w(word, s, e):
    return {"word": word, "start_s": s, "end_s": e, "confidence": 1.0}


def plain_settled(left, right, a, b):
    """By recursion on what is left of both, from the end."""
    import functools

    x, y = [v["word"].lower() for v in left], [v["word"].lower() for v in right]
    near = lambda v, own, other: abs((v["start_s"] + v["end_s"]) / 2 - own) - abs((v["start_s"] + v["end_s"]) / 2 - other)

    @functools.cache
    def common(i, j):
        if not i or not j:
            return 0
        return common(i - 1, j - 1) + 1 if x[i - 1] == y[j - 1] else max(common(i - 1, j), common(i, j - 1))

    def kept(i, j):
        if i and j and x[i - 1] == y[j - 1]:
            return [*kept(i - 1, j - 1), left[i - 1]]
        if i and (not j or common(i - 1, j) >= common(i, j - 1)):
            return kept(i - 1, j) + [v for v in [left[i - 1]] if near(v, a, b) <= 0]
        return kept(i, j - 1) + [v for v in [right[j - 1]] if near(v, b, a) < 0] if j else []

    return kept(len(x), len(y)) if x and y else [*left, *right]


def plain_merge(spans):
    """The stream of chunks by order of start, by recursion on the last chunk."""
    if not spans:
        return []
    *before, (start, end, words) = sorted(spans, key=lambda s: (s[0], s[1], [tuple(v.values()) for v in s[2]]))
    said = plain_merge(before)
    last = sorted(before, key=lambda s: (s[0], s[1], [tuple(v.values()) for v in s[2]]))[-1] if before else None
    if last is None or min(last[1], end) <= start:
        return said + words
    mid = lambda v: (v["start_s"] + v["end_s"]) * 0.5
    n = 0
    while n < len(words) and mid(words[n]) < min(last[1], end):
        n += 1
    early, late = [v for v in said if mid(v) < start], [v for v in said if mid(v) >= start]
    return early + plain_settled(late, words[:n], (last[0] + last[1]) / 2, (start + end) / 2) + words[n:]


def test_overlap_keeps_the_nearer_chunk(spark):
    def merged(*spans):
        df = spark.createDataFrame([("r", *s) for s in spans], f"record_id string, start_s double, end_s double, words {chunks.WORDS}")
        return [x.word for r in chunks.merge_chunks(df).collect() for x in r.words]

    assert merged((0.0, 10.0, [w("hola", 9.3, 9.7)]), (9.0, 19.0, [w("ola", 9.3, 9.7)])) == ["hola"]
    assert merged((0.0, 10.0, [w("hola", 9.4, 9.7)]), (9.0, 19.0, [w("hola", 9.4, 9.7), w("mundo", 11.0, 11.5)])) == ["hola", "mundo"]
    assert merged((5.0, 10.0, [w("b", 6.0, 7.0)]), (0.0, 5.0, [w("a", 1.0, 2.0)])) == ["a", "b"]


@pytest.mark.parametrize("seed", range(3))
def test_merged_chunks_equal_the_plain_form(spark, seed):
    rng = random.Random(seed)
    rows = []
    for record in range(16):
        t = 0.0
        for _ in range(rng.randint(1, 7)):
            size = rng.choice([0.5, 4.0, 10.0, 25.0])
            words = sorted((w(rng.choice(["a", "b", "C", "c"]), at, at + 0.4) for at in (t + rng.uniform(-0.5, size + 3) for _ in range(rng.randint(0, 12)))), key=lambda x: x["start_s"])
            if rng.random() < 0.2:
                rng.shuffle(words)
            rows.append((f"r{record}", t, t + size, words))
            t += rng.choice([0.5, 2.0, size * 0.8, size, size + 2])
    rows.append(("none", 0.0, 1.0, None))
    df = spark.createDataFrame(rows, f"record_id string, start_s double, end_s double, words {chunks.WORDS}")
    got = {r.record_id: [x.asDict() for x in r.words] for r in chunks.merge_chunks(df).collect()}
    want = {k: plain_merge([(a, b, ws or []) for r, a, b, ws in rows if r == k]) for k in {r[0] for r in rows}}
    assert got == want
    assert chunks.merge_chunks(df.limit(0)).collect() == []


def test_fusion_ablation(spark):
    got = [(round(r.raw_wer, 9), round(r.normalized_wer, 9), round(r.der, 6)) for r in pipelines.fusion_ablation(pipelines.fixed_fusion(spark)).collect()]
    assert got == [(0.3, 0.2, 0.046154), (0.2, 0.1, 0.046154), (0.1, 0.0, 0.046154), (0.0, 0.0, 0.046154), (0.0, 0.0, 0.0)]


def test_synthetic_run(spark):
    r = pipelines.synthetic_run(spark).first()
    assert (r.raw_wer, r.normalized_wer, r.der) == (0.0, 0.0, 0.0) and r.der_before == pytest.approx(1 / 30)


def test_rescore_and_risk(spark):
    rows = spark.createDataFrame([("c", 0, "a b", 0.0, 0.0), ("c", 1, "a c", 0.0, 0.0), ("c", 2, "a", 0.0, 0.0)], "chunk_id string, rank int, text string, score double, lm double")
    assert chunks.rescore(rows).first()["text"] == "a b"
    assert chunks.minimum_risk(rows.filter("rank = 1")).first()["text"] == "a c"


def test_gate(spark):
    base = dict(first_words=["a", "b", "c"], second_words=["a", "b", "c"], logprob=-0.1, snr_db=20.0, duration_s=1.0, mean_wps=3.0, std_wps=1.0)
    cases = [base, base | {"second_words": ["x"]}, base | {"logprob": -0.5}, base | {"mean_wps": 9.0}, base | {"snr_db": math.nan, "logprob": -0.4}, base | {"logprob": math.nan}]
    schema = "first_words array<string>, second_words array<string>, logprob double, snr_db double, duration_s double, mean_wps double, std_wps double, i int"
    rows = spark.createDataFrame([(*c.values(), i) for i, c in enumerate(cases)], schema)
    got = select.gate(rows).orderBy("i").collect()
    assert [r.keep for r in got] == [True, False, False, False, False, False]
    assert got[4].bucket == 2


def test_pseudo_labels_without_a_chunk_match(spark):
    hyps = spark.createDataFrame([(f"c{i}", "r", "p", 0.0, 1.0 + i / 10, ["a", "b"], -0.3, ["a", "b"]) for i in range(4)], "chunk_id string, record_id string, audio_path string, start_s double, end_s double, first_words array<string>, logprob double, second_words array<string>")
    ratio = spark.createDataFrame([("c0", 20.0), ("c1", -math.inf)], "chunk_id string, wada_snr_db double")
    kept, summary = select.pseudo_labels(hyps, ratio)
    assert sorted(r.chunk_id for r in kept.collect()) == ["c0", "c1", "c2", "c3"]
    assert summary.first()["n_input"] == 4


def test_split_sizes(spark):
    rows = spark.createDataFrame([(f"{s}{i}", s) for s, n in (("a", 4), ("b", 5), ("c", 11)) for i in range(n)], "id string, s string")
    got = {r.s: r.n for r in select.stratified_split(rows, "id", F.col("s")).filter("split = 'dev'").groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"b": 1, "c": 2}


def test_languages(spark):
    rows = spark.createDataFrame([("es", 0.99), ("ca", 0.85), ("ca", 0.5), ("pt", 0.99), ("eu", 0.71), ("gl", 0.7), ("", 0.99), (None, None)], "l string, c double")
    got = [tuple(r[0]) for r in rows.select(select.resolve_language(F.col("l"), F.col("c"))).collect()]
    assert [g[0] for g in got] == ["es", "ca", "es", "es", "eu", "gl", "es", "es"]
    assert got[5][1] == "detected" and got[6][1] == "primary_low_confidence" and got[3][1] == "primary_disallowed"


def test_guard_and_quota(spark):
    ok = spark.createDataFrame([(1, None), (2, "web")], "i int, source string")
    assert select.guard_sources(ok).count() == 2 and select.guard_sources(ok.drop("source")).count() == 2
    with pytest.raises(ValueError, match="cv_es"):
        select.guard_sources(ok.unionByName(spark.createDataFrame([(3, "cv_es")], ok.schema)))
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "i int, g string")
    assert select.quota(rows, F.col("g"), F.col("i"), ("a",), 2, other_cap=3).count() == 5
    assert select.stride_sample(rows, F.col("i"), 3).count() == 3


def test_lexicon(spark):
    docs = spark.createDataFrame([(0, "hola hola mundo", "x"), (1, "hola tú", "x"), (2, "adiós", None)], "doc_id long, text string, province string")
    got = lexicon.build_lexicon(docs, ["province"], min_doc_freq=2)
    assert [(r.province, r.word) for r in got.collect()] == [("x", "hola")]
    ids = {r.char: r.id for r in lexicon.char_vocab(docs).collect()}
    assert ids["[PAD]"] == 0 and ids["|"] == 2 and ids["a"] == 3 and " " not in ids


def test_plda_and_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (10, 2)) for c in ([1, 0], [0, 1], [-1, -1])])
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], i // 10) for i in range(30)], "vec_id long, embedding array<float>, label int")
    model = embed.Plda.fit(rows)
    means = np.array([x[k * 10 : k * 10 + 10].mean(axis=0) for k in range(3)])
    assert np.allclose(model.mu, x.mean(axis=0), atol=1e-6)
    want = sum((x[k * 10 : k * 10 + 10] - means[k]).T @ (x[k * 10 : k * 10 + 10] - means[k]) for k in range(3)) / 27
    assert np.allclose(model.within, want, atol=1e-5)
    got = embed.cluster(rows.withColumn("r", F.lit("r")), "r").orderBy("vec_id").collect()
    parts = [{r.cluster for r in got[k * 10 : k * 10 + 10]} for k in range(3)]
    assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 3
    assert embed.average_linkage(np.ones((1, 2))).tolist() == [0]


def test_der_maps_speakers():
    found = diarization.record_error([(0, 5, "a"), (5, 10, "b")], [(0, 6, "x"), (6, 10, "y")])
    assert found == {"miss_s": 0, "false_alarm_s": 0, "confusion_s": 1, "reference_s": 10}


def test_reports(spark):
    rows = spark.createDataFrame([("r1", 0, 0.2, "x", 0.30, 0.24), ("r2", 0, 0.24, "y", 0.30, 0.24), ("r3", 2, 0.4, "x", 0.3, 0.24)], "record_id string, code_switch_count int, normalized_wer double, accent_majority string, der double, der_snapped double")
    got = {r.name: (r.passed, round(r.measured, 4)) for r in report.grade(rows).collect()}
    assert got["H1"] == (True, 0.22) and got["H2"] == (True, 0.18) and got["H3"] == (True, 0.04) and got["H_SNAP"] == (True, 0.06) and "H4" not in got
    assert report.render(report.grade(rows)).count("\n") == 1 + len(got)


def test_stratified_rates(spark):
    rows = spark.createDataFrame([("es", "castilian", 1, 1, 4), ("es", None, 1, 1, 4), ("ca", "x", 1, 1, 4)], "language string, accent string, raw_errors int, errors int, words int")
    got = {(r.language, r.accent): r.normalized_wer for r in score.stratified_wer(rows).collect()}
    assert got == {("es", None): 0.25, ("es", "castilian"): 0.25, ("ca", None): 0.25}


def test_signal():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.zeros(16000), rng.standard_normal(32000) * 0.2, np.zeros(16000)]).astype(np.float32)
    assert signal.voice_segments(x, 16000) == [(pytest.approx(0.98, abs=0.03), pytest.approx(3.0, abs=0.03))]
    assert math.isnan(signal.snr_db(np.array([]))) and signal.snr_db(np.zeros(3)) == -math.inf
    assert len(signal.spectral_features(x, 16000)) == 7 and signal.spectral_features(x[:10], 16000) == [0.0] * 7
    assert signal.loudness(np.zeros(16000), 16000)[1] == 1.0


def test_synth(spark):
    pool = spark.createDataFrame([(f"s{k % 3}", f"c{k}", "es" if k % 5 else "ca", "t", 4.0) for k in range(40)], "speaker_id string, segment_id string, language string, transcript string, duration_s double")
    got = synth.build_recordings(pool, 2, synth.SynthConfig(target_s=30.0)).orderBy("recording", "turn").collect()
    for r in (0, 1):
        turns = [t for t in got if t.recording == r]
        assert turns[0].start_s == 0 and turns[-1].end_s >= 30
        assert all(a.speaker_id != b.speaker_id and a.end_s < b.start_s for a, b in zip(turns, turns[1:]))
        assert {t.language for t in turns} == {"es"}
    with pytest.raises(ValueError):
        synth.pick_speakers({"a": []}, synth.SynthConfig(), None)
    audio, span = synth.splice_music(np.zeros(50), np.ones(3), 4, 10, 10)
    assert span == (4.0, 5.0) and audio[40:].sum() == 10
    assert len(synth.assemble([np.ones(10), np.ones(5)], [0.0, 2.0], 10)) == 25


def test_model_slots(spark):
    rows = spark.createDataFrame([("r", "c", 0.0, 2.0)], "record_id string, chunk_id string, start_s double, end_s double")
    got = pipelines.transcribe(rows, lambda: lambda r: [{"word": "hola", "start_s": r["start_s"], "end_s": r["end_s"], "confidence": 1.0}])
    assert got.first()["words"][0]["word"] == "hola"
    texts = spark.createDataFrame([("a b",)], "text string")
    assert models.score_texts(texts, lambda: lambda t: float(len(t))).first()["lm"] == 3.0


def test_front_end_ablation(spark):
    got = [(round(r.raw_wer, 6), round(r.normalized_wer, 6), r.chunks, r.skipped) for r in pipelines.front_end_ablation(spark).collect()]
    assert got == [(1.363636, 1.272727, 6, 0), (0.818182, 0.727273, 4, 0), (0.090909, 0.0, 2, 2), (0.0, 0.0, 2, 2)]


def test_settings_from_files():
    from dataclasses import dataclass
    from pathlib import Path

    from voxloom.config import from_mapping

    @dataclass
    class Inner:
        rate: int = 16

    globals()["Inner"] = Inner

    @dataclass
    class Settings:
        out: Path
        data: Path | None = None
        sizes: tuple[int, ...] = (1,)
        name: str = "x"
        inner: Inner | None = None

    found = from_mapping(Settings, {"out": "a/b", "data": None, "sizes": [1, 2], "unknown": 3, "inner": {"rate": 8, "other": 1}})
    assert found == Settings(Path("a/b"), None, (1, 2), "x", Inner(8))
    assert from_mapping(Inner, None) == Inner()


def test_data_report(spark):
    turns = spark.createDataFrame([("r1", 0.0, 4.0, "E1"), ("r1", 3.0, 9.0, "I1"), ("r1", 9.0, 12.0, "X")], "record_id string, start_s double, end_s double, speaker string")
    audio = spark.createDataFrame([("r1", 10.0), ("r2", 50.0)], "record_id string, duration_s double")
    profile = report.record_profile(turns, audio)
    rows = {r.record_id: r for r in profile.collect()}
    assert (rows["r1"].n_turns, rows["r1"].n_e, rows["r1"].n_i, rows["r1"].n_other, rows["r1"].speech_s, rows["r1"].overlap_s, rows["r1"].overshoot_s) == (3, 1, 1, 1, 10.0, 1.0, 2.0)
    assert rows["r2"].n_turns == 0 and rows["r2"].speech_ratio == 0 and rows["r1"].speech_ratio == 1
    said = report.data_report("Corpus", profile, {"Markup": spark.createDataFrame([("[RISAS]", 3)], "markup string, n int")})
    assert said.startswith("# Corpus\n\n## Totals") and "| 2 | 0:01:00 | 0:00:10 | 3 |" in said and "## Markup" in said and "| r1 |" in said and "| r2 |" in said


def test_sources_without_references(spark):
    rows = spark.createDataFrame([("a", "one two", "one x"), ("a", None, "words of nobody"), ("a", "...", "more"), (None, "x", "x")], "source string, ref string, hyp string")
    got = {(r.source, r.total): (r.n, r.errors, r.words, r.raw_words) for r in score.source_wer(rows).collect()}
    assert got == {("a", False): (3, 1, 2, 3), (None, False): (1, 0, 1, 1), (None, True): (4, 1, 3, 4)}
