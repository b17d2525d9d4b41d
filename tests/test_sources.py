import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.sources import readers, wav, writers


def test_rttm_round_trip(spark, tmp_path):
    (tmp_path / "a.rttm").write_text(";; note\n\nSPEAKER r 1 0.500 1.250 <NA> <NA> A <NA> <NA>\nLEXEME r 1 0 1 x x x x\nSPEAKER r 1 1\n")
    rows = readers.read_rttm(spark, str(tmp_path / "a.rttm"))
    assert [tuple(r) for r in rows.collect()] == [("r", 0.5, 1.75, "A")]
    writers.write_rttm(rows.unionByName(spark.createDataFrame([("r", 3.0, 3.0, "B")], rows.schema)), str(tmp_path / "out"))
    back = readers.read_rttm(spark, str(tmp_path / "out" / "*"))
    assert [tuple(r) for r in back.collect()] == [("r", 0.5, 1.75, "A")]


def test_soft_labels(spark, tmp_path):
    (tmp_path / "rec__x.txt").write_text("0.0 1.5 E1: hola [HS:I2 sí] ya\nnoise\n1.5 2.0 I1: [RISAS]\n2.0 3.0 I1: a=b\n")
    turns = readers.read_soft_labels(spark, str(tmp_path))
    got = turns.orderBy("line").collect()
    assert [(r.record_id, r.speaker, r.also) for r in got] == [("rec", "E1", ["I2"]), ("rec", "I1", []), ("rec", "I1", [])]
    ref = readers.soft_label_references(turns).first()
    assert (ref.raw, ref.normalized) == ("hola ya b", "hola ya b")
    assert writers.soft_labels_to_rttm(turns, str(tmp_path / "rttm")) == 3


def test_metadata_and_logs(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# head\nf1   Lugo  Galicia   3 de mayo de 1999 1:02:03\nbad\n")
    assert [tuple(r) for r in readers.read_metadata(spark, str(tmp_path / "m.txt")).collect()] == [("f1", "Lugo", "Galicia", "3 de mayo de 1999", 3723.0)]
    (tmp_path / "l.json").write_text('{"audio":"a","path":"p","text":"t"}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_segment_labels(spark, str(tmp_path / "l.json")).collect()
    (tmp_path / "rules.json").write_text('{"rules":[{"id":"1","canonical":"para","variants":["pa"],"context":"word_whole","applies_to":["*"]}]}')
    assert readers.read_rules(spark, str(tmp_path / "rules.json"))[0].variants == ("pa",)


def test_packages(spark, tmp_path):
    folder = tmp_path / "hyp"
    folder.mkdir()
    with pytest.raises(FileNotFoundError):
        writers.build_package(spark, str(folder), "asr", [], str(tmp_path / "z.zip"))
    (folder / "r1.txt").write_text("x")
    with pytest.raises(ValueError, match="missing"):
        writers.build_package(spark, str(folder), "asr", ["r1", "r2"], str(tmp_path / "z.zip"))
    assert len(writers.build_package(spark, str(folder), "asr", ["r1"], str(tmp_path / "z.zip"))) == 64
    log = str(tmp_path / "log")
    for _ in range(2):
        writers.record_submission(spark, log, "asr", str(tmp_path / "z.zip"), ["r1"])
    with pytest.raises(ValueError):
        writers.record_submission(spark, log, "asr", str(tmp_path / "z.zip"), ["r1"])


def test_wav(spark, tmp_path):
    x = (np.sin(np.arange(16000) / 20) * 0.5).astype(np.float32)
    data = wav.dump_mono(x)
    assert np.abs(wav.load_mono(data) - x).max() < 1e-3
    for name in ("seg/r1__001.wav", "long/r2.wav", "seg/r3__001.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "seg/r1__001.txt").write_text(" hola \n")
    meta = spark.createDataFrame([("r1", "Lugo", 70.0, "s", "t", 1999, "c")], "record_id string, province string, age double, speaker_id string, topic string, year int, channel string")
    got = sorted(tuple(r) for r in readers.build_manifest(spark, str(tmp_path / "seg"), str(tmp_path / "long"), meta).select("segment_id", "record_id", "transcript", "duration_s", "kind", "province", "split").collect())
    assert got == [("r1__001", "r1", "hola", 1.0, "segment", "Lugo", None), ("r2", "r2", None, 1.0, "longform", None, "longform")]


def test_update_flagged(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, None, None), ("b", False, ["x"], [1.0])], "chunk_id string, flagged boolean, tags array<string>, scores array<double>")
    tags = spark.createDataFrame([("a", ["music"], [0.9])], "chunk_id string, tags array<string>, scores array<double>")
    got = {r.chunk_id: r.tags for r in writers.update_flagged(rows, tags, str(tmp_path / "o")).collect()}
    assert got == {"a": ["music"], "b": None}
    with pytest.raises(ValueError):
        writers.update_flagged(rows.drop("flagged"), tags, str(tmp_path / "p"))
    writers.write_report(spark.createDataFrame([(1.5,)], "x double"), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first()[0] == "1.500000"
    assert F is not None


def test_resampling_keeps_what_the_new_rate_can_hold():
    tone = lambda rate, hz, s=0.5: np.sin(2 * np.pi * hz * np.arange(int(rate * s)) / rate)
    for rate in (8000, 11025, 22050, 44100, 48000):
        y = wav.resample(tone(rate, 440.0), rate)
        want = tone(16000, 440.0)
        assert len(y) == math.ceil(rate // 2 * 16000 / rate) and np.abs(y[200:-200] - want[200 : len(y) - 200]).max() < 2e-3
    for hz in (9500.0, 12000.0, 20000.0):  # above the new Nyquist frequency: interpolation would fold it down
        assert np.abs(wav.resample(tone(44100, hz), 44100)[200:-200]).max() < 5e-3
    assert np.allclose(wav.resample(np.ones(2000), 44100)[100:-100], 1, atol=1e-6)
    assert len(wav.resample(np.zeros(0), 8000)) == 0 and wav.resample(tone(16000, 5.0), 16000).shape == (8000,)
    blocks = wav.resample(tone(44100, 440.0, 3.0), 44100)
    assert len(blocks) > wav.RESAMPLE_BLOCK and np.abs(blocks[300:-300] - tone(16000, 440.0, 3.0)[300:-300]).max() < 2e-3


def test_the_last_slot_goes_to_one_of_many_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    (tmp_path / "z.zip").write_bytes(b"zip")
    log = str(tmp_path / "log")

    def submit(k):
        try:
            writers.record_submission(spark, log, "asr", str(tmp_path / "z.zip"), [f"r{k}"])
        except ValueError:
            return False
        return True

    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(submit, range(6))) == writers.DAILY_SUBMISSIONS
    rows = readers.read_log(spark, log)
    assert rows.count() == writers.DAILY_SUBMISSIONS and writers.remaining_today(rows, "asr") == 0
    assert writers.put_if_absent(spark, f"{log}/x.json", "a") and not writers.put_if_absent(spark, f"{log}/x.json", "b")
    assert (tmp_path / "log" / "x.json").read_text() == "a"
