"""Signal features of mono float samples, and their Arrow UDFs over WAV bytes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.sources import wav

FRAME_S, HOP_S = 0.025, 0.010


def snr_db(x: np.ndarray) -> float:
    """Amplitude-distribution estimate: -10 - 60 * (mean log amplitude - log mean amplitude + 0.4), held in [-20, 60].

    Zeros are left out; no samples: NaN; only zeros: minus infinity.
    """
    if not len(x):
        return math.nan
    size = np.abs(np.asarray(x, np.float64))
    size = size[size > 0]
    if not len(size):
        return -math.inf
    return float(np.clip(-10.0 - 60.0 * (np.log(size).mean() - np.log(size.mean()) + 0.4), -20.0, 60.0))


def snr_from_rows(value: Column) -> Column:
    """The same estimate as an aggregate over rows of samples."""
    size = F.when(value != 0, F.abs(value))
    estimate = F.least(F.lit(60.0), F.greatest(F.lit(-20.0), -10.0 - 60.0 * (F.avg(F.ln(size)) - F.ln(F.avg(size)) + 0.4)))
    return F.when(F.count(value) == 0, float("nan")).when(F.count(size) == 0, float("-inf")).otherwise(estimate)


def frame_rms(x: np.ndarray, rate: int, frame_s: float = FRAME_S, hop_s: float = HOP_S) -> np.ndarray:
    """Root mean square of each frame, from running sums of squares."""
    frame, hop = int(frame_s * rate), int(hop_s * rate)
    if len(x) < frame:
        return np.empty(0, np.float32)
    total = np.concatenate([[0.0], np.cumsum(np.square(x, dtype=np.float64))])
    at = np.arange(0, len(x) - frame + 1, hop)
    return np.sqrt(np.maximum(total[at + frame] - total[at], 0) / frame + 1e-12).astype(np.float32)


def voice_segments(x: np.ndarray, rate: int, min_s: float = 0.20) -> list[tuple[float, float]]:
    """Runs of frames louder than 1.5 times the quietest quarter's edge, of at least min_s."""
    loud = frame_rms(x, rate)
    if not len(loud):
        return []
    on = loud > np.percentile(loud, 25) * 1.5
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).view(np.int8)))
    return [(a * HOP_S, b * HOP_S) for a, b in edge.reshape(-1, 2).tolist() if b * HOP_S - a * HOP_S >= min_s]


def loudness(x: np.ndarray, rate: int) -> tuple[float, float]:
    """(dBFS of the root mean square, share of 25 ms frames under -40 dBFS)."""
    level = lambda r: 20 * np.log10(np.maximum(r, 1e-12))
    if not len(x):
        return level(0.0), 1.0
    frames = frame_rms(x, rate, hop_s=FRAME_S)
    return float(level(np.sqrt(np.mean(np.square(x, dtype=np.float64))))), float((level(frames) < -40).mean()) if len(frames) else 0.0


def _mel_filters(rate: int, n_fft: int, n: int = 40) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), n + 2) / 2595) - 1)
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    up, down = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None], (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def spectral_features(x: np.ndarray, rate: int, n_fft: int = 512) -> list[float]:
    """Centroid mean and deviation, bandwidth mean, 85 % roll-off mean and three cepstral means; zeros under 0.25 s."""
    if len(x) < 0.25 * rate:
        return [0.0] * 7
    at = np.arange(0, len(x) - n_fft + 1, n_fft // 2)
    power = np.abs(np.fft.rfft(x[at[:, None] + np.arange(n_fft)] * np.hanning(n_fft))) ** 2
    size, f = np.sqrt(power), np.arange(n_fft // 2 + 1) * rate / n_fft
    share = size / np.maximum(size.sum(axis=1, keepdims=True), 1e-12)
    centre = share @ f
    width = np.sqrt((share * (f - centre[:, None]) ** 2).sum(axis=1))
    roll = f[(np.cumsum(share, axis=1) >= 0.85 - 1e-9).argmax(axis=1)]
    bands = np.log(np.maximum(power @ _mel_filters(rate, n_fft).T, 1e-10))
    k = np.arange(bands.shape[1])
    cepstrum = bands @ np.cos(np.pi / len(k) * (k[:, None] + 0.5) * np.arange(1, 4)) * math.sqrt(2 / len(k))
    return [float(v) for v in (centre.mean(), centre.std(), width.mean(), roll.mean(), *cepstrum.mean(axis=0))]


@F.pandas_udf(T.DoubleType())
def snr_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda c: snr_db(wav.load_mono(bytes(c))))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])))
def voice_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda c: [{"start_s": s, "end_s": e} for s, e in voice_segments(wav.load_mono(bytes(c)), wav.RATE)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def spectral_udf(content: pd.Series) -> pd.Series:
    return content.map(lambda c: spectral_features(wav.load_mono(bytes(c)), wav.RATE))


@F.pandas_udf(T.StructType([T.StructField("rms_dbfs", T.DoubleType()), T.StructField("silence", T.DoubleType())]))
def loudness_udf(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([loudness(wav.load_mono(bytes(c)), wav.RATE) for c in content], columns=["rms_dbfs", "silence"])


_CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("snr_db", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
])


@F.arrow_udf(T.ArrayType(_CHUNK))
def chunk_features_udf(content, chunks):
    """Signal-to-noise ratio (through float32) and spectral features of each chunk (chunk_id, start_s, end_s) of a recording."""
    import pyarrow as pa

    out = []
    for data, listed in zip(content.to_pylist(), chunks.to_pylist(), strict=True):
        x = wav.load_mono(data)
        parts = [(c, wav.cut(x, c["start_s"], c["end_s"])) for c in listed or []]
        out.append([{**c, "snr_db": float(np.float32(snr_db(y))), "features": spectral_features(y, wav.RATE)} for c, y in parts])
    fields = [("chunk_id", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("snr_db", pa.float64()), ("features", pa.list_(pa.float64()))]
    return pa.array(out, pa.list_(pa.struct(fields)))


def spectral_clusters(rows: DataFrame, features: str = "features", k: int = 5, seed: int = 20260501) -> DataFrame:
    """rows with ``spectral_cluster_id`` by k-means; all 0 where there are fewer rows than clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if rows.limit(k).count() < k:
        return rows.withColumn("spectral_cluster_id", F.lit(0))
    vectors = rows.withColumn("__v", array_to_vector(F.col(features)))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="spectral_cluster_id").fit(vectors)
    return model.transform(vectors).drop("__v")
