"""PCM WAV bytes with the standard library and numpy: probing, reading as mono at any rate, writing."""

from __future__ import annotations

import io
import math
import wave
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 16000
ZEROS, ROLL_OFF, RESAMPLE_BLOCK = 24, 0.94, 1 << 15
_PROBE = T.StructType([
    T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("duration_s", T.DoubleType()),
    T.StructField("subtype", T.StringType()), T.StructField("format", T.StringType()),
])


def _header(data: bytes) -> tuple:
    """What the header says; nulls for what is no PCM WAV."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            bits = 8 * w.getsampwidth()
            return w.getframerate(), w.getnchannels(), bits, w.getnframes() / w.getframerate(), f"PCM_{'U' if bits == 8 else ''}{bits}", "WAV"
    except (wave.Error, EOFError, ZeroDivisionError):
        return (None,) * 6


@F.pandas_udf(_PROBE)
def probe(content: pd.Series) -> pd.DataFrame:
    """struct<rate,channels,bits,duration_s,subtype,format> of WAV bytes; nulls for other content."""
    rows = pd.DataFrame([_header(bytes(c)) for c in content], columns=[f.name for f in _PROBE])
    return rows.astype({"rate": "Int32", "channels": "Int32", "bits": "Int32", "duration_s": "float64"})


@lru_cache(maxsize=16)
def filter_bank(up: int, down: int) -> np.ndarray:
    """Weights of the input samples around an output sample, a row for each of its ``up`` places between two input samples.

    A sinc that ends the band at ROLL_OFF of the lower of the two Nyquist frequencies, under a Hann window of ZEROS of its
    zero crossings to each side; each row adds up to 1.
    """
    band = ROLL_OFF * min(1.0, up / down)
    half = math.ceil(ZEROS / band)
    distance = np.arange(1 - half, half + 1)[None, :] - np.arange(up)[:, None] / up
    weights = np.sinc(band * distance) * np.where(np.abs(distance) < half, 0.5 + 0.5 * np.cos(np.pi * distance / half), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Samples at another rate, without what lies above the new Nyquist frequency; silence lies beyond both ends.

    Output sample n stands at n * rate / to: between two input samples, at one of a few places, each with weights of its own
    (a polyphase filter). Blocks of output samples bound the memory.
    """
    if rate == to or not len(x):
        return x
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    bank = filter_bank(up, down)
    half = bank.shape[1] // 2
    padded = np.concatenate([np.zeros(half - 1), x, np.zeros(half + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    out = np.empty(-(-len(x) * up // down))
    for at in range(0, len(out), RESAMPLE_BLOCK):
        n = np.arange(at, min(len(out), at + RESAMPLE_BLOCK), dtype=np.int64) * down
        out[at : at + len(n)] = np.einsum("nk,nk->n", windows[n // up], bank[n % up])
    return out


def load_mono(data: bytes, rate: int = RATE) -> np.ndarray:
    """float32 samples in [-1, 1], channels averaged."""
    return _mono(data, rate).astype(np.float32)


def _mono(data: bytes, rate: int) -> np.ndarray:
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, own = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / 2.0 ** (8 * width - 1)
    return resample(x.reshape(-1, channels).mean(axis=1), own, rate)


def dump_mono(x: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit PCM WAV bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(x * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def resampled(content: Column, rate: int = RATE) -> Column:
    """WAV bytes as mono samples at a rate: array<double>."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda c: _mono(bytes(c), rate).astype(np.float64))

    return run(content)


def cut(x: np.ndarray, start_s: float, end_s: float, rate: int = RATE) -> np.ndarray:
    return x[round(start_s * rate) : round(end_s * rate)]
