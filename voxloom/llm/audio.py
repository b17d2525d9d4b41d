"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAV containers, and resampled PCM.

mu-law and A-law bytes expand by tables of 256 values that are built from the codecs' rules; ADPCM blocks of a file
are decoded side by side, one sample of every block at a time; PCM is resampled by a polyphase windowed sinc and
stored as 16-bit WAV.

Edge cases: null media give null audio; media that can't be parsed raise ValueError in the functions and give a null
column with ``on_error="null"`` in ``to_pcm``; empty audio stays empty; repeated rows get equal results.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import bounded_batches

PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
TELEPHONY_RATE = 8000
BLOCK_BYTES = 256
CODEC_NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA_ADPCM: "adpcm"}
#: Texts are filled up to a multiple of this, which is what an ADPCM block of a text holds.
PAYLOAD_UNIT = 64
#: Bytes of text that are stored together: their PCM is up to eight times as large.
PIECE_BYTES = 1 << 20
#: Index steps of IMA ADPCM by the low three bits of a code (fixed values of the format).
ADPCM_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)


@functools.cache
def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law byte: inverted sign, exponent and mantissa around a bias of 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@functools.cache
def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law byte: even bits inverted, linear below segment 1."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(segment > 0, (size + 256) << np.maximum(segment - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


def compress(pcm: np.ndarray, table: np.ndarray) -> bytes:
    """The bytes whose expansion is nearest to each sample (ties: the smaller sample)."""
    order = np.argsort(table, kind="stable")
    levels = table[order].astype(np.int32)
    at = np.clip(np.searchsorted(levels, pcm), 1, 255)
    low = pcm - levels[at - 1] <= levels[at] - pcm
    return order[np.where(low, at - 1, at)].astype(np.uint8).tobytes()


@functools.cache
def adpcm_steps() -> np.ndarray:
    """The 89 quantiser steps of IMA ADPCM: each about 1.1 times the one before, as the format rounds them."""
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int32,
    )  # fixed values of the format


def _adpcm_step(code: np.ndarray, value: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = adpcm_steps()[index]
    delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
    return value, np.clip(index + np.array(ADPCM_INDEX)[code & 7], 0, 88)


def adpcm_decode(data: bytes, block: int = BLOCK_BYTES) -> np.ndarray:
    """Mono IMA ADPCM: all blocks advance together, sample by sample."""
    n = len(data) // block
    rows = np.frombuffer(data[: n * block], np.uint8).reshape(n, block)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2], 88).astype(np.int32)
    out = np.empty((n, 2 * (block - 4) + 1), np.int16)
    out[:, 0] = value
    for k in range(2 * (block - 4)):
        code = (rows[:, 4 + k // 2] >> 4 * (k & 1)).astype(np.int32) & 15
        value, index = _adpcm_step(code, value, index)
        out[:, k + 1] = value
    return out.reshape(-1)


def adpcm_encode(pcm: np.ndarray, block: int = BLOCK_BYTES) -> bytes:
    """Mono IMA ADPCM blocks; the last one is filled with its last sample."""
    per = 2 * (block - 4) + 1
    if not len(pcm):
        return b""
    rows = np.concatenate([pcm, np.full(-len(pcm) % per, pcm[-1], pcm.dtype)]).reshape(-1, per).astype(np.int32)
    out = np.zeros((len(rows), block), np.uint8)
    out[:, :2] = rows[:, :1].astype("<i2").view(np.uint8)
    value, index = rows[:, 0], np.zeros(len(rows), np.int32)
    for k in range(per - 1):
        gap, step = rows[:, k + 1] - value, adpcm_steps()[index]
        size = np.minimum(np.abs(gap) * 4 // step, 7)
        code = np.where(gap < 0, 8, 0) | size
        value, index = _adpcm_step(code, value, index)
        out[:, 4 + k // 2] |= (code << 4 * (k & 1)).astype(np.uint8)
    return out.tobytes()


def write_wav(data: bytes, codec: int, rate: int, samples: int, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file of one format, one fact and one data chunk."""
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if codec == IMA_ADPCM else struct.pack("<H", 0)
    per_second = rate * block if codec != IMA_ADPCM else rate * block // (2 * (block - 4) + 1)
    head = struct.pack("<HHIIHH", codec, 1, rate, per_second, block, bits) + extra
    chunks = b"".join(
        struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) & 1)
        for name, body in ((b"fmt ", head), (b"fact", struct.pack("<I", samples)), (b"data", data))
    )
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunks), b"WAVE") + chunks


def read_wav(media: bytes) -> tuple[int, int, int, int, bytes]:
    """(codec, rate, block bytes, samples or -1, data) of a mono WAV file."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if at + 8 + size > len(media):
            raise ValueError("a chunk is cut off")
        found.setdefault(name, media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    if b"fmt " not in found or b"data" not in found or len(found[b"fmt "]) < 16:
        raise ValueError("no format or no data")
    codec, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if channels != 1:
        raise ValueError("telephony audio has one channel")
    samples = struct.unpack("<I", found[b"fact"][:4])[0] if len(found.get(b"fact", b"")) >= 4 else -1
    return codec, rate, block, samples, found[b"data"]


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a WAV file."""
    codec, rate, block, samples, data = read_wav(media)
    if codec == MULAW:
        pcm = mulaw_table()[np.frombuffer(data, np.uint8)]
    elif codec == ALAW:
        pcm = alaw_table()[np.frombuffer(data, np.uint8)]
    elif codec == IMA_ADPCM:
        pcm = adpcm_decode(data, block)
    elif codec == PCM and block == 2:
        pcm = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int16)
    else:
        raise ValueError(f"codec {codec} isn't telephony audio")
    return rate, pcm[:samples] if 0 <= samples < len(pcm) else pcm


@functools.lru_cache(maxsize=32)
def _phases(up: int, down: int, taps: int) -> list[np.ndarray]:
    """The windowed sinc's taps by phase."""
    n = np.arange(taps * up) - (taps * up - 1) / 2
    cut = 1 / max(up, down)
    sinc = np.sinc(n * cut) * cut * up * np.hanning(taps * up + 2)[1:-1]
    return [sinc[p::up].astype(np.float32) for p in range(up)]


def resample(pcm: np.ndarray, rate: int, to: int, taps: int = 16) -> np.ndarray:
    """16-bit samples at another rate."""
    if rate == to or not len(pcm):
        return pcm
    common = math.gcd(rate, to)
    up, down = to // common, rate // common
    x = pcm.astype(np.float32)
    out = np.empty((len(x), up), np.float32)
    for p, h in enumerate(_phases(up, down, taps)):
        out[:, p] = np.convolve(x, h)[taps // 2 - 1 : taps // 2 - 1 + len(x)]
    return np.clip(np.rint(out.reshape(-1)[::down]), -32768, 32767).astype(np.int16)


def pcm_wav(media: bytes, to: int = 16000) -> bytes:
    """A telephony WAV file as 16-bit PCM at another rate."""
    rate, pcm = decode(media)
    pcm = resample(pcm, rate, to)
    return write_wav(pcm.astype("<i2").tobytes(), PCM, to, len(pcm), 2, 16)


def to_pcm(df: DataFrame, media_col: str = "media", pcm_col: str = "pcm", rate: int = 16000, on_error: str = "raise") -> DataFrame:
    """df with a column of resampled 16-bit PCM WAV files."""
    bounded_batches(df.sparkSession)
    if pcm_col in df.columns:
        raise ValueError(f"there is a column {pcm_col} already")

    def one(media: bytes | None) -> bytes | None:
        if media is None:
            return None
        try:
            return pcm_wav(media, rate)
        except ValueError:
            if on_error != "null":
                raise
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([one(m) for m in batch.column(media_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, pcm_col])

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("binary").alias(pcm_col)).schema)


def payload_of(text: bytes) -> bytes:
    """Bytes filled up with zeros to a positive multiple of PAYLOAD_UNIT."""
    return text + b"\0" * (PAYLOAD_UNIT if not text else -len(text) % PAYLOAD_UNIT)


def loudness(pcm: np.ndarray) -> str:
    """Samples, root mean square, peak and sign changes of 16-bit audio."""
    x = pcm.astype(np.int64)
    rms = math.isqrt(int((x * x).sum()) // max(1, len(x)))
    return f"n={len(x)};rms={rms};peak={int(np.abs(x).max(initial=0))};zc={int((np.diff(np.signbit(x).view(np.int8)) != 0).sum())}"


def media_of(payload: bytes) -> bytes:
    """The payload as the stored bytes of a WAV file: mu-law or A-law samples, or the codes of ADPCM blocks, by its checksum."""
    codec = (MULAW, ALAW, IMA_ADPCM)[zlib.crc32(payload) % 3]
    if codec != IMA_ADPCM:
        return write_wav(payload, codec, TELEPHONY_RATE, len(payload))
    blocks = np.zeros((len(payload) // PAYLOAD_UNIT, 4 + PAYLOAD_UNIT), np.uint8)  # predictor and index start at 0
    blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_UNIT)
    return write_wav(blocks.tobytes(), IMA_ADPCM, TELEPHONY_RATE, len(blocks) * (2 * PAYLOAD_UNIT + 1), 4 + PAYLOAD_UNIT, 4)


def payload_from(media: bytes) -> bytes:
    """What media_of has stored."""
    codec, _, block, _, data = read_wav(media)
    return data if codec != IMA_ADPCM else np.frombuffer(data, np.uint8).reshape(-1, block)[:, 4:].tobytes()


def decode_all(media: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """decode of each file; the ADPCM blocks of all files with blocks of one size advance together."""
    out: list = [None] * len(media)
    together: dict[int, list] = {}
    for k, m in enumerate(media):
        codec, rate, block, samples, data = read_wav(m)
        if codec == IMA_ADPCM:
            together.setdefault(block, []).append((k, rate, samples, data[: len(data) // block * block]))
        else:
            out[k] = decode(m)
    for block, files in together.items():
        per = 2 * (block - 4) + 1
        pcm = adpcm_decode(b"".join(f[3] for f in files), block)
        at = 0
        for k, rate, samples, data in files:
            n = len(data) // block * per
            out[k] = rate, pcm[at : at + (min(n, samples) if samples >= 0 else n)]
            at += n
    return out


def stored_texts(texts: list[bytes | None], rate: int = 16000) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(raw text, media, resampled 16-bit PCM WAV) of each text (null: empty)."""
    raws = [t or b"" for t in texts]
    media = [media_of(payload_of(r)) for r in raws]
    for raw, m, (of, pcm) in zip(raws, media, decode_all(media), strict=True):
        pcm = resample(pcm, of, rate)
        yield raw, m, write_wav(pcm.astype("<i2").tobytes(), PCM, rate, len(pcm), 2, 16)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 16000) -> DataFrame:
    """(id, n_bytes, media, pcm): whole texts as telephony WAV files and their resampled PCM as WAV files."""
    return _stored(docs, id_col, text_col, rate, [("n_bytes", pa.int64()), ("media", pa.binary()), ("pcm", pa.binary())], lambda raw, media, pcm: (len(raw), media, pcm))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 16000) -> DataFrame:
    """What ``media_columns`` stores, read back and described.

    (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): the payload is what
    the stored file gives back; the feature describes the stored PCM (codec of the media, loudness, checksum of the PCM file).
    """

    def one(raw: bytes, media: bytes, pcm: bytes) -> tuple:
        back = payload_from(media)
        feature = f"{CODEC_NAMES[read_wav(media)[0]]};{loudness(decode(pcm)[1])};pcm={zlib.crc32(pcm):08x}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _stored(docs, id_col, text_col, rate, list(zip(names, kinds, strict=True)), one)


def _stored(docs: DataFrame, id_col: str, text_col: str, rate: int, fields: list, one) -> DataFrame:
    """docs' ids with fields that one(raw, media, pcm) gives, PIECE_BYTES of text at a time."""
    bounded_batches(docs.sparkSession)
    names = ["id", *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first = batch.column(1).cast(pa.binary()), 0
            while first < batch.num_rows:
                some, size = [], 0
                while first + len(some) < batch.num_rows and size < PIECE_BYTES:
                    some.append(texts[first + len(some)].as_py())
                    size += len(some[-1] or b"")
                rows = [one(*x) for x in stored_texts(some, rate)]
                columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), *columns], names)
                first += len(some)

    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *(f"{n} {sql[kind]}" for n, kind in fields)])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
