"""Synthetic conversations from a pool of clips, one seeded recording a row."""

from __future__ import annotations

import math
import random
from bisect import insort
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import ranks
from voxloom.sources.shared import materialize

DRAWN = "recording long, turn long, pause double, who string, d_own boolean, d_group string, place long"
BROADCAST_ROWS = 20_000


@dataclass(frozen=True)
class SynthConfig:
    target_s: float = 300.0
    speakers: int = 2
    silence_s: tuple[float, float] = (0.3, 1.5)
    min_clips: int = 4
    switch: float = 0.0
    seed: int = 20260503


def conversation(clips: dict[str, list[dict]], others: dict[str, list[dict]], speakers: list[str], config: SynthConfig, rng: random.Random) -> list[dict]:
    """Plain form of build_recordings, for tests: turns by alternating speakers, pauses between them, until the target; unused clips
    first, others' languages by chance."""
    turns: list[dict] = []
    spare: dict[str, list[dict]] = {}
    clock = 0.0
    while clock < config.target_s:
        who = speakers[len(turns) % len(speakers)]
        start = clock + (rng.uniform(*config.silence_s) if turns else 0.0)
        if others and rng.random() < config.switch:
            clip = rng.choice(others[rng.choice(list(others))])
        else:
            left = spare.setdefault(who, [])
            if not left:
                left.extend(clips[who])
            clip = left.pop(rng.randrange(len(left)))
        clock = start + clip["duration_s"]
        turns.append({"turn": len(turns), "speaker_id": who, "language": clip["language"], "segment_id": clip["segment_id"], "transcript": clip["transcript"], "start_s": start, "end_s": clock})
    return turns


def pick_speakers(clips: dict[str, Sequence], config: SynthConfig, rng: random.Random) -> list[str]:
    able = [s for s, c in clips.items() if len(c) >= config.min_clips]
    if len(able) < config.speakers:
        raise ValueError(f"{len(able)} of {config.speakers} speakers have {config.min_clips} clips")
    return rng.sample(able, config.speakers)


def drawn(clips: dict[str, range], others: dict[str, range], config: SynthConfig, rng: random.Random, most: int) -> list[tuple]:
    """(turn, pause, speaker, own, group, place) of the first ``most`` turns, as ``conversation`` draws them: a clip is known by its
    place from 0 in its group, a speaker's own clips or those of another language.

    What is drawn doesn't depend on how long clips are; only where a conversation ends does.
    """
    speakers = pick_speakers(clips, config, rng)
    used: dict[str, list[int]] = {}
    out = []
    for turn in range(most):
        who = speakers[turn % len(speakers)]
        pause = rng.uniform(*config.silence_s) if turn else 0.0
        if others and rng.random() < config.switch:
            group = rng.choice(list(others))
            out.append((turn, pause, who, False, group, rng.choice(others[group])))
            continue
        gone = used.setdefault(who, [])
        if len(gone) == len(clips[who]):
            gone.clear()
        place = rng.randrange(len(clips[who]) - len(gone))
        for k in gone:  # in order: a place among the clips that are left becomes one among all
            place += k <= place
        insort(gone, place)
        out.append((turn, pause, who, True, who, place))
    return out


def build_recordings(pool: DataFrame, n: int, config: SynthConfig = SynthConfig(), primary: str = "es") -> DataFrame:
    """(recording, turn, speaker_id, ..) of n recordings, recording i seeded with seed + i; the same pool gives the same rows.

    pool: speaker_id, segment_id, language, transcript, duration_s, of any size. The driver sees one row a speaker and language.
    Clips are numbered inside their groups by segment_id, a recording's places are drawn from the groups' sizes, and only the
    clips drawn are joined on; running sums of pauses and lengths tell where each recording ends.
    """
    spark = pool.sparkSession
    own = F.coalesce(F.col("language") == primary, F.lit(False))
    clip = ["segment_id", "speaker_id", "language", "duration_s", "said"]
    named = pool.select("segment_id", "speaker_id", "language", F.col("duration_s").cast("double").alias("duration_s"), F.xxhash64("transcript").alias("said"), "transcript")
    keys = named.select(own.alias("own"), F.when(own, F.col("speaker_id")).otherwise(F.col("language")).alias("group"), *clip)
    ranked = ranks.numbered(keys, [F.col(c) for c in clip], by=["own", "group"], out="number")
    sizes = ranked.groupBy("own", "group").agg(F.count(F.lit(1)).alias("n"), F.min("segment_id").alias("first"), F.min("duration_s").alias("shortest")).orderBy("first", "group").collect()
    clips, others = ({r["group"]: range(r["n"]) for r in sizes if r["own"] == side} for side in (True, False))
    least = config.silence_s[0] + min((r["shortest"] for r in sizes), default=0.0)
    if sizes and least <= 0:
        raise ValueError("a pause or a clip must last")
    # a turn is begun before the target, and each takes ``least`` but for the first one's pause
    most = math.ceil((config.target_s + config.silence_s[0]) / least) + 1 if sizes else 0

    def run(batches):
        for batch in batches:
            out = [(int(i), *t) for i in batch["id"] for t in drawn(clips, others, config, random.Random(config.seed + int(i)), most)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DRAWN.split(", ")])

    small = lambda df: F.broadcast(df) if n * most <= BROADCAST_ROWS else df
    said = small(spark.range(n).mapInPandas(run, DRAWN))
    same = (F.col("own") == F.col("d_own")) & F.col("group").eqNullSafe(F.col("d_group")) & (F.col("number") == F.col("place") + 1)
    found = said.join(ranked, same).select("recording", "turn", "who", *clip, F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("pause").alias("s")), F.struct(F.lit(1).alias("step"), F.col("duration_s").alias("s")))).alias("x"))
    order = Window.partitionBy("recording").orderBy("turn", "x.step")
    timed = found.withColumn("end_s", F.sum("x.s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    timed = timed.withColumn("start_s", F.lag("end_s").over(order)).withColumn("before", F.lag("end_s", 2, 0.0).over(order))
    turns = timed.filter((F.col("x.step") == 1) & (F.col("before") < config.target_s))
    turns = small(materialize(turns.select("recording", "turn", "who", "start_s", "end_s", *(F.col(c).alias(f"t_{c}") for c in clip)), "synthetic-turns"))
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in clip))
    # clips that are alike in all of this are one
    out = turns.join(named, match).dropDuplicates(["recording", "turn"])
    return out.select("recording", "turn", F.col("who").alias("speaker_id"), "language", "segment_id", "transcript", "start_s", "end_s")


def assemble(clips: list[np.ndarray], starts_s: list[float], rate: int) -> np.ndarray:
    """Clips laid at their starts, silence between them."""
    total = max((round(s * rate) + len(c) for c, s in zip(clips, starts_s, strict=True)), default=0)
    out = np.zeros(total, np.float32)
    for clip, start in zip(clips, starts_s, strict=True):
        at = round(start * rate)
        out[at : at + len(clip)] += clip
    return out


def splice_music(audio: np.ndarray, music: np.ndarray, start_s: float, length_s: float, rate: int, music_rate: int | None = None) -> tuple[np.ndarray, tuple[float, float] | None]:
    """Audio with a stretch replaced by music (looped or cut), clamped to the audio; unlike rates: ValueError."""
    if music_rate is not None and music_rate != rate:
        raise ValueError("music and audio have unlike rates")
    a = min(max(0, round(start_s * rate)), len(audio))
    b = min(len(audio), a + round(length_s * rate))
    if b <= a or not len(music):
        return audio, None
    out = audio.copy()
    out[a:b] = np.resize(music, b - a)
    return out, (a / rate, b / rate)


def clip_counts(pool: DataFrame) -> DataFrame:
    return pool.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("clips"), F.sum("duration_s").alias("seconds"))
