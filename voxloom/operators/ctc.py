"""Decoding of frame-wise token scores (CTC): n-best lists by prefix beam search, and token lattices.

A path gives each frame a token or the blank; it reads as the tokens that are left after neighbours that are equal became one
and blanks went. A prefix's probability is the sum over all paths that read as it. The search keeps the prefixes of most
probability after each frame, each with its paths that end in a blank and those that end in its last token told apart:
the same token again makes a longer prefix only after a blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxloom.sources.shared import bounded_batches

NBEST = "array<struct<word:string,first:int,last:int>>"


class PrefixBeams:
    """Beams over frames as they come. Prefixes are nodes of a tree: a token and the node of the prefix before it."""

    def __init__(self, blank: int = 0, width: int = 50):
        self.blank, self.width, self.frame = blank, width, 0
        self.before, self.token, self.child = [-1], [-1], {}
        self.node = np.zeros(1, np.int64)
        self.in_blank, self.in_token = np.zeros(1), np.full(1, -np.inf)
        #: Of each beam the frames in which its tokens came, as (earlier ones, frame): those of the likelier way to it.
        self.came: list[tuple | None] = [None]

    def advance(self, logp: np.ndarray) -> None:
        """One frame: log-probabilities of all tokens."""
        whole, last = np.logaddexp(self.in_blank, self.in_token), np.array([self.token[n] for n in self.node])
        some = np.flatnonzero(last >= 0)
        in_blank, in_token = whole + logp[self.blank], np.full(len(last), -np.inf)
        in_token[some] = self.in_token[some] + logp[last[some]]
        longer = whole[:, None] + logp[None, :]
        longer[some, last[some]] = self.in_blank[some] + logp[last[some]]
        longer[:, self.blank] = -np.inf
        # a longer prefix that is a beam already
        at = {n: k for k, n in enumerate(self.node.tolist())}
        shorter = np.array([at.get(self.before[n], -1) for n in self.node.tolist()])
        own = np.flatnonzero(shorter >= 0)
        came = list(self.came)
        for k in own[longer[shorter[own], last[own]] > np.logaddexp(in_blank[own], in_token[own])]:
            came[k] = (self.came[shorter[k]], self.frame)
        in_token[own] = np.logaddexp(in_token[own], longer[shorter[own], last[own]])
        longer[shorter[own], last[own]] = -np.inf
        score = np.concatenate([np.logaddexp(in_blank, in_token), longer.ravel()])
        chosen = np.argsort(-score, kind="stable")[: self.width]
        chosen = chosen[score[chosen] > -np.inf]
        stay, grow = chosen[chosen < len(last)], chosen[chosen >= len(last)] - len(last)
        nodes = [self._child(int(self.node[k // len(logp)]), int(k % len(logp))) for k in grow]
        self.came = [came[k] for k in stay] + [(self.came[k // len(logp)], self.frame) for k in grow]
        self.node = np.concatenate([self.node[stay], np.array(nodes, np.int64)])
        self.in_blank = np.concatenate([in_blank[stay], np.full(len(grow), -np.inf)])
        self.in_token = np.concatenate([in_token[stay], longer.ravel()[grow]])
        self.frame += 1

    def _child(self, node: int, token: int) -> int:
        found = self.child.get((node, token))
        if found is None:
            found = self.child[node, token] = len(self.token)
            self.before.append(node)
            self.token.append(token)
        return found

    def best(self, n: int) -> list[tuple[float, list[int], list[int]]]:
        """(log-probability, tokens, frames in which they came) of the n likeliest prefixes, equal ones by tokens."""
        found = []
        for node, score, came in zip(self.node.tolist(), np.logaddexp(self.in_blank, self.in_token).tolist(), self.came):
            tokens, since = [], []
            while node > 0:
                tokens.append(self.token[node])
                node = self.before[node]
            while came:
                came, frame = came
                since.append(frame)
            found.append((score, tokens[::-1], since[::-1]))
        return sorted(found, key=lambda x: (-x[0], x[1]))[:n]


def log_softmax(logits: np.ndarray) -> np.ndarray:
    top = logits.max()
    return logits - (top + np.log(np.exp(logits - top).sum()))


def spelled(tokens: list[int], since: list[int], vocabulary: list[str], gap: str = " ") -> list[tuple[str, int, int]]:
    """(word, frame of its first token, frame of its last) of tokens that the gap token parts into words."""
    words: list[tuple[str, int, int]] = []
    fresh = True
    for token, frame in zip(tokens, since):
        piece = vocabulary[token]
        if piece == gap:
            fresh = True
        elif fresh:
            words.append((piece, frame, frame))
            fresh = False
        else:
            words[-1] = (words[-1][0] + piece, words[-1][1], frame)
    return words


def nbest(
    frames: DataFrame, vocabulary: list[str], key: str = "chunk_id", order: str = "frame", logits: str = "logits",
    best: int = 5, width: int = 50, blank: int = 0, gap: str = " ",
) -> DataFrame:
    """(chunk, rank, text, score, words) of each chunk's likeliest readings, from a row (chunk, frame, logits) a frame.

    A chunk's frames stream through a task in order; what is held is the beams and their tree, not the frames. Frames
    without logits are passed over; a chunk without any has the empty text. Texts that read alike (gaps at the ends or
    doubled) stay apart, as their tokens differ.
    """
    bounded_batches(frames.sparkSession)
    rows = frames.select(F.col(key).alias("key"), F.col(order).alias("n"), F.col(logits).cast("array<double>").alias("x"))
    schema = StructType([*rows.select("key").schema, *StructType.fromDDL(f"rank int, text string, score double, words {NBEST}")])
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, held in groupby(each(batches), key=lambda r: r[0]):
            beams = PrefixBeams(blank, width)
            for _, x in held:
                if x:
                    if len(x) != len(vocabulary):
                        raise ValueError(f"a frame of {chunk} has {len(x)} scores for {len(vocabulary)} tokens")
                    beams.advance(log_softmax(np.array(x, float)))
            made = []
            for rank, (score, tokens, since) in enumerate(beams.best(best)):
                words = spelled(tokens, since, vocabulary, gap)
                made.append({"key": chunk, "rank": rank, "text": " ".join(w for w, _, _ in words), "score": score, "words": [{"word": w, "first": a, "last": b} for w, a, b in words]})
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(run, schema).withColumnRenamed("key", key)


def log_softmax_of(logits: Column) -> Column:
    """Log-probabilities of an array of scores, in the JVM."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.get(F.transform(F.array(F.struct(top.alias("top"), F.log(total).alias("log"))), lambda v: F.transform(logits, lambda x: x - v["top"] - v["log"])), 0)


def lattice(frames: DataFrame, vocabulary: list[str], key: str = "chunk_id", order: str = "frame", logits: str = "logits", least: float = -5.0) -> DataFrame:
    """(chunk, frame, token, logp): the tokens of each frame whose log-probability is at least ``least``."""
    rows = frames.select(key, order, F.posexplode(log_softmax_of(F.col(logits).cast("array<double>"))).alias("at", "logp"))
    names = F.array(*(F.lit(v) for v in vocabulary))
    return rows.filter(F.col("logp") >= least).select(key, order, F.get(names, F.col("at")).alias("token"), "logp")
