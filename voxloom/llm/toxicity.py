"""Toxicity scores from a subsequence string kernel, Nyström landmarks and a linear support vector machine over sentences.

The kernel compares two words by the character subsequences of length three that they share; each occurrence counts
``DECAY`` to the power of the characters it spans (up to ``SPAN``), and the kernel is normalised. Only letters
and digits make subsequences; whatever stands between them is one gap, however long it is. A word that is spelled with gaps or
inserted characters keeps most of its subsequences, so it stays near the word it hides. Words that are spelled apart (three
or more neighbours of one or two letters each) are compared as one word with gaps as well.

Two sentences are compared by the sum, over all pairs of their distinct words, of the kernel's ``POWER``: products and
sums of kernels are kernels. Landmarks are one-word sentences, the words that distinguish the toxic from the clean texts of
the sample best; the Nyström map (the inverse square root of the landmarks' own kernel) turns a sentence into features on
which the support vector machine is linear. It is trained on sentences: those of clean texts are clean, and of each
toxic text the sentence that the machine of the round before (at first, the kernel alone) finds most toxic is toxic. A text is as toxic as
its most toxic sentence; Platt's scaling, fitted on margins of texts that a machine has not seen, makes margins scores.

The classifier is fitted on a bounded sample of labelled texts (``SAMPLE_ROWS`` a class); every text is scored whole.
Words of more than ``TOKEN_CHARS`` characters are compared window by window. Kernel values under ``NEAR`` count as 0: they
are what words without anything in common but some letters have.

Edge cases: a null, empty or wordless text is scored as a sentence without any landmark; without labels of both classes
every score is 0; repeated rows get equal results; ids may be null or of any type; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import linear_svm
from voxloom.llm.common import bounded_batches

SPAN = 7
DECAY = 0.8
SAMPLE_ROWS = 3000
LANDMARKS = 128
#: Log-likelihood ratio from which a word may be a landmark.
SURE = 20.0
NEAR = 0.4
#: Power of the words' kernel in that of sentences: more makes words count that are nearer to a landmark.
POWER = 1
#: Sentences of a clean text and rounds that the machine is trained with.
CLEAN_SENTENCES, ROUNDS = 3, 3
TOKEN_CHARS = 24
#: Words whose kernel values are summed at once, so that they stay in the processor's cache.
WORDS_AT_ONCE = 128
#: Words whose kernel values a worker keeps, and as many again that it may fall back on.
CACHE_WORDS = 400_000
EDGES = "\"'.,;:!?()[]{}<>*#$%&|-_…»«“”‘’¡¿"
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")
#: Words spelled apart: three or more neighbours of one or two letters.
_SHORT = r"[^\w\s]{0,2}\w{1,2}[^\w\s]{0,2}"
SPELLED = re.compile(rf"(?<!\S){_SHORT}(?:\s+{_SHORT}){{2,}}(?!\S)")
SPELLED_MOST = 12
#: What stands between letters becomes one gap.
_GAP = re.compile(r"[^A-Za-z0-9\x80-\U0010ffff]+")
GAP = "\x01"
_OFFSETS = [(b, c) for c in range(2, SPAN) for b in range(1, c)]
_SLOTS = 1 << 20
_ASCII_LETTERS = np.array([chr(i).isalnum() for i in range(128)])


def _is_letter(text: np.ndarray) -> np.ndarray:
    """Letters and digits; every code point beyond ASCII counts as one."""
    return (text >= 128) | _ASCII_LETTERS[np.minimum(text, 127)]


def _codes(text: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """Codes of the three-character subsequences by their place, 0 where one is no letter; text holds code points."""
    codes, weights = [], []
    n = len(text)
    a, letter = text.astype(np.uint64), _is_letter(text)
    for b, c in _OFFSETS:
        if n <= c:
            break
        code = a[: n - c] * np.uint64(0x9E3779B97F4A7C15) + a[b : n - c + b] * np.uint64(0xC2B2AE3D27D4EB4F) + a[c:] * np.uint64(0x165667B19E3779F9)
        code ^= code >> np.uint64(29)
        code[~(letter[: n - c] & letter[b : n - c + b] & letter[c:])] = 0
        codes.append(code)
        weights.append(DECAY ** (c + 1))
    return codes, weights


def pieces(token: str) -> list[str]:
    """A token with its gaps made one character each; windows of it by half steps if it is longer than TOKEN_CHARS."""
    token = _GAP.sub(GAP, token).strip(GAP)
    if len(token) <= TOKEN_CHARS:
        return [token]
    half = TOKEN_CHARS // 2
    return [token[i : i + TOKEN_CHARS] for i in range(0, len(token) - half, half)]


def spelled(text: str) -> set[str]:
    """Words that a text may spell apart: three to SPELLED_MOST neighbours of one or two letters."""
    found = set()
    for run in SPELLED.findall(text):
        parts = run.split()
        for i in range(len(parts) - 2):
            found.update(" ".join(parts[i:j]) for j in range(i + 3, min(len(parts), i + SPELLED_MOST) + 1))
    return found


def subsequences(word: str) -> dict[int, float]:
    """Weight of each three-character subsequence of one word (the kernel's feature vector)."""
    found: dict[int, float] = {}
    codes, weights = _codes(np.array([ord(ch) for ch in word], np.uint32))
    for code, weight in zip(codes, weights, strict=True):
        for k in code.tolist():
            if k:
                found[k] = found.get(k, 0.0) + weight
    return found


def kernel(a: dict[int, float], b: dict[int, float]) -> float:
    """Normalised subsequence kernel of two feature vectors."""
    if len(b) < len(a):
        a, b = b, a
    size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(k, 0.0) for k, v in a.items()) / size if size else 0.0


class Landmarks:
    """Kernel values of words with the landmarks, for many words at once."""

    def __init__(self, words: list[str]):
        self.words = words
        maps = [subsequences(w) for w in words]
        norms = [math.sqrt(sum(v * v for v in m.values())) for m in maps]
        codes = sorted(set(itertools.chain.from_iterable(maps)))
        row = {c: i for i, c in enumerate(codes)}
        self.table = np.zeros((len(codes) + 1, len(words)), np.float32)
        for j, (m, norm) in enumerate(zip(maps, norms, strict=True)):
            for c, v in m.items():
                self.table[row[c], j] = v / norm
        self.codes = np.array(codes, np.uint64)
        self.slot = np.zeros(_SLOTS, bool)
        self.slot[self.codes & np.uint64(_SLOTS - 1)] = True
        self.gram = np.array([[kernel(a, b) for b in maps] for a in maps]) if maps else np.zeros((0, 0))
        self.common = [self._least_common(w) for w in words]
        #: Words of late; those before them, from which a word comes back when it is met again.
        self.known: dict[str, np.ndarray | None] = {}
        self.before: dict[str, np.ndarray | None] = {}
        #: Those of ``known`` that are near a landmark.
        self.hits: dict[str, np.ndarray] = {}

    def near(self, tokens: list[str]) -> None:
        """Fills ``known`` for the tokens: kernel values with each landmark, or None if all are below NEAR."""
        parts, owner = [], []
        for k, token in enumerate(tokens):
            for piece in pieces(token):
                if len(piece) >= 3:
                    parts.append(piece)
                    owner.append(k)
        result: list[np.ndarray | None] = [None] * len(tokens)
        if parts and len(self.codes):
            passed = np.flatnonzero(self._may_be_near(parts))
            parts, owner = [parts[k] for k in passed], [owner[k] for k in passed]
        if parts and len(self.codes):
            text = np.frombuffer(("\0" * SPAN).join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.array([len(p) for p in parts])
            starts = np.concatenate([[0], np.cumsum(lengths + SPAN)[:-1]])
            word = np.repeat(np.arange(len(parts)), lengths + SPAN)[: len(text)]
            codes, weights = _codes(text)
            square = np.zeros(len(parts))
            plain = np.bincount(word, _is_letter(text), len(parts)) == lengths
            hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for (_, c), code, weight in zip(_OFFSETS, codes, weights, strict=False):
                square += weight * weight * np.maximum(0, lengths - c)
                maybe = np.flatnonzero(self.slot[code & np.uint64(_SLOTS - 1)])
                at = np.searchsorted(self.codes, code[maybe])
                at[at == len(self.codes)] = 0
                real = self.codes[at] == code[maybe]
                hits.append((word[maybe[real]], at[real], np.full(int(real.sum()), weight)))
            w, r, v = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.argsort(w, kind="stable")
            w, r, v = w[order], r[order], v[order]
            if len(w):
                first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                for lo in range(0, len(first), WORDS_AT_ONCE):
                    start, stop = first[lo], first[lo + WORDS_AT_ONCE] if lo + WORDS_AT_ONCE < len(first) else len(w)
                    values = np.add.reduceat(self.table[r[start:stop]] * v[start:stop, None].astype(np.float32), first[lo : lo + WORDS_AT_ONCE] - start, axis=0)
                    chosen = w[first[lo : lo + WORDS_AT_ONCE]]
                    # a word's norm is least where no subsequence recurs
                    high = np.flatnonzero(values.max(axis=1) >= NEAR * np.sqrt(square[chosen] * plain[chosen]))
                    if not len(high):
                        continue
                    chosen = chosen[high]
                    values = values[high] / self._norms(text, starts[chosen], lengths[chosen])[:, None]
                    for k in np.flatnonzero(values.max(axis=1) >= NEAR):
                        mine = np.where(values[k] >= NEAR, values[k], np.float32(0))
                        old = result[owner[chosen[k]]]
                        result[owner[chosen[k]]] = mine if old is None else np.maximum(old, mine)
        self._keep(zip(tokens, result, strict=True))

    def _keep(self, values: Iterable[tuple[str, np.ndarray | None]]) -> None:
        for word, value in values:
            self.known[word] = value
            if value is not None:
                self.hits[word] = value

    def _may_be_near(self, parts: list[str]) -> np.ndarray:
        """False where a word has too few characters in common with every landmark to reach NEAR."""
        text = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        bits = np.where(text == 0, np.uint64(0), np.uint64(1) << (text.astype(np.uint64) & np.uint64(63)))
        lengths = np.array([len(p) + 1 for p in parts])
        masks = np.bitwise_or.reduceat(bits, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        passed = np.zeros(len(parts), bool)
        for mask, chars, least, enough in self.common:
            some = np.flatnonzero((np.bitwise_count(masks & mask) >= least) & ~passed)
            subset = np.zeros(len(some), np.int64)
            for i, ch in enumerate(chars):
                subset |= ((masks[some] >> np.uint64(ch)).astype(np.int64) & 1) << i
            passed[some] = enough[subset]
        return passed

    @staticmethod
    def _least_common(word: str) -> tuple[np.uint64, list[int], int, np.ndarray]:
        """The word's characters as a mask and a list, the least number of them that another word needs for a kernel of
        NEAR, and for each subset of them whether it is enough for that.

        By Cauchy's inequality the kernel is at most the share of the word's feature vector (its length) that lies
        on subsequences over the common characters.
        """
        chars = sorted({ord(ch) & 63 for ch in word})
        place = {ch: i for i, ch in enumerate(chars)}
        size = np.zeros(1 << len(chars))
        weight: dict[tuple[int, int, int], float] = {}
        for a in range(len(word)):
            for b, c in _OFFSETS:
                if a + c < len(word) and all(_is_letter(np.array([ord(word[i]) for i in (a, a + b, a + c)]))):
                    key = tuple(word[i] for i in (a, a + b, a + c))
                    weight[key] = weight.get(key, 0.0) + DECAY ** (c + 1)
        for key, v in weight.items():
            size[sum(1 << i for i in {place[ord(ch) & 63] for ch in key})] += v * v
        for i in range(len(chars)):  # sums over subsets
            view = size.reshape(-1, 2, 1 << i)
            view[:, 1] += view[:, 0]
        enough = size >= NEAR * NEAR * size[-1] * (1 - 1e-9)
        return np.uint64(sum(1 << ch for ch in chars)), chars, int(np.bitwise_count(np.flatnonzero(enough)).min()), enough

    @staticmethod
    def _norms(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Norms of words' feature vectors, subsequences that recur in a word added up first."""
        padded = lengths + SPAN
        ends = np.cumsum(padded)
        picked = np.repeat(starts - (ends - padded), padded) + np.arange(ends[-1])
        own = np.where(picked < len(text), text[np.minimum(picked, len(text) - 1)], 0)
        own[np.repeat(lengths, padded) <= np.arange(ends[-1]) - np.repeat(ends - padded, padded)] = 0
        word = np.repeat(np.arange(len(starts)), padded)
        place = np.arange(ends[-1]) - np.repeat(ends - padded, padded)
        codes, weights = _codes(own)
        keys, owners, sizes = [], [], []
        for (_, c), code, weight in zip(_OFFSETS, codes, weights, strict=False):
            inside = np.flatnonzero((place[: len(code)] + c < lengths[word[: len(code)]]) & (code != 0))
            keys.append(code[inside])
            owners.append(word[inside])
            sizes.append(np.full(len(inside), weight))
        key, of, size = np.concatenate(keys), np.concatenate(owners), np.concatenate(sizes)
        order = np.lexsort((key, of))
        key, of, size = key[order], of[order], size[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]))
        return np.sqrt(np.bincount(of[new], np.add.reduceat(size, new) ** 2, len(starts)))

    def sentences(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its sentences' kernel values with each landmark, those of sentences that are near none left out."""
        low = [t.lower() if t else "" for t in texts]
        bags = [{*t.split(), *spelled(t)} for t in low]
        if len(self.known) > CACHE_WORDS:  # between batches only: all words of this batch must be known below
            self.known, self.before, self.hits = {}, self.known, {}
        before, hits = self.before, self.hits
        asked = set().union(*(bag.difference(self.known) for bag in bags))
        self._keep((w, before[w]) for w in asked.intersection(before))
        new = list(asked.difference(before))
        for i in range(0, len(new), 20_000):
            self.near(new[i : i + 20_000])
        out = []
        for text, bag in zip(low, bags, strict=True):
            close = hits.keys() & bag
            # words spelled apart may run over ends of sentences ("i. d. i."): each is a sentence of its own
            apart = {w for w in close if any(map(str.isspace, w))}
            found = [hits[w] ** POWER for w in sorted(apart)]
            for sentence in SENTENCE_END.split(text) if len(close) > len(apart) else ():
                if words := close.intersection(sentence.split()):
                    found.append(np.sum([hits[w] ** POWER for w in sorted(words)], axis=0))
            out.append(np.array(found, np.float32).reshape(-1, len(self.words)))
        return out


_HELD: dict[tuple[str, ...], Landmarks] = {}


def landmarks_of(words: list[str]) -> Landmarks:
    """The landmarks with the words that this worker has met already, in tasks before too; those of one model at a time."""
    key = tuple(words)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Landmarks(words)
    return _HELD[key]


@dataclass
class Model:
    landmarks: list[str]
    project: np.ndarray
    weights: np.ndarray
    scale: tuple[float, float]

    def margins(self, sentences: list[np.ndarray]) -> np.ndarray:
        """Of each text the largest margin of its sentences."""
        return largest_margins(sentences, self.project, self.weights)[0]

    def scores(self, sentences: list[np.ndarray]) -> np.ndarray:
        return linear_svm.probability(self.margins(sentences), self.scale)


def largest_margins(sentences: list[np.ndarray], project: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(largest margin, margins of all sentences near a landmark) of each text; a text always has a sentence near none, too."""
    direction = project @ weights[:-1]
    each = [x @ direction + weights[-1] for x in sentences]
    return np.array([max(m.max(), weights[-1]) if len(m) else weights[-1] for m in each]), each


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """The words that over four times the share of toxic texts hold, by the likelihood ratio of that."""
    able = lambda w: len(w) <= TOKEN_CHARS // 2 and sum(map(str.isalnum, w)) >= 3
    bags = [{w for t in text.lower().split() if able(w := t.strip(EDGES))} for text in texts]
    bad, good = Counter(), Counter()
    for bag, label in zip(bags, toxic, strict=True):
        (bad if label else good).update(bag)
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    scored = []
    for w, n in bad.items():
        m = good[w]
        if n * n_good <= 4 * m * n_bad:
            continue
        expected = (n + m) * n_bad / (n_bad + n_good)
        ratio = 2 * (n * math.log(n / expected) + (m * math.log(m / (n + m - expected)) if m else 0))
        if ratio > SURE:
            scored.append((-ratio, w))
    return [w for _, w in sorted(scored)[:most]]


def fit_sentences(found: list[np.ndarray], y: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Weights of the machine over sentences (kernel values with the landmarks) of labelled texts."""
    order = [np.argsort(-x.sum(axis=1), kind="stable") for x in found]
    none = np.zeros((1, len(project)), np.float32)
    for _ in range(ROUNDS):
        rows, signs = [], []
        for x, by, label in zip(found, order, y, strict=True):
            chosen = x[by[: 1 if label else CLEAN_SENTENCES]]
            if not len(chosen):
                chosen = none
            rows.append(chosen)
            signs.append(np.full(len(chosen), 1.0 if label else -1.0))
        weights = linear_svm.fit(np.vstack(rows) @ project, np.concatenate(signs), c=1.0)
        order = [np.argsort(-m, kind="stable") for m in largest_margins(found, project, weights)[1]]
    return weights


def unseen_margins(found: list[np.ndarray], y: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Margins of each half of the texts (every other one of a class) from a machine that is fitted on the other half."""
    half = np.zeros(len(y), bool)
    for label in (False, True):
        half[np.flatnonzero(y == label)[::2]] = True
    margins = np.zeros(len(y))
    for own in (half, ~half):
        fitted = ~own if len(np.unique(y[~own])) == 2 else np.ones(len(y), bool)  # a class of one text can't be held out
        weights = fit_sentences([found[k] for k in np.flatnonzero(fitted)], y[fitted], project)
        margins[own] = largest_margins([found[k] for k in np.flatnonzero(own)], project, weights)[0]
    return margins


def fit_texts(texts: list[str], toxic: list[bool]) -> Model | None:
    """A model from labelled texts, on the driver; None without both classes or without a landmark."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None
    words = choose_landmarks(texts, y)
    if not words:
        return None
    marks = Landmarks(words)
    values, vectors = np.linalg.eigh(np.where(marks.gram >= NEAR, marks.gram, 0.0) ** POWER + 1e-3 * np.eye(len(words)))
    project = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
    found = [x for i in range(0, len(texts), 200) for x in marks.sentences(texts[i : i + 200])]
    weights = fit_sentences(found, y, project)
    return Model(words, project, weights, linear_svm.calibrate(unseen_margins(found, y, project), np.where(y, 1.0, -1.0)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from about sample_rows labelled texts of each class (twice that at most), chosen by a hash of their ids."""
    labels = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) == 1).alias("__y"))
    counts = {r["__y"]: r["count"] for r in labels.groupBy("__y").count().collect()}
    if len(counts) < 2:
        return None
    top = {y: min(2**63 - 1, int(2.0**63 * sample_rows / n)) for y, n in counts.items()}
    turn = F.call_function("shiftrightunsigned", F.xxhash64(F.lit("toxic"), "__id"), F.lit(1))
    chosen = labels.filter(turn <= F.when(F.col("__y"), F.lit(top[True])).otherwise(F.lit(top[False]))).orderBy(turn, "__id").limit(4 * sample_rows)
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.col(text_col).alias("t"), "__y").filter("t is not null").collect()
    rows = sorted((r["t"], r["__y"]) for r in rows)
    return fit_texts([t for t, _ in rows], [y for _, y in rows])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by LANDMARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        marks = landmarks_of(model.landmarks) if model else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = model.scores(marks.sentences(texts)) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
