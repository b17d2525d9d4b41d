"""Language identification in two levels: first the language family, then the languages of that family.

Features are byte n-grams (1 to 3, letters lower-cased, everything that is no letter made one space) hashed into
``DIMS`` cells; a text is the vector of its relative n-gram frequencies' square roots, of length one. The family is
chosen by one linear support vector machine a family (one against the rest); inside a family every pair of
languages has a linear support vector machine of its own, and the language with the most wins is taken (ties: the
larger sum of margins, then the name). The score is the product of the family's and the pairs' probabilities, which
are calibrated on margins of texts that the machines in question have not seen (two halves, each fitted without the other).

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` a language, the smallest by a hash of
the text); every text is then scored whole. Text is the only input of a prediction.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled rows everything is ``und``;
with one language only, that language is predicted with score 1.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import linear_svm
from voxloom.llm.common import bounded_batches

DIMS = 1 << 12
SAMPLE_ROWS = 800
#: Families of languages; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "pt", "it", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "finnic": ("fi", "et"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def _byte_classes() -> bytes:
    """ASCII letters lower-cased, other ASCII made a space, bytes of other characters kept."""
    return bytes(b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))


_CLASSES = _byte_classes()


def _cell(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint32(2654435761)) >> np.uint32(33 - DIMS.bit_length())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Vector of length one over DIMS cells."""
    data = text.encode("utf-8", "replace") if text.isascii() or text.islower() else text.lower().encode("utf-8", "replace")
    raw = np.frombuffer(b" " + b" ".join(data.translate(_CLASSES).split()) + b" ", np.uint8).astype(np.uint32)
    counts = np.bincount(_cell(raw), minlength=DIMS)
    two = raw[:-1] | (raw[1:] << np.uint32(8))
    counts = counts + np.bincount(_cell(two), minlength=DIMS)
    if len(raw) > 2:
        counts = counts + np.bincount(_cell(two[:-1] | (raw[2:] << np.uint32(16))), minlength=DIMS)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(np.linalg.norm(x), 1e-9)


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    family_w: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS + 1)))
    family_scale: list[tuple[float, float]] = field(default_factory=list)
    pairs: list[tuple[str, str, np.ndarray, tuple[float, float]]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of a matrix of features."""
        n = len(x)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        if len(self.families) > 1:
            margins = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
            each = np.column_stack([linear_svm.probability(margins[:, k], s) for k, s in enumerate(self.family_scale)])
            best = each.argmax(axis=1)
            score = each[np.arange(n), best] / np.maximum(each.sum(axis=1), 1e-9)
        else:
            best, score = np.zeros(n, int), np.ones(n)
        out = np.empty(n, object)
        for k, family in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members = [lang for lang in self.langs if family_of(lang) == family]
            if len(members) == 1:
                out[rows] = members[0]
                continue
            wins, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            chance = np.ones((len(rows), len(members)))
            for a, b, w, scale in self.pairs:
                if a in members and b in members:
                    i, j = members.index(a), members.index(b)
                    margin = x[rows] @ w[:-1] + w[-1]
                    p = linear_svm.probability(margin, scale)
                    wins[:, i] += margin > 0
                    wins[:, j] += margin <= 0
                    sums[:, i] += margin
                    sums[:, j] -= margin
                    chance[:, i] = np.minimum(chance[:, i], p)
                    chance[:, j] = np.minimum(chance[:, j], 1 - p)
            order = np.lexsort((np.broadcast_to(-np.arange(len(members)), wins.shape), sums, wins), axis=1)[:, -1]
            out[rows] = np.array(members, object)[order]
            score[rows] *= chance[np.arange(len(rows)), order]
        return list(out), np.clip(score, 0, 1)


def fit_rows(texts: list[str], langs: list[str]) -> Model:
    """A model from labelled texts, on the driver."""
    names = sorted(set(langs))
    families = sorted({family_of(x) for x in names})
    model = Model(names, families)
    if len(names) < 2:
        return model
    x, y = np.array([features(t) for t in texts]), np.array(langs, object)
    of = np.array([family_of(lang) for lang in langs], object)

    def machine(one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sign = np.where(one, 1.0, -1.0)
        balance = np.where(one, len(one) / (2 * max(1, one.sum())), len(one) / (2 * max(1, (~one).sum())))
        return sign, balance

    if len(families) > 1:
        rows = []
        for family in families:
            sign, balance = machine(of == family)
            w = linear_svm.fit(x, sign, balance, c=10.0)
            rows.append(w)
            model.family_scale.append(linear_svm.calibrate(linear_svm.unseen_margins(x, sign, balance, c=10.0), sign))
        model.family_w = np.array(rows)
    for family in families:
        for a, b in itertools.combinations([lang for lang in names if family_of(lang) == family], 2):
            chosen = (y == a) | (y == b)
            sign, balance = machine(y[chosen] == a)
            w = linear_svm.fit(x[chosen], sign, balance, c=10.0)
            model.pairs.append((a, b, w, linear_svm.calibrate(linear_svm.unseen_margins(x[chosen], sign, balance, c=10.0), sign)))
    return model


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from a bounded sample of labelled rows: about sample_rows a language, twice that at most."""
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.col(lang_col) != "und"))
    rows = rows.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return Model([], [])
    # the rows of smallest hash: a share of each language such that sample_rows are expected
    top = F.lit(0)
    for lang, n in sorted(counts.items()):
        top = F.when(F.col("l") == lang, F.lit(min(2**63 - 1, int(2.0**63 * sample_rows / n)))).otherwise(top)
    turn = F.call_function("shiftrightunsigned", F.xxhash64("t"), F.lit(1))
    picked = rows.filter(turn <= top).distinct().orderBy(turn, "t", "l").limit(2 * sample_rows * len(counts)).collect()
    picked = sorted((r for r in picked if has_letter(r["t"])), key=lambda r: (r["l"], r["t"]))
    return fit_rows([r["t"] for r in picked], [r["l"] for r in picked])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by families and pairs of languages times DIMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [k for k, t in enumerate(texts) if t and has_letter(t)]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                found, score = model.predict(np.array([features(texts[k]) for k in known]))
                for k, lang in zip(known, found, strict=True):
                    langs[k] = lang
                scores[known] = score
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
