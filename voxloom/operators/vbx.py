"""Speaker clustering by a variational hidden Markov model over embeddings (VBx).

Embeddings are moved to the space of a PLDA model in which the within-class covariance is the identity and the
between-class covariance is diagonal. Speakers are states of a Markov chain that stays where it is with probability
``loop``; each has a Gaussian whose mean is a hidden variable with a normal prior. Rounds of mean-field updates (means
given responsibilities, responsibilities given means by forward-backward passes, start probabilities) never lower the evidence
bound. Speakers that lose all their embeddings vanish, so that their number follows from the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.embed import Plda, average_linkage


@dataclass(frozen=True)
class VbxConfig:
    #: Fixed values of the recipe: weights of the embeddings' and the speakers' terms, probability of no change, most rounds.
    fa: float = 0.3
    fb: float = 17.0
    loop: float = 0.99
    rounds: int = 40
    #: Most speakers to begin with, the cut of the clusters that they begin with, and how sure these are.
    speakers: int = 8
    threshold: float = 0.5
    certainty: float = 7.0
    #: A round that raises the bound by less is the last.
    least_gain: float = 1e-4


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def forward_backward(logp: np.ndarray, start: np.ndarray, loop: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(responsibilities, expected entries by a jump, log-likelihood) of a chain that stays with probability ``loop`` and else
    draws its state anew from ``start``.

    A jump goes to a state whatever the state before it was, so a step costs one sum over states instead of one a pair.
    """
    n, k = logp.shape
    with np.errstate(divide="ignore"):
        log_start, stay, jump = np.log(start), np.log(loop), np.log(1 - loop)
    ahead, behind = np.empty((n, k)), np.zeros((n, k))
    ahead[0] = log_start + logp[0]
    for t in range(1, n):
        ahead[t] = logp[t] + np.logaddexp(stay + ahead[t - 1], jump + log_start + _log_sum(ahead[t - 1], 0))
    for t in range(n - 2, -1, -1):
        later = logp[t + 1] + behind[t + 1]
        behind[t] = np.logaddexp(stay + later, jump + _log_sum(log_start + later, 0))
    total = float(_log_sum(ahead[-1], 0))
    entered = np.exp(jump + log_start + logp[1:] + behind[1:] + _log_sum(ahead[:-1], 1)[:, None] - total).sum(axis=0) if n > 1 else np.zeros(k)
    return np.exp(ahead + behind - total), entered, total


def variational_hmm(x: np.ndarray, between: np.ndarray, first: np.ndarray, config: VbxConfig = VbxConfig()) -> tuple[np.ndarray, list[float]]:
    """(responsibilities, evidence bounds by round) of embeddings x in PLDA space (variances ``between``) from labels ``first``."""
    n, dims = x.shape
    k = int(first.max()) + 1
    sure = np.exp(config.certainty * np.eye(k)[first])
    gamma, start = sure / sure.sum(axis=1, keepdims=True), np.full(k, 1 / k)
    scaled, ratio = x * np.sqrt(between), config.fa / config.fb
    constant = -0.5 * ((x * x).sum(axis=1) + dims * np.log(2 * np.pi))
    bounds: list[float] = []
    for _ in range(config.rounds):
        variance = 1 / (1 + ratio * gamma.sum(axis=0)[:, None] * between)
        mean = ratio * variance * (gamma.T @ scaled)
        logp = config.fa * (scaled @ mean.T - 0.5 * ((variance + mean * mean) @ between) + constant[:, None])
        gamma, entered, likelihood = forward_backward(logp, start, config.loop)
        bounds.append(likelihood + 0.5 * config.fb * float((np.log(variance) - variance - mean * mean + 1).sum()))
        start = gamma[0] + entered
        start = start / start.sum()
        if len(bounds) > 1 and bounds[-1] - bounds[-2] < config.least_gain:
            break
    return gamma, bounds


def to_plda_space(plda: Plda) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, matrix, variances): (v - mean) @ matrix has the identity as within-class covariance and the variances, the largest
    first, as between-class covariance. Directions without any are left out."""
    values, vectors = np.linalg.eigh(plda.within)
    good = values > 1e-9 * max(values.max(), 1e-300)
    white = vectors[:, good] / np.sqrt(values[good])
    spread, turned = np.linalg.eigh(white.T @ plda.between @ white)
    kept = np.flatnonzero(spread > 1e-9)[::-1]
    return plda.mu, white @ turned[:, kept], spread[kept]


def first_labels(x: np.ndarray, config: VbxConfig) -> np.ndarray:
    """Labels of average-linkage clusters; those beyond the ``speakers`` largest join the last of these."""
    label = average_linkage(x, config.threshold)
    size = np.bincount(label)
    place = np.empty(len(size), int)
    place[np.lexsort((np.arange(len(size)), -size))] = np.arange(len(size))
    return np.minimum(place[label], config.speakers - 1)


def cluster(vectors: DataFrame, plda: Plda, key: str = "record_id", order: str = "vec_id", vec_col: str = "embedding", config: VbxConfig = VbxConfig()) -> DataFrame:
    """(key, order, cluster, rounds, bound): each record's embeddings, in their order, with speakers from 0 by first appearance.

    Records are the parallel unit: the chain runs along one. Time and memory are linear in its embeddings but for the first
    clusters, whose time is quadratic. Null vectors have no cluster.
    """
    mean, matrix, between = to_plda_space(plda)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at").reset_index(drop=True)
        x = np.vstack(group["v"].to_numpy()).astype(float)
        gamma, bounds = variational_hmm((x - mean) @ matrix, between, first_labels(x, config), config)
        label = gamma.argmax(axis=1)
        _, first = np.unique(label, return_index=True)
        rank = {int(label[i]): k for k, i in enumerate(np.sort(first))}
        return pd.DataFrame({"key": group["key"], "at": group["at"], "cluster": [rank[int(c)] for c in label], "rounds": len(bounds), "bound": bounds[-1]})

    rows = vectors.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(vec_col).alias("v")).filter("v is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"key {kinds['key']}, at {kinds['at']}, cluster int, rounds int, bound double"
    return rows.groupBy("key").applyInPandas(run, schema).withColumnsRenamed({"key": key, "at": order})
