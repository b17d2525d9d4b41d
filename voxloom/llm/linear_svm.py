"""Linear support vector machines in the primal (squared hinge, L2), fitted with numpy on bounded samples."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) for labels -1 and 1, by truncated Newton steps with a halving line search."""
    x = np.hstack([np.asarray(x, np.float32), np.ones((len(x), 1), np.float32)])
    weight = np.full(len(x), c) if weight is None else c * weight
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        gap = np.maximum(0, 1 - y * (x @ w))
        return 0.5 * w @ w + (weight * gap * gap).sum(), gap

    value, gap = loss(w)
    for _ in range(rounds):
        grad = w - 2 * x.T @ (weight * y * gap)
        active = gap > 0
        xa, wa = x[active], weight[active]
        step, rest = np.zeros_like(w), -grad
        direction, norm = rest.copy(), rest @ rest
        goal = norm * 1e-6
        for _ in range(100):  # conjugate gradients
            if norm <= goal:
                break
            image = direction + 2 * xa.T @ (wa * (xa @ direction))
            size = norm / (direction @ image)
            step += size * direction
            rest -= size * image
            norm, last = rest @ rest, norm
            direction = rest + norm / last * direction
        scale = 1.0
        while scale > 1e-4:
            new, new_gap = loss(w + scale * step)
            if new <= value + 1e-4 * scale * (grad @ step):
                break
            scale /= 2
        w, gap = w + scale * step, new_gap
        if value - new < 1e-7 * max(1.0, value):
            break
        value = new
    return w


def unseen_margins(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Margins of each half of the rows (every other one of a class) from a machine that is fitted on the other half."""
    half = np.zeros(len(y), bool)
    for label in (-1, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    margins = np.zeros(len(y))
    for own in (half, ~half):
        if len(np.unique(y[~own])) == 2:
            w = fit(x[~own], y[~own], weight[~own], c)
        else:  # a class of one row can't be held out
            w = fit(x, y, weight, c)
        margins[own] = x[own] @ w[:-1] + w[-1]
    return margins


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt's slope and offset: the probability of label 1 is 1 / (1 + exp(-(slope*margin + offset)))."""
    positive, negative = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    design = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        grad = design.T @ (p - target) + 1e-6 * w
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def probability(margin: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scale[0] * margin + scale[1], -35, 35)))
