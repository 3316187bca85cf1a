"""A logistic curve over a few features, so that scores read as probabilities."""


from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(features: np.ndarray, label: np.ndarray, priors: tuple[float, float], ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """``(slopes, offset)`` by Newton steps on the weighted log likelihood; ``features`` has a row per text, and each class weighs its prior share.

    With fewer than two classes in the sample the slopes are 0 and the offset gives the share of class 1 among all labels.
    """
    share = min(max(priors[1] / max(sum(priors), 1e-9), 1e-6), 1 - 1e-6) if sum(priors) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(label)) < 2:
        return np.zeros(features.shape[1]), base
    label = label.astype(np.float64)
    weight = np.where(label > 0, share / label.sum(), (1 - share) / (1 - label).sum())
    centre, width = features.mean(axis=0), features.std(axis=0)
    width[width == 0] = 1.0
    x = np.c_[(features - centre) / width, np.ones(len(features))]
    beta = np.r_[np.zeros(features.shape[1]), base]
    penalty = np.diag([*[ridge] * features.shape[1], 1e-9])
    for _ in range(100):
        p = sigmoid(x @ beta)
        slope = x.T @ (weight * (label - p)) - penalty @ beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta[:-1] / width, float(beta[-1] - (beta[:-1] / width) @ centre)
