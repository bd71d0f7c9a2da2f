"""Fitting on bounded labelled samples: what the classifiers share."""

from __future__ import annotations

import numpy as np

#: The most labelled rows that a classifier is fitted on (least hash of the id). Scores, counts and statistics cover all rows.
TRAIN_ROWS = 8_000


def adam(params: dict[str, np.ndarray], grad, steps: int, rate: float) -> dict[str, np.ndarray]:
    """``steps`` steps of Adam with a falling rate; ``grad(params, step)`` gives the gradients."""
    one, two = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    for t in range(1, steps + 1):
        for k, g in grad(params, t).items():
            one[k] += 0.1 * (g - one[k])
            two[k] += 0.01 * (g * g - two[k])
            params[k] = params[k] - rate * (1 - 0.9 * t / steps) * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.99**t)) + 1e-8)
    return params


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
