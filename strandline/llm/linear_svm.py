"""A linear support vector machine with squared hinge loss, fitted in memory on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of sign(x @ w + b) for labels y in {-1, 1}: L-BFGS on the primal, classes weighted evenly."""
    n = len(y)
    pos = max(1, int((y > 0).sum()))
    weight = np.where(y > 0, n / (2 * pos), n / (2 * max(1, n - pos))) * c / n
    theta = np.zeros(x.shape[1] + 1)

    def loss(t):
        m = np.maximum(0.0, 1 - y * (x @ t[:-1] + t[-1]))
        g = -2 * weight * m * y
        return 0.5 * t[:-1] @ t[:-1] + float(weight @ m**2), np.append(t[:-1] + g @ x, g.sum())

    f, g = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, a = g.copy(), []
        for s, z in reversed(past):
            k = s @ q / (s @ z)
            a.append(k)
            q -= k * z
        if past:
            s, z = past[-1]
            q *= s @ z / (z @ z)
        for (s, z), k in zip(past, reversed(a)):
            q += s * (k - z @ q / (s @ z))
        step = 1.0 if past else 1.0 / max(1e-9, np.linalg.norm(g))
        while True:
            new = theta - step * q
            f2, g2 = loss(new)
            if f2 <= f - 1e-4 * step * (g @ q) or step < 1e-8:
                break
            step /= 2
        s, z = new - theta, g2 - g
        done = f - f2 < 1e-7 * max(1.0, f)
        theta, f, g = new, f2, g2
        if s @ z > 1e-12:
            past = [*past[-9:], (s, z)]
        if done:
            break
    return theta[:-1], float(theta[-1])
