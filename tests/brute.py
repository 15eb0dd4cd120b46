"""Brute-force references used by the tests (small inputs only)."""

from __future__ import annotations

import numpy as np


def dbscan_reference(X: np.ndarray, eps: float, min_samples: int) -> list[int]:
    """Textbook sequential DBSCAN in row order (labels as a scan-order run gives)."""
    n = len(X)
    d2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    nb = [np.flatnonzero(d2[i] <= eps * eps) for i in range(n)]
    core = np.array([len(x) >= min_samples for x in nb])
    labels = [-1] * n
    cid = 0
    for i in range(n):
        if not core[i] or labels[i] != -1:
            continue
        labels[i] = cid
        stack = [i]
        while stack:
            p = stack.pop()
            for q in nb[p]:
                if labels[q] == -1:
                    labels[q] = cid
                    if core[q]:
                        stack.append(q)
        cid += 1
    return labels


def scale(X: np.ndarray) -> np.ndarray:
    sd = X.std(axis=0)
    sd[sd == 0] = 1.0
    return (X - X.mean(axis=0)) / sd
