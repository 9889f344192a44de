"""Attention and resizing over small matrices (V17, V18), for use inside batch functions."""

from __future__ import annotations

import numpy as np


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray | None = None, padding: np.ndarray | None = None) -> np.ndarray:
    """softmax(q k' / sqrt(d) + mask) v; keys where padding is true get no weight."""
    score = q.astype(np.float64) @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
    if mask is not None:
        score = score + mask
    if padding is not None:
        score = np.where(padding[..., None, :], -np.inf, score)
    weight = np.exp(score - score.max(axis=-1, keepdims=True))
    return weight / weight.sum(axis=-1, keepdims=True) @ v


def resize_positions(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x at n places, by linear interpolation between centres; unchanged if there are n already."""
    if len(x) == n:
        return x
    at = np.clip((np.arange(n) + 0.5) * len(x) / n - 0.5, 0, len(x) - 1)
    lo = np.floor(at).astype(int)
    hi = np.minimum(lo + 1, len(x) - 1)
    w = (at - lo)[:, None]
    return x[lo] * (1 - w) + x[hi] * w
