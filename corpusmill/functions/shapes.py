"""Outlines as point lists and shapes as masks: area, even points, and distance fields."""

from __future__ import annotations

import numpy as np


def area(points: np.ndarray) -> float:
    """Signed area of a closed outline."""
    x, y = points[:, 0], points[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def resample(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points at equal distances along a closed outline."""
    closed = np.vstack([points, points[:1]])
    step = np.hypot(*np.diff(closed, axis=0).T)
    along = np.r_[0, np.cumsum(step)]
    at = np.linspace(0, along[-1], n, endpoint=False)
    return np.stack([np.interp(at, along, closed[:, k]) for k in (0, 1)], 1)


def distance_field(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance (1 straight, sqrt 2 diagonal) of each cell to the nearest set one, in two passes.

    Takes one mask or a stack of them (last two axes).
    """
    rows, cols = mask.shape[-2:]
    d = np.where(mask, 0.0, float((rows + cols) * 2))
    diagonal, along = 2**0.5, np.arange(cols)
    for r in range(rows):
        if r:
            d[..., r, :] = np.minimum(d[..., r, :], d[..., r - 1, :] + 1)
            d[..., r, 1:] = np.minimum(d[..., r, 1:], d[..., r - 1, :-1] + diagonal)
            d[..., r, :-1] = np.minimum(d[..., r, :-1], d[..., r - 1, 1:] + diagonal)
        d[..., r, :] = np.minimum.accumulate(d[..., r, :] - along, axis=-1) + along
    for r in range(rows - 1, -1, -1):
        if r + 1 < rows:
            d[..., r, :] = np.minimum(d[..., r, :], d[..., r + 1, :] + 1)
            d[..., r, 1:] = np.minimum(d[..., r, 1:], d[..., r + 1, :-1] + diagonal)
            d[..., r, :-1] = np.minimum(d[..., r, :-1], d[..., r + 1, 1:] + diagonal)
        back = d[..., r, ::-1]
        d[..., r, :] = (np.minimum.accumulate(back - along, axis=-1) + along)[..., ::-1]
    return d
