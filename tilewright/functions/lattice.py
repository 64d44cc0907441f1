"""Numpy steps over a batch of square lattices of 2^k + 1 vertices, shaped (tile, row, column)."""

from __future__ import annotations

import numpy as np


def split_errors(h: np.ndarray) -> np.ndarray:
    """Distance of every vertex from the middle of the edge it splits; corners are 0."""
    n = h.shape[1]
    out = np.zeros_like(h)
    step = 1
    while step < n:
        wide = 2 * step
        lo, hi, odd = slice(0, -1, wide), slice(wide, None, wide), slice(step, None, wide)
        if step < n - 1:
            even = slice(0, None, wide)
            out[:, even, odd] = np.abs(h[:, even, odd] - (h[:, even, lo] + h[:, even, hi]) * 0.5)
            out[:, odd, even] = np.abs(h[:, odd, even] - (h[:, lo, even] + h[:, hi, even]) * 0.5)
            # the diagonal of each square runs through the centre of the square above it
            parity = np.arange((n - 1) // wide) % 2
            rising = parity[:, None] == parity[None, :]
            ends = np.where(rising, h[:, lo, lo] + h[:, hi, hi], h[:, lo, hi] + h[:, hi, lo])
            out[:, odd, odd] = np.abs(h[:, odd, odd] - ends * 0.5)
        step = wide
    return out


def propagate_levels(levels: np.ndarray) -> np.ndarray:
    """Raise levels from small squares to large: child centres to edge midpoints, these to centres."""
    out = levels.copy()
    n = out.shape[1]
    half = 1
    while half < n - 1:
        wide, quarter = 2 * half, half // 2
        if quarter:
            padded = np.pad(out, ((0, 0), (quarter, quarter), (quarter, quarter)), constant_values=-1)
            for row, column in ((0, half), (half, 0)):
                edge = out[:, row::wide, column::wide]
                rows, columns = edge.shape[1:]
                for a in (0, 2 * quarter):
                    for b in (0, 2 * quarter):
                        near = padded[:, row + a::wide, column + b::wide][:, :rows, :columns]
                        np.maximum(edge, near, out=edge)
        lo, hi, odd = slice(0, -1, wide), slice(wide, None, wide), slice(half, None, wide)
        centre = out[:, odd, odd]
        for near in (out[:, odd, lo], out[:, odd, hi], out[:, lo, odd], out[:, hi, odd]):
            np.maximum(centre, near, out=centre)
        half = wide
    return out


def raise_borders(levels: np.ndarray, west, east, south, north) -> np.ndarray:
    """Levels raised to those of four border strips (shape (tile, n), -1 where there is none)."""
    out = levels.copy()
    np.maximum(out[:, :, 0], west, out=out[:, :, 0])
    np.maximum(out[:, :, -1], east, out=out[:, :, -1])
    np.maximum(out[:, 0, :], south, out=out[:, 0, :])
    np.maximum(out[:, -1, :], north, out=out[:, -1, :])
    return out
