"""Bit packing in transposed blocks of 1024 values.

A block of ``1024`` values of ``width`` bits is written in words of ``t`` bits; lane ``l`` of ``1024 / t`` lanes holds the
values whose places map to it, ``t`` rows of them, one after another, and word ``w`` of a lane stands at
``w * lanes + lane``.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: The order of the groups of eight rows (a fixed value of the layout).
ORDER = np.array([0, 4, 2, 6, 1, 5, 3, 7])


def places(t: int) -> np.ndarray:
    """The logical place of (lane, row), as lanes x t."""
    lanes = BLOCK // t
    row = np.arange(t)
    return (ORDER[row // 8] * 16 + (row % 8) * 128)[None, :] + np.arange(lanes)[:, None]


def pack(values: np.ndarray, width: int, t: int) -> np.ndarray:
    """Words (as uint64, one per t-bit word) of unsigned values, padded with zeros to full blocks."""
    lanes = BLOCK // t
    n = -(-len(values) // BLOCK)
    padded = np.zeros(n * BLOCK, dtype=np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(n, BLOCK)[:, places(t)]  # block, lane, row
    words = np.zeros((n, width, lanes), dtype=np.uint64)
    ones = np.uint64((1 << t) - 1)
    for row in range(t):
        at, shift = divmod(row * width, t)
        value = grid[:, :, row]
        words[:, at] |= value << np.uint64(shift) & ones
        if shift + width > t:
            words[:, at + 1] |= value >> np.uint64(t - shift)
    return words.reshape(-1)


def unpack(words: np.ndarray, width: int, t: int, offset: int, count: int) -> np.ndarray:
    """``count`` unsigned values from logical place ``offset`` on."""
    lanes = BLOCK // t
    n = -(-(offset + count) // BLOCK)
    grid = words[: n * width * lanes].reshape(n, width, lanes)
    out = np.empty((n, BLOCK), dtype=np.uint64)
    where = places(t)
    keep = np.uint64((1 << width) - 1)
    for row in range(t):
        at, shift = divmod(row * width, t)
        value = grid[:, at] >> np.uint64(shift)
        if shift + width > t:
            value = value | grid[:, at + 1] << np.uint64(t - shift)
        out[:, where[:, row]] = value & keep
    return out.reshape(-1)[offset : offset + count]
