"""Places along a Hilbert curve, for whole arrays of points."""

from __future__ import annotations

import numpy as np


def places(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the curve of each row of cell numbers below ``2**bits``; bits * columns is at most 63.

    The Gray-code form of the curve: from the highest bit down, each axis inverts or exchanges the lower
    bits of the first axis, then the axes' bits are turned from Gray code to a plain number and woven.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    if bits * len(x) > 63:
        raise ValueError("a place must fit 63 bits")
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[-1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            out = out << 1 | ((axis ^ flip) >> level & 1)
    return out
