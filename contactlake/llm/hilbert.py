"""Positions along a Hilbert curve of any number of dimensions (Skilling's transform), as sortable bytes."""

from __future__ import annotations

import numpy as np


def curve_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """One key per row of ``cells`` (integers below 2**bits, one column per dimension)."""
    n, dims = cells.shape
    if not dims:
        return [b""] * n
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    # From cells to the curve's own axes: undo the turns and reflections of each level, the coarsest first.
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for axis in x:
            turned = (axis >> np.uint32(level)) & np.uint32(1) == 1
            swap = np.where(turned, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap).astype(np.uint32)
            axis ^= swap.astype(np.uint32)
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    carry = np.zeros(n, np.uint32)
    for level in range(bits - 1, 0, -1):
        carry ^= ((x[-1] >> np.uint32(level)) & np.uint32(1)) * np.uint32((1 << level) - 1)
    x ^= carry
    planes = [((x >> np.uint32(level)) & np.uint32(1)).astype(np.uint8) for level in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(planes).T, axis=1)]
