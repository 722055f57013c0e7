"""CRC-32C (Castagnoli) of many spans of one byte array at once.

A checksum is linear in the bytes: each byte adds a value that depends on itself and on how many bytes
follow. Blocks of 64 bytes are summed with one table look-up a byte, then each block's sum is moved on by
the blocks that follow it, doubling the step.
"""

from __future__ import annotations

import functools

import numpy as np

#: The reversed Castagnoli polynomial, and the constant of the mask for stored checksums.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 64
#: Blocks summed at a time.
SLICE = 1 << 14


def _bytes_table() -> np.ndarray:
    """What a last byte adds."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _applied(step: np.ndarray, x: np.ndarray) -> np.ndarray:
    return step[0][x & 255] ^ step[1][x >> 8 & 255] ^ step[2][x >> 16 & 255] ^ step[3][x >> 24]


@functools.cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What a byte adds by its place in a block, and the steps past 1, 2, 4, ... bytes."""
    last = _bytes_table()
    every = np.arange(256, dtype=np.uint32)
    one = np.stack([last, every, every << 8, every << 16])  # the lowest byte is fed back, the others move down
    steps = [one]
    while len(steps) < 40:
        steps.append(_applied(steps[-1], steps[-1]))
    place = np.empty((BLOCK, 256), np.uint32)
    place[-1] = last
    for i in range(BLOCK - 2, -1, -1):
        place[i] = _applied(one, place[i + 1])
    return place.ravel(), steps


def _moved(x: np.ndarray, count: np.ndarray, first: int) -> np.ndarray:
    """``x`` followed by count * 2**first zero bytes."""
    steps = _tables()[1]
    for bit in range(int(count.max(initial=0)).bit_length()):
        some = np.flatnonzero(count >> bit & 1)
        x[some] = _applied(steps[first + bit], x[some])
    return x


def spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The checksum of each span of a byte array; an empty span's is 0."""
    place = _tables()[0]
    size = (end - begin).astype(np.int64)
    if not len(size):
        return np.zeros(0, np.uint32)
    blocks = np.maximum(1, -(-size // BLOCK))
    first = np.cumsum(blocks) - blocks
    span = np.repeat(np.arange(len(size)), blocks)
    after = blocks[span] - 1 - (np.arange(len(span)) - first[span])
    low, columns = end[span] - BLOCK * (after + 1), np.arange(BLOCK)
    # All blocks end with a span's byte; a first block begins before its span, with zeros in the place of others'.
    padded = np.concatenate([np.zeros(BLOCK, np.uint8), data])
    blocks_at, row = np.lib.stride_tricks.sliding_window_view(padded, BLOCK), (columns * 256).astype(np.int32)
    total = np.empty(len(span), np.uint32)
    for a in range(0, len(span), SLICE):
        some = slice(a, a + SLICE)
        byte = blocks_at[low[some] + BLOCK]
        short = np.flatnonzero(low[some] < begin[span[some]])
        outside = begin[span[some]][short] - low[some][short]
        byte[short] *= columns >= outside[:, None]
        total[some] = np.bitwise_xor.reduce(place[byte + row], axis=1)
    total = np.bitwise_xor.reduceat(_moved(total, after, BLOCK.bit_length() - 1), first)
    start = _moved(np.full(len(size), 0xFFFFFFFF, np.uint32), size, 0)
    return total ^ start ^ np.uint32(0xFFFFFFFF)


def masked(checksum: np.ndarray) -> np.ndarray:
    """Turned and moved on, so that data that holds checksums does not sum to a fixed value."""
    return ((checksum >> 15) | (checksum << 17)) + np.uint32(MASK)
