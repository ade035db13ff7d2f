"""Patched frame-of-reference blocks for integers below 2^32.

A block of ``BLOCK`` values holds its minimum, the packed low bits of the differences from
it, and a list of exceptions: places and high bits of the values that don't fit.  The width
is that of a percentile of the differences.  Layout, little-endian::

    minimum u32 | width u8 | exceptions u8 | packed 16 * width bytes | places u8.. | highs u32..

Value ``j`` of a block takes the bits from ``j * width`` of its packed 64-bit words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
PERCENTILE = 90
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("n", "u1")])


def _lanes(width: int):
    """For each value of a block: its word, its shift, and whether it runs into the next."""
    for j in range(BLOCK):
        word, shift = divmod(j * width, 64)
        yield j, word, np.uint64(shift), shift + width > 64, np.uint64((64 - shift) % 64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    words = np.zeros((2 * width, values.shape[0]), np.uint64)
    for j, word, shift, over, back in _lanes(width):
        words[word] |= columns[j] << shift
        if over:
            words[word + 1] |= columns[j] >> back
    return np.ascontiguousarray(words.T).view(np.uint8)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(packed.view("<u8").T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((BLOCK, packed.shape[0]), np.uint32)
    for j, word, shift, over, back in _lanes(width):
        x = words[word] >> shift
        if over:
            x |= words[word + 1] << back
        out[j] = x & mask
    return out.T


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions ``starts[i] .. starts[i] + lengths[i] - 1``, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def encode(values: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Bytes of all blocks, and the start of each.  The last block is filled up."""
    n = -(-len(values) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    filled = np.full(n * BLOCK, values[-1], np.uint32)
    filled[: len(values)] = values
    grid = filled.reshape(n, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    place = min(BLOCK - 1, int(BLOCK * percentile / 100))
    widths = _bit_length(np.partition(rest, place, axis=1)[:, place])
    high = (rest.astype(np.uint64) >> widths[:, None].astype(np.uint64)).astype(np.uint32)
    at_block, at_place = np.nonzero(high)
    counts = np.bincount(at_block, minlength=n)
    sizes = _HEAD.itemsize + 16 * widths + 5 * counts
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)

    head = np.empty(n, _HEAD)
    head["low"], head["width"], head["n"] = low, widths, counts
    out[starts[:, None] + np.arange(_HEAD.itemsize)] = head.view(np.uint8).reshape(n, -1)
    for w in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == w)
        fits = rest[rows] & np.uint32((1 << w) - 1)
        out[(starts[rows] + _HEAD.itemsize)[:, None] + np.arange(16 * w)] = _pack(fits, w)
    lists = starts + _HEAD.itemsize + 16 * widths
    out[_runs(lists, counts)] = at_place
    out[_runs(lists + counts, 4 * counts)] = high[at_block, at_place].astype("<u4").view(np.uint8)
    return out.tobytes(), starts


def decode(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Values of the blocks that begin at ``starts`` in ``data`` (bytes), whole blocks."""
    n = len(starts)
    out = np.zeros((n, BLOCK), np.uint32)
    if not n:
        return out.ravel()
    head = data[starts[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD).ravel()
    widths, counts = head["width"].astype(np.int64), head["n"].astype(np.int64)
    for w in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == w)
        packed = data[(starts[rows] + _HEAD.itemsize)[:, None] + np.arange(16 * w)]
        out[rows] = _unpack(packed, w)
    lists = starts + _HEAD.itemsize + 16 * widths
    places = data[_runs(lists, counts)]
    highs = data[_runs(lists + counts, 4 * counts)].view("<u4")
    at = np.repeat(np.arange(n), counts)
    out[at, places] |= (highs.astype(np.uint64) << widths[at].astype(np.uint64)).astype(np.uint32)
    return (out + head["low"][:, None]).ravel()
