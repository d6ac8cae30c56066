"""Words of many texts at once, in numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd base, so that no power of it vanishes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ has them once A-Z are lower-cased: 0-9, a-z and all non-ASCII characters.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one lower-cased byte array, and where each begins (one offset more than texts)."""
    if column.type != pa.large_binary():
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return LOWER[whole], offsets - offsets[0]


def bounds(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; no word runs from one text into the next."""
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = is_word[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside[:-1]
    edge = offsets[1:-1]
    cut = edge[inside[edge] & before[edge]]  # a word on either side of a seam
    start, end = inside & ~before, before & ~inside
    start[cut] = end[cut] = True
    return np.flatnonzero(start), np.flatnonzero(end)


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (none is empty): a polynomial of its bytes modulo 2**64, mixed with its length.  Callers compare the bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()) - 1, BASE, np.uint64)]))
        value = buf[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(1)
        h = np.add.reduceat(value * power[place], first)
        h = (h ^ (h >> np.uint64(32)) ^ size.astype(np.uint64)) * MIX
        return h ^ (h >> np.uint64(29))


def word_counts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(starts, offsets))
