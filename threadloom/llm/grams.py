"""Word hashes and word n-grams of many texts at once, on the bytes of Arrow string columns.

Both word classes used here are told apart byte by byte in UTF-8, so whole batches are cut and hashed by array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes handled at once; one longer text is handled alone.
BLOCK = 1 << 18

#: Words of more bytes are hashed one by one.
LONG = 64


def spread(h: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes as they are, and with A-Z as a-z.
EXACT = np.arange(256, dtype=np.uint8)
FOLDED = EXACT.copy()
FOLDED[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
LETTERED = np.zeros(256, bool)
LETTERED[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def give_back() -> None:
    """Return freed memory to the system at the end of a task; an idle Python worker would keep it beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset:column.offset + n + 1]
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, size, int(offsets[0])), offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``most`` bytes: first text, end, their bytes and offsets."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first bytes of eight
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of ``data``: their bytes, eight at a time, each mixed in by :func:`spread`, which no sum undoes."""
    size = end - start
    out = spread(size.astype(np.uint64) * _STEP)
    short = np.flatnonzero(size <= LONG)
    if len(data) < 8:
        data = np.concatenate([data, np.zeros(8, np.uint8)])
    ends = len(data) - 8
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    for at in range(0, LONG, 8):
        if at:
            short = short[size[short] > at]
        if not len(short):
            break
        # A window past the end of the data begins earlier and is shifted.
        first = start[short] + at
        late = np.maximum(first - ends, 0)
        eight = windows[first - late].view("<u8").ravel() >> (late.astype(np.uint64) * np.uint64(8))
        out[short] = spread((out[short] ^ (eight & _KEEP[np.minimum(size[short] - at, 8)])) + _STEP)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]].tobytes())
    return out


class Words:
    """The words of a block: ``start`` and ``end`` in bytes, ``doc``, the text each is in, ``hash``; ``first`` word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, letters: np.ndarray = FOLDED):
        n, docs = len(data), len(offsets) - 1
        inside, edge = word_bytes[data], np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (edge[:-1] | ~before))
        self.end = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(docs), np.diff(self.first))
        self.data, self.offsets = data, offsets
        self.hash = word_hashes(letters[data], self.start, self.end)

    def grams(self, k: int) -> np.ndarray:
        """The hash of the ``k`` words from each word on; it holds where :meth:`whole` does."""
        return chained(self.hash, k)

    def whole(self, k: int) -> np.ndarray:
        """Whether ``k`` words from each word on lie in one text."""
        ok = np.zeros(len(self.doc), bool)
        if k <= len(ok):
            ok[:len(ok) - k + 1] = self.doc[:len(ok) - k + 1] == self.doc[k - 1:]
        return ok

    def text(self, i: int) -> str:
        """A word with A-Z in lower case."""
        raw = self.data[self.start[i]:self.end[i]]
        return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8).tobytes().decode("utf-8", "replace")


def chained(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each value with the ``k - 1`` after it, in order; past the end as if followed by zeros."""
    total = np.zeros(len(values), np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF | 1
        total[:max(0, len(values) - j)] += values[j:] * np.uint64(factor)
    return spread(total + np.uint64(k))
