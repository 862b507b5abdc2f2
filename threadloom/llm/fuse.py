"""Static binary fuse filters (Graf and Lemire, 2022): about nine bits a key, no false negatives, false positives 1 in 256."""

from __future__ import annotations

import math

import numpy as np

_TRIES = 64
_HEAD = np.dtype([("seed", "<u8"), ("length", "<u4"), ("segments", "<u4")])


def mixed(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three slots a key, in three neighbouring segments."""
    start = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    mask, length = np.uint64(length - 1), np.uint64(length)
    return np.stack([start, (start + length) ^ ((h >> np.uint64(18)) & mask), (start + length + length) ^ (h & mask)]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of 64-bit keys as bytes; without keys an empty value, which holds nothing."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if not n:
        return b""
    length = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 4)))
    segments = max(1, math.ceil(room / length) - 2)
    size = (segments + 2) * length
    for seed in range(1, _TRIES + 1):
        h = mixed(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        slots = _slots(h, length, segments)
        order = _peeled(slots, n, size)
        if order is None:
            continue
        prints, table = _prints(h), np.zeros(size, np.uint8)
        for who, where in reversed(order):
            rest = table[slots[0, who]] ^ table[slots[1, who]] ^ table[slots[2, who]]
            table[where] = prints[who] ^ rest ^ table[where]
        head = np.array([(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, length, segments)], _HEAD)
        return head.tobytes() + table.tobytes()
    raise RuntimeError(f"no filter for {n} keys after {_TRIES} seeds")


def _peeled(slots: np.ndarray, n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot each has alone); keys of a round don't touch each other's slots. None if some keys remain."""
    count = np.bincount(slots.ravel(), minlength=size)
    total = np.bincount(slots.ravel(), weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=size).astype(np.int64)
    order, left, alone = [], n, np.flatnonzero(count == 1)
    while len(alone):
        who, at = np.unique(total[alone], return_index=True)
        order.append((who, alone[at]))
        left -= len(who)
        touched = slots[:, who].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(who, 3))
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return order if not left else None


def holds(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    keys = np.asarray(keys, np.uint64)
    if not blob:
        return np.zeros(len(keys), bool)
    head, table = np.frombuffer(blob, _HEAD, 1)[0], np.frombuffer(blob, np.uint8, offset=_HEAD.itemsize)
    h = mixed(keys, int(head["seed"]))
    a, b, c = _slots(h, int(head["length"]), int(head["segments"]))
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)
