"""Counting quotient filters over packed tuples of ids, without loss.

A tuple of ids is packed into one or more lanes of up to 64 bits, as many whole ids a lane as fit, and the lanes are permuted one to
one within their widths. The top bits of the first permuted lane are the quotient, all other bits the remainder; both are kept, so
every key can be read back and counts are exact. A filter holds one bit per quotient (whether any key has it), one bit per key
(whether it is the last of its quotient), the remainders in order, and a byte per count, with larger counts aside. Because keys are
in order of their permuted value, filters of many shards are merged like sorted runs.
"""

from __future__ import annotations

import json

import numpy as np

from threadloom.llm.grams import spread

_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Odd, one per step of the permutation.
_STEPS = tuple(np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF) for i in range(64))
#: Counts from here on are stored aside.
ASIDE = 255


def widths(n: int, bits: int) -> list[int]:
    """Bits of the lanes that a tuple of ``n`` ids of ``bits`` takes."""
    each = 64 // bits
    return [bits * min(each, n - at) for at in range(0, n, each)]


def packed(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The lanes of tuples, from a column per place."""
    each = 64 // bits
    lanes = []
    for at in range(0, len(ids), each):
        lane = np.zeros(len(ids[0]), np.uint64)
        for column in ids[at:at + each]:
            lane = (lane << np.uint64(bits)) | column.astype(np.uint64)
        lanes.append(lane)
    return lanes


def unpacked(lanes: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    each, mask, out = 64 // bits, np.uint64((1 << bits) - 1), []
    for at, lane in zip(range(0, n, each), lanes):
        size = min(each, n - at)
        out += [((lane >> np.uint64(bits * (size - 1 - j))) & mask).astype(np.int64) for j in range(size)]
    return out


def _mixed(lane: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Mix the bits of values below ``2 ** width`` among themselves. A shift by half the width or more undoes itself."""
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    factors = [pow(f, -1, 1 << 64) for f in reversed(_ODD)] if back else _ODD
    for factor in factors:
        lane = ((lane ^ (lane >> half)) * np.uint64(factor)) & mask
    return lane ^ (lane >> half)


def _crossed(lanes: list[np.ndarray], wide: list[int], steps) -> list[np.ndarray]:
    out = list(lanes)
    for step in steps:
        i = step % len(out)
        out[i] = out[i] ^ (spread(out[(i + 1) % len(out)] * _STEPS[step]) & np.uint64((1 << wide[i]) - 1))
    return out


def permuted(lanes: list[np.ndarray], wide: list[int]) -> list[np.ndarray]:
    """One to one; the bits of the first lane depend on all lanes."""
    mixed = [_mixed(lane, w) for lane, w in zip(lanes, wide)]
    return _crossed(mixed, wide, range(2 * len(wide))) if len(wide) > 1 else mixed


def restored(lanes: list[np.ndarray], wide: list[int]) -> list[np.ndarray]:
    """Undo :func:`permuted`."""
    crossed = _crossed(lanes, wide, reversed(range(2 * len(wide)))) if len(wide) > 1 else lanes
    return [_mixed(lane, w, True) for lane, w in zip(crossed, wide)]


def counted(lanes: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order with the sum of their counts (1 each if none are given)."""
    if not len(lanes[0]):
        return lanes, np.zeros(0, np.int64)
    if len(lanes) == 1 and counts is None:
        lanes = [np.sort(lanes[0])]
    else:
        order = np.argsort(lanes[0], kind="stable")
        first = lanes[0][order]
        if len(lanes) > 1:
            differs = np.zeros(len(first) - 1, bool)
            for lane in lanes[1:]:
                differs |= lane[order[1:]] != lane[order[:-1]]
            if (differs & (first[1:] == first[:-1])).any():  # other lanes decide
                order = np.lexsort(lanes[::-1])
        lanes = [lane[order] for lane in lanes]
        counts = None if counts is None else counts[order]
    new = np.ones(len(lanes[0]), bool)
    new[1:] = False
    for lane in lanes:
        new[1:] |= lane[1:] != lane[:-1]
    at = np.flatnonzero(new)
    sums = np.diff(at, append=len(new)) if counts is None else np.add.reduceat(counts, at)
    return [lane[at] for lane in lanes], sums.astype(np.int64)


def _bytes_of(lane: np.ndarray, size: int) -> bytes:
    return lane.astype("<u8").view(np.uint8).reshape(len(lane), 8)[:, :size].tobytes()


def encode(lanes: list[np.ndarray], counts: np.ndarray, wide: list[int]) -> bytes:
    """The bytes of a filter over distinct permuted keys in order."""
    n = len(counts)
    base = int(lanes[0][0]) if n else 0
    span = (int(lanes[0][-1]) - base).bit_length() if n else 0
    rest = min(8, max(0, -(-(span - n.bit_length()) // 8)))  # bytes of a remainder: there are no more quotients than about keys
    offsets = lanes[0] - np.uint64(base)
    quotients = (offsets >> np.uint64(8 * rest)).astype(np.int64) if rest < 8 else np.zeros(n, np.int64)
    occupied = np.zeros(int(quotients[-1]) + 1 if n else 0, bool)
    occupied[quotients] = True
    last = np.ones(n, bool)
    last[:-1] = quotients[1:] != quotients[:-1]
    large = np.flatnonzero(counts >= ASIDE)
    sections = [np.packbits(occupied).tobytes(), np.packbits(last).tobytes(), _bytes_of(offsets, rest), *[_bytes_of(lane, -(-w // 8)) for lane, w in zip(lanes[1:], wide[1:])],
                np.minimum(counts, ASIDE).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()]
    head = json.dumps([n, base, rest, len(occupied), wide]).encode()
    return len(head).to_bytes(2, "little") + head + b"".join(sections)


def decode(raw: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The permuted keys in order and their counts."""
    size = int.from_bytes(raw[:2], "little")
    n, base, rest, quotients, wide = json.loads(raw[2:2 + size])
    at = 2 + size

    def take(length: int) -> np.ndarray:
        nonlocal at
        at += length
        return np.frombuffer(raw, np.uint8, length, at - length)

    def numbers(each: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :each] = take(n * each).reshape(n, each)
        return out.view("<u8").reshape(n)

    occupied = np.flatnonzero(np.unpackbits(take(-(-quotients // 8)), count=quotients))
    last = np.unpackbits(take(-(-n // 8)), count=n).astype(np.int64)
    first = numbers(rest)
    if n and rest < 8:
        run = np.cumsum(last) - last  # which quotient, among those in use
        first = first | (occupied[run].astype(np.uint64) << np.uint64(8 * rest))
    others = [numbers(-(-w // 8)) for w in wide[1:]]
    counts = take(n).astype(np.int64)
    large = np.flatnonzero(counts == ASIDE)
    counts[large] = take(8 * len(large)).copy().view("<i8")
    return [first + np.uint64(base), *others], counts


def merged(filters: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of several filters in order, counts added up."""
    parts = [decode(f) for f in filters]
    width = len(parts[0][0])
    return counted([np.concatenate([p[0][i] for p in parts]) for i in range(width)], np.concatenate([p[1] for p in parts]))
