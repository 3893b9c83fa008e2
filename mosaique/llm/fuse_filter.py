"""Static binary fuse filters of arity three (T. M. Graf, D. Lemire: Binary Fuse Filters, 2022), in numpy.

Keys are distinct unsigned 64-bit integers. Peeling and assigning go round by round, each round as array
operations: slots that hold one key in the same round belong to different keys or to the same one.
"""

from __future__ import annotations

import math
import struct

import numpy as np

HEADER = struct.Struct("<qqqq")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _slots(hashes: np.ndarray, segment: int, spread: int) -> np.ndarray:
    first = ((hashes >> np.uint64(32)) * np.uint64(spread)) >> np.uint64(32)
    mask, length = np.uint64(segment - 1), np.uint64(segment)
    second = (first + length) ^ ((hashes >> np.uint64(18)) & mask)
    third = (first + length + length) ^ (hashes & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(32))).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """The filter of some distinct keys."""
    n = max(len(keys), 2)
    segment = min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    count = max(1, -(-int(round(n * factor)) // segment) - 2)
    spread, size = count * segment, (count + 2) * segment
    for seed in range(1, 200):
        hashes = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        slots = _slots(hashes, segment, spread)
        load = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, dtype=np.int64)  # xor of the numbers of the keys in a slot
        numbers = np.arange(len(keys))
        for row in slots:
            np.bitwise_xor.at(held, row, numbers)
        order, at, rest = [], [], len(keys)
        open_ = np.flatnonzero(load == 1)
        while len(open_):
            key, first = np.unique(held[open_], return_index=True)
            slot = open_[first]
            order.append(key)
            at.append(slot)
            rest -= len(key)
            gone = slots[:, key].ravel()
            np.subtract.at(load, gone, 1)
            np.bitwise_xor.at(held, gone, np.tile(key, 3))
            gone = np.unique(gone)
            open_ = gone[load[gone] == 1]
        if rest == 0:
            break
    else:
        raise ValueError("keys are not distinct")
    table, prints = np.zeros(size, dtype=np.uint16), _prints(hashes)
    for key, slot in zip(reversed(order), reversed(at), strict=True):
        a, b, c = slots[:, key]
        table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c]  # the key's own slot still holds 0
    return HEADER.pack(seed, segment, spread, len(keys)) + table.astype("<u2").tobytes()


def contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    """True for each key of the filter, and for about one in 65,536 others."""
    seed, segment, spread, held = HEADER.unpack_from(data)
    if not held:
        return np.zeros(len(keys), dtype=bool)
    table = np.frombuffer(data, dtype="<u2", offset=HEADER.size)
    hashes = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    a, b, c = _slots(hashes, segment, spread)
    return (table[a] ^ table[b] ^ table[c]) == _prints(hashes)
