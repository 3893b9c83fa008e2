"""Sets of word shingles as sorted 64-bit hashes, and their minhashes, for chunks of texts at once.

A word's hash has two polynomials over its bytes, each modulo the prime 2**31 - 1, and for a long word it is the
BLAKE2b digest; a shingle's is made of those of its words. Modulo a prime, words share a hash by chance alone, not by
their form. A whole set is named by 128 bits of the digest of its hashes.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from hashlib import blake2b

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z count as a-z.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_JOIN = np.uint64(0xD6E8FEB86659FD93)
#: The prime, and the points at which the two polynomials are taken.
_PRIME, _POINTS = np.uint64((1 << 31) - 1), (np.uint64(1_583_458_089), np.uint64(784_588_717))
#: Masks of the first bytes of a number, three at most.
_FIRST_BYTES = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], dtype=np.uint32)
#: Words of more bytes are long.
LONG_WORD = 96


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text, given where it begins and its number of bytes."""
    threes = np.lib.stride_tricks.as_strided(np.concatenate([text, np.zeros(4, np.uint8)]), (len(text) + 1, 4), (1, 1))
    sums = [size.astype(np.uint64) + np.uint64(1) for _ in _POINTS]
    live, at, left = np.flatnonzero(size <= LONG_WORD), start, size
    at, left = at[live], left[live]
    while len(live):
        value = threes[at].view("<u4").ravel()
        value &= _FIRST_BYTES[np.minimum(left, 3)]
        for held, point in zip(sums, _POINTS, strict=True):
            x = held[live] * point + value
            x = (x & _PRIME) + (x >> np.uint64(31))
            held[live] = (x & _PRIME) + (x >> np.uint64(31))
        more = left > 3
        live, at, left = live[more], at[more] + 3, left[more] - 3
    x, y = (np.where(held >= _PRIME, held - _PRIME, held) for held in sums)
    out = mix(x << np.uint64(32) | y)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(text[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """In order, each once; as np.unique, but quicker for few."""
    values = np.sort(values)
    keep = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes. A text with fewer words has its whole sequence as one
    shingle; without words it has none."""
    n = len(offsets) - 1
    text = _LOWER[np.insert(data, offsets[1:], 32)]  # a space ends each text
    ends = offsets[1:] + np.arange(1, n + 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[text]])))
    start, stop = edge[0::2], edge[1::2]
    word = word_hashes(text, start, stop - start)
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    if len(word) >= words:
        code = word[: len(word) - words + 1].copy()
        for k in range(1, words):
            code = code * _JOIN + word[k : len(word) - words + 1 + k]
        code = mix(code)
    else:
        code = word[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(_distinct(code[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    whole = whole * _JOIN + w
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(word[:0])
    return out


def set_digest(values: np.ndarray) -> bytes:
    """Names a whole set."""
    return blake2b(values.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=4)
def _factors(count: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def minhashes(sets: Iterable[np.ndarray], count: int) -> np.ndarray:
    """A row of 32-bit minhashes for each set, none of which is empty."""
    sets = list(sets)
    out = np.empty((len(sets), count), dtype=np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for j, factor in enumerate(_factors(count)):
        out[:, j] = np.minimum.reduceat((flat * factor) >> np.uint64(32), at)
    return out
