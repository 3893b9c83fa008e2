"""Encoding of texts word by word, with a bounded memory of words seen before.

The patterns used here never let a pre-token run across a space that stands between two other characters: the
space opens the next pre-token. So a text cut at its spaces can be encoded part by part. A part that is empty or
has white space at an end stands beside a run of white space; a text with such a part is cut by the pattern.

All of a batch runs in numpy: words are hashed by running sums over the bytes, looked up in an open hash table,
and their ids are gathered from one array. A hash only says where to look: the bytes of every word are compared
with those of the word whose ids it would get, and a text with a word that differs is encoded without the memory.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from .common import ended
from .shingles import mix

#: Words kept with their ids in each Python worker (at most half of the table's slots), and the most bytes of one kept.
MEMO_WORDS, MEMO_BYTES = 1_500_000, 48
#: Bytes that are hashed together, about.
HASH_BYTES = 1 << 20
_SPACE = 32
#: Where a word's place would be: it is not known.
_NONE = -1


class _Table:
    """Places of 64-bit hashes; grows by doubling."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.places = np.full(1 << bits, _NONE, dtype=np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, _NONE if it is not held."""
        mask, at = len(self.keys) - 1, (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == hashes, self.places[at], _NONE)
        open_ = np.flatnonzero((found != hashes) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]]
            hit = found == hashes[open_]
            out[open_[hit]] = self.places[at[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out

    def put(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Adds distinct hashes that are not held."""
        while (self.count + len(hashes)) * 2 > len(self.keys):
            old, kept = self.keys, self.places
            there = np.flatnonzero(old)
            self.bits += 1
            self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
            self.places = np.full(1 << self.bits, _NONE, dtype=np.int32)
            self._place(old[there], kept[there])
        self._place(hashes, places)
        self.count += len(hashes)

    def _place(self, hashes: np.ndarray, places: np.ndarray) -> None:
        mask, at = len(self.keys) - 1, (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.keys[at] == 0)
            slots, first = np.unique(at[free], return_index=True)
            first = free[first]
            self.keys[slots], self.places[slots] = hashes[first], places[first]
            rest = np.ones(len(hashes), dtype=bool)
            rest[first] = False
            hashes, places, at = hashes[rest], places[rest], (at[rest] + 1) & mask
            # one that lost its slot to another of the same round looks at the next


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of data but the last seven, as rows."""
    return np.lib.stride_tricks.as_strided(data, (max(len(data) - 7, 0), 8), (1, 1))


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether strings of a and of b that begin at some places and have the same lengths are equal. Both arrays
    have eight bytes or more behind their last string."""
    a, b = _eights(a), _eights(b)
    out, live = np.ones(len(lengths), dtype=bool), np.arange(len(lengths))
    left = lengths
    while len(live):
        differ = (a[at] ^ b[bt]).view("<u8").ravel()
        short = left < 8
        differ[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live[differ != 0]] = False
        more = (left > 8) & (differ == 0)
        live, at, bt, left = live[more], at[more] + 8, bt[more] + 8, left[more] - 8
    return out


class _Store:
    """Strings of numbers, such as the ids or the bytes of words, one after the other, and where each begins and ends."""

    def __init__(self, kind: type) -> None:
        self.flat = np.zeros(1 << 16, dtype=kind)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.words = self.used = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        need, words = self.used + len(ids), self.words + len(lengths)
        if need + 8 > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need + 8, len(self.flat) * 3 // 2) - self.used, dtype=self.flat.dtype)])
        if words >= len(self.starts):
            self.starts = np.concatenate([self.starts[: self.words + 1], np.zeros(max(words + 1, len(self.starts) * 3 // 2) - self.words - 1, dtype=np.int64)])
        self.flat[self.used : need] = ids
        self.starts[self.words + 1 : words + 1] = self.used + np.cumsum(lengths)
        self.words, self.used = words, need

    def cut(self, words: int) -> None:
        """Forgets the words from some number on."""
        self.words, self.used = words, int(self.starts[words])


def spliced(ids: np.ndarray, ends: np.ndarray, rows: list[int], made: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """ids of texts (n + 1 offsets) with those of some texts replaced."""
    counts, parts, last = np.diff(ends), [], 0
    for i, found in zip(rows, made, strict=True):
        parts += [ids[ends[last] : ends[i]], found.astype(ids.dtype)]
        counts[i], last = len(found), i + 1
    return np.concatenate([*parts, ids[ends[last] :]]), np.concatenate([[0], np.cumsum(counts)])


class MemoEncoder:
    """find cuts a text into its pre-tokens; encode_pieces gives the ids of distinct ones as bytes (little-endian
    unsigned 32-bit). ids is the number of ids there are."""

    def __init__(self, find: Callable[[str], list[str]], encode_pieces: Callable[[list[str]], list[bytes]], ids: int = 1 << 32):
        self.find, self.encode_pieces = find, encode_pieces
        self.table, self.store = _Table(), _Store(np.uint16 if ids <= 1 << 16 else np.uint32)
        self.bytes = _Store(np.uint8)
        self.odd, self.head_of = np.zeros(1 << 14, dtype=bool), np.zeros(1 << 14, dtype=bool)
        draw = np.random.default_rng(int.from_bytes(os.urandom(16), "little"))
        self.values = draw.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.step = int(draw.integers(0, 1 << 62)) * 4 + 5
        self.head = np.uint64(draw.integers(1, 1 << 63))
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def _distinct(self, groups: list[list[str]]) -> list[bytes]:
        """The joined ids of each group of pre-tokens; each distinct pre-token is encoded once."""
        pieces = list({piece for group in groups for piece in group})
        get = dict(zip(pieces, self.encode_pieces(pieces), strict=True)).__getitem__
        return [b"".join(map(get, group)) for group in groups]

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), HASH_BYTES)), len(starts)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            begin, end = int(starts[a]), int(ends[b - 1])
            if len(self.up) <= end - begin:
                size = 1 << max(20, (end - begin).bit_length())
                for name, factor in (("up", self.step), ("down", pow(self.step, -1, 1 << 64))):
                    powers = np.full(size, factor, dtype=np.uint64)
                    powers[0] = 1
                    setattr(self, name, np.cumprod(powers))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data[begin:end]] * self.up[: end - begin])])
            x, y = starts[a:b] - begin, ends[a:b] - begin
            out[a:b] = (sums[y] - sums[x]) * self.down[x] + (y - x).astype(np.uint64)
        return out

    def encode_view(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as bytes one after the other and n + 1 offsets: all ids, and n + 1 offsets of ids."""
        n = len(offsets) - 1
        if not n:
            return self.store.flat[:0], np.zeros(1, dtype=np.int64)
        data = ended(data, offsets, _SPACE)
        offsets = offsets + np.arange(n + 1)
        ends = np.flatnonzero(data == _SPACE)
        starts = np.concatenate([[0], ends[:-1] + 1])
        data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        sizes = ends - starts
        first = np.searchsorted(starts, offsets[:-1])  # each text's first word, which has no space before it
        is_head = np.zeros(len(starts), dtype=bool)
        is_head[first] = True
        h = self._hashes(data[:-8], starts, ends)
        h[first] ^= self.head
        h = mix(h) | np.uint64(1)  # 0 stands for a free slot
        places = self.table.find(h)
        known = self.store.words
        other = np.zeros(len(starts), dtype=bool)  # words that only share a hash with the one found
        held = np.flatnonzero(places != _NONE)
        of = places[held]
        begin = self.bytes.starts[of]
        other[held] = (self.bytes.starts[of + 1] - begin != sizes[held]) | (self.head_of[of] != is_head[held])
        held = held[~other[held]]
        other[held] = ~same_bytes(data, starts[held], self.bytes.flat, self.bytes.starts[places[held]], sizes[held])
        missing = np.flatnonzero(places == _NONE)
        if len(missing):
            new, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            where = missing[where]
            order = np.argsort(sizes[where] > MEMO_BYTES, kind="stable")  # long ones are not kept
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            other[missing] = self._unlike(data, starts, sizes, is_head, missing, where[back])
            new, where = new[order], where[order]
            places[missing] = known + rank[back]
            raw = data.tobytes()
            words = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            odd, groups = [], []
            for word, top in zip((w.decode("utf-8", "replace") for w in words), is_head[where].tolist(), strict=True):
                bad = word[-1:].isspace() if top else not word or word[0].isspace() or word[-1].isspace()
                odd.append(bad)
                groups.append([] if bad else self.find(word if top else " " + word))
            joined = self._distinct(groups)
            self.store.add(np.frombuffer(b"".join(joined), dtype="<u4"), np.array([len(x) // 4 for x in joined], dtype=np.int64))
            if self.store.words > len(self.odd):
                more = np.zeros(max(self.store.words, 2 * len(self.odd)) - len(self.odd), dtype=bool)
                self.odd, self.head_of = np.concatenate([self.odd, more]), np.concatenate([self.head_of, more])
            self.odd[known : self.store.words] = odd
            kept = min(int((sizes[where] <= MEMO_BYTES).sum()), max(MEMO_WORDS - known, 0))
        lengths = self.store.starts[places + 1] - self.store.starts[places]
        counts = np.add.reduceat(lengths, first)
        total = int(lengths.sum())
        at = np.repeat(self.store.starts[places] - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(total)
        ids = self.store.flat[at]
        slow = np.flatnonzero(np.logical_or.reduceat(self.odd[places] | other, first))
        if len(missing):
            self.store.cut(known + kept)
            self.bytes.add(np.frombuffer(b"".join(words[:kept]), dtype=np.uint8), sizes[where[:kept]])
            self.head_of[known : known + kept] = is_head[where[:kept]]
            self.table.put(new[:kept], np.arange(known, known + kept, dtype=np.int32))
        done = np.concatenate([[0], np.cumsum(counts)])
        if len(slow):
            texts = [data[offsets[i] : offsets[i + 1] - 1].tobytes().decode("utf-8", "replace") for i in slow.tolist()]
            made = [np.frombuffer(x, dtype="<u4") for x in self._distinct([self.find(text) for text in texts])]
            return spliced(ids, done, slow.tolist(), made)
        return ids, done

    @staticmethod
    def _unlike(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, is_head: np.ndarray, words: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Which of some words differ from the words beside them that have the same hash."""
        out = (sizes[words] != sizes[like]) | (is_head[words] != is_head[like])
        short = np.flatnonzero(~out & (sizes[words] <= MEMO_BYTES) & (words != like))
        out[short] = ~same_bytes(data, starts[words[short]], data, starts[like[short]], sizes[words[short]])
        for i in np.flatnonzero(~out & (sizes[words] > MEMO_BYTES) & (words != like)).tolist():
            a, b, n = int(starts[words[i]]), int(starts[like[i]]), int(sizes[words[i]])
            out[i] = not np.array_equal(data[a : a + n], data[b : b + n])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, joined."""
        raw = [text.encode("utf-8", "replace") for text in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        ids, ends = self.encode_view(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
