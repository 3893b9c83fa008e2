"""Wavelet matrix over token ids, and its file format (operator 9).

One file holds the tokens of consecutive documents as bit-planes, from the highest bit down. On each plane the
order is that of the plane before it, zeros first, then ones. Ones are counted before each block of a plane, so
rank needs one block and select a search over counts. Blocks are compressed one by one and are unpacked when
asked for: access, counting and occurrence lookup work on the file's bytes without the rest.

Layout, little-endian: magic, header (version, bits, tokens, documents), document keys (int64) and ends (int64);
for each plane its number of zeros (int64), ones before each block (uint32) and sizes of packed blocks (uint32);
then the packed blocks.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC, VERSION = b"WVLTMTRX", 1
HEADER = struct.Struct("<8sIIqq")
#: Tokens whose bits make one block.
BLOCK = 1 << 16


def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes, highest bit first, and the zeros of each."""
    planes, zeros = [], []
    for level in range(bits - 1, -1, -1):
        set_ = (ids & ids.dtype.type(1 << level)) != 0
        planes.append(np.packbits(set_))
        low = np.compress(~set_, ids)  # several times as fast as indexing by a mask
        zeros.append(len(low))
        ids = np.concatenate([low, np.compress(set_, ids)])
    return planes, zeros


def dump(ids: np.ndarray, keys: np.ndarray, ends: np.ndarray, bits: int) -> bytes:
    """The file's bytes; keys and ends have a value for each document, ends counts tokens."""
    planes, zeros = build(ids, bits)
    packer = zstandard.ZstdCompressor(level=1)
    heads, bodies = [], []
    for plane, zero in zip(planes, zeros, strict=True):
        blocks = [plane[i : i + BLOCK // 8] for i in range(0, len(plane), BLOCK // 8)]
        ones = np.array([0, *(int(np.bitwise_count(b).sum()) for b in blocks)], dtype="<u4")
        packed = [packer.compress(b.tobytes()) for b in blocks]
        heads.append(struct.pack("<q", zero) + np.cumsum(ones)[:-1].astype("<u4").tobytes() + np.array([len(x) for x in packed], dtype="<u4").tobytes())
        bodies += packed
    head = HEADER.pack(MAGIC, VERSION, bits, len(ids), len(keys))
    return b"".join([head, keys.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), *heads, *bodies])


class WaveletFile:
    """Reads a file's bytes. Positions and occurrences count from 0."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.tokens, self.documents = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a wavelet matrix file")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        self.keys, self.ends = take("<i8", self.documents), take("<i8", self.documents)
        blocks = -(-self.tokens // BLOCK)
        self.zeros, self.ones, sizes = [], [], []
        for _ in range(self.bits):
            self.zeros.append(int(take("<i8", 1)[0]))
            self.ones.append(take("<u4", blocks).astype(np.int64))
            sizes.append(take("<u4", blocks).astype(np.int64))
        ends = np.cumsum(np.concatenate([[at], *sizes]))
        self.places = [ends[level * blocks : (level + 1) * blocks + 1] for level in range(self.bits)]
        self.data, self.unpack = data, zstandard.ZstdDecompressor().decompress
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, block: int) -> np.ndarray:
        if (level, block) not in self._kept:
            if len(self._kept) > 64:
                self._kept.clear()
            start, end = self.places[level][block : block + 2]
            bits = np.unpackbits(np.frombuffer(self.unpack(self.data[start:end]), dtype=np.uint8))
            self._kept[level, block] = bits[: min(BLOCK, self.tokens - block * BLOCK)]
        return self._kept[level, block]

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        if i >= self.tokens:
            return self.tokens - self.zeros[level]
        return int(self.ones[level][i // BLOCK] + self._block(level, i // BLOCK)[: i % BLOCK].sum())

    def all(self) -> np.ndarray:
        """All tokens in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.tokens, dtype=kind)
        for level in range(self.bits - 1, -1, -1):
            places = self.places[level]
            packed = b"".join(self.unpack(self.data[a:b]) for a, b in zip(places[:-1], places[1:], strict=True))
            set_ = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=self.tokens).view(bool)
            before = np.empty(self.tokens, dtype=kind)
            zero = self.zeros[level]
            before[np.flatnonzero(~set_)] = out[:zero]
            before[np.flatnonzero(set_)] = out[zero:] | kind(1 << (self.bits - 1 - level))
            out = before
        return out

    def access(self, i: int) -> int:
        """The token at a position."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            bit, ones = int(self._block(level, i // BLOCK)[i % BLOCK]), self._rank1(level, i)
            token = token << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return token

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token occurs among the positions from start to before end."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, start, self.tokens if end is None else min(end, self.tokens))
        return b - a

    def select(self, token: int, k: int) -> int:
        """The position of a token's occurrence k."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.tokens)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _select(self, level: int, bit: int, k: int) -> int:
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * BLOCK - self.ones[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(level, block) == bit)[k - int(before[block])])

    def document(self, i: int) -> np.ndarray:
        """Tokens of one document, its end id included."""
        start = int(self.ends[i - 1]) if i else 0
        return np.array([self.access(j) for j in range(start, int(self.ends[i]))], dtype=np.int64)
